"""Review files scored as they arrive."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from reviewspark.operators.enrich import Gazetteer
from reviewspark.plans.batch import score_rows
from reviewspark.scale import spread
from reviewspark.sources.files import with_roles


def arriving_reviews(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100, delimiter: str = ",") -> DataFrame:
    """Role-mapped rows of CSV files that land in a folder, with file and arrival time."""
    raw = (
        spark.readStream.schema(schema).option("header", True).option("sep", delimiter).option("escape", '"').option("multiLine", True)
        .option("maxFilesPerTrigger", files_per_batch).csv(folder)
    )
    return with_roles(raw.withColumns({"_path": F.col("_metadata.file_path"), "_arrived": F.col("_metadata.file_modification_time")}))


def score_arrivals(rows: DataFrame, gazetteer: Gazetteer, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Score what has arrived and stop; the checkpoint makes each file count exactly once.

    Scoring is a row operation, so a bad row cannot hold back others.  A file
    with line breaks in its fields is read by one task, so the rows of a
    micro-batch are dealt to all cores before they are scored.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    scored = score_rows(rows.repartition(cores), gazetteer, **options)
    watched = scored.observe("progress", F.count(F.lit(1)).alias("processed_rows"), F.count_if(F.col("processing_status") == "success").alias("successful_rows"),
                             F.count_if(F.col("processing_status") == "model_error").alias("failed_rows"))
    return watched.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_arrivals_counted(rows: DataFrame, gazetteer: Gazetteer, out: str, progress: str, checkpoint: str, name: str, **options) -> StreamingQuery:
    """As ``score_arrivals``, with a progress table: a row per query, micro-batch and status.

    Output and progress of a batch have folders of their own, named by query and batch, and are overwritten as a
    whole: a batch that is repeated after a crash leaves the same rows once. Counts are read from what was
    written, so nothing is scored twice.
    """
    def batch(frame: DataFrame, number: int) -> None:
        spark, here, started = frame.sparkSession, f"query={name}/batch={number}", time.time()
        score_rows(spread(frame), gazetteer, **options).write.mode("overwrite").parquet(f"{out}/{here}")
        counts = spark.read.parquet(f"{out}/{here}").groupBy(F.col("processing_status").alias("status")).agg(F.count(F.lit(1)).alias("rows"))
        counts.withColumn("seconds", F.lit(time.time() - started)).coalesce(1).write.mode("overwrite").parquet(f"{progress}/{here}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_progress(spark: SparkSession, progress: str) -> DataFrame:
    """Totals per query: batches, processed, successful and failed rows, seconds and rows per second."""
    table = spark.read.schema("status string, rows long, seconds double, query string, batch long").option("basePath", progress).parquet(progress)
    batches = table.groupBy("query", "batch").agg(
        F.sum("rows").alias("rows"), F.sum(F.when(F.col("status") == "success", F.col("rows")).otherwise(0)).alias("ok"),
        F.sum(F.when(F.col("status") == "model_error", F.col("rows")).otherwise(0)).alias("bad"), F.max("seconds").alias("seconds"))
    return batches.groupBy("query").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("processed_rows"), F.sum("ok").alias("successful_rows"), F.sum("bad").alias("failed_rows"),
        F.sum("seconds").alias("seconds")).withColumn("rows_per_second", F.try_divide("processed_rows", "seconds"))


class ProgressLog(StreamingQueryListener):
    """Keeps running totals and throughput of every query it hears about."""

    def __init__(self):
        self.totals: dict[str, dict[str, float]] = {}

    def onQueryStarted(self, event):
        self.totals.setdefault(str(event.id), {"processed_rows": 0, "successful_rows": 0, "failed_rows": 0, "rows_per_second": 0.0})

    def onQueryProgress(self, event):
        p = event.progress
        seen = self.totals.setdefault(str(p.id), {"processed_rows": 0, "successful_rows": 0, "failed_rows": 0, "rows_per_second": 0.0})
        row = p.observedMetrics.get("progress")
        if row is not None:
            for k in ("processed_rows", "successful_rows", "failed_rows"):
                seen[k] += row[k]
        seen["rows_per_second"] = p.processedRowsPerSecond or 0.0

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
