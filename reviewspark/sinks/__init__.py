"""Result and report writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.functions.text import csv_safe


def write_json_lines(df: DataFrame, path: str, order: str = "row_number") -> None:
    """Results in input order: a range sort, so part files are ordered without one big task."""
    df.orderBy(order).write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str, order: str = "row_number") -> None:
    """Part files that, concatenated by name, are one JSON array in input order."""
    first = df.agg(F.min(order)).first()[0]
    body = F.to_json(F.struct(*df.columns))
    opened = F.when(F.col(order) == F.lit(first), F.concat(F.lit("["), body)).otherwise(F.concat(F.lit(","), body))
    lines = df.select(F.col(order).cast("double").alias("_o"), opened.alias("value"))
    end = df.sparkSession.createDataFrame([(float("inf"), "]" if first is not None else "[]")], "_o double, value string")
    lines.union(end).orderBy("_o").select("value").write.mode("overwrite").text(path)


def flatten_results(df: DataFrame, columns: list[str], nested: list[str] = ("aspects", "warnings"), original: str = "original_fields") -> DataFrame:
    """``original_<column>`` cells, JSON for nested values, every cell safe for spreadsheets."""
    rest = [c for c in df.columns if c not in (original, "row_number")]
    cells = [F.to_json(c).alias(c) if c in nested else F.col(c).cast("string").alias(c) for c in rest]
    flat = df.select(
        F.col("row_number"), *[F.try_element_at(F.col(original), F.lit(c)).alias(f"original_{c}") for c in columns], *cells
    )
    return flat.select("row_number", *[csv_safe(F.col(f"`{c}`")).alias(c) for c in flat.columns if c != "row_number"])


def write_results_csv(df: DataFrame, path: str, columns: list[str], bom: bool = True) -> None:
    """Flattened export; the byte-order mark rides on the first header cell of each part."""
    flat = flatten_results(df, columns).orderBy("row_number")
    if bom:
        flat = flat.withColumnRenamed("row_number", "\ufeffrow_number")
    flat.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A report table, small enough for few files but never collected."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def append_history(df: DataFrame, path: str) -> None:
    df.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def upsert_run(existing: DataFrame, current: DataFrame, modes: DataFrame, key: str = "run_mode") -> DataFrame:
    """The current run replaces its old row; modes without a run stay as explicit ``not_run`` rows."""
    kept = existing.join(current.select(key), key, "left_anti").unionByName(current, allowMissingColumns=True)
    rest = [c for c in kept.columns if c not in modes.columns]
    return (
        modes.join(kept.select(key, *rest), key, "left")
        .withColumn("status", F.coalesce("status", F.lit("not_run")))
        .orderBy("position")
    )


def split_for_review(predictions: DataFrame, documents: DataFrame, errors: DataFrame | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, review queue): uncertain tuples, documents without a tuple and failed documents queue up."""
    accepted = predictions.where(~F.col("needs_human_review"))
    queue = predictions.where("needs_human_review").select(key, "output_type", "review_reasons")
    none_found = documents.join(predictions.select(key), key, "left_anti")
    if errors is not None:
        none_found = none_found.join(errors.select(key), key, "left_anti")
    queue = queue.unionByName(none_found.select(key, F.lit("review").alias("output_type"), F.array(F.lit("no_triplets_detected")).alias("review_reasons")))
    if errors is not None:
        queue = queue.unionByName(errors.select(key, F.lit("error").alias("output_type"), F.array("reason").alias("review_reasons")))
    return accepted, queue


def filtered_export(df: DataFrame, text_column: str, query: str | None = None, kind_column: str | None = None, kind: str | None = None) -> DataFrame:
    """Rows of an error or metric table whose text holds ``query`` and whose type is ``kind``."""
    out = df
    if query:
        out = out.where(F.contains(F.lower(F.col(text_column)), F.lit(query.lower())))
    if kind and kind_column:
        out = out.where(F.col(kind_column) == kind)
    return out
