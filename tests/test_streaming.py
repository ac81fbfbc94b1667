"""Arriving files: progress is exact after a crash in the middle of a batch."""

import pytest
from pyspark.sql import functions as F

from reviewspark.operators.enrich import Gazetteer
from reviewspark.streaming import arrivals


def test_progress_after_a_crash(spark, tmp_path, monkeypatch):
    """A batch that fails between its output and its end is repeated; its rows count once."""
    source = tmp_path / "in"
    source.mkdir()
    for i in range(4):
        (source / f"{i}.csv").write_text("review,id\n" + "".join(f"nasi enak {i} {k},{i * 10 + k}\n" for k in range(5)) + " ,99\n")
    empty = spark.createDataFrame([], "alias string, province string, city string")
    try:
        gazetteer = Gazetteer(*__import__("reviewspark.lexicons", fromlist=["x"]).region_dims(spark))
    except TypeError:
        gazetteer = Gazetteer(empty, empty)

    def start():
        rows = arrivals.arriving_reviews(spark, str(source), "review string, id string", 1)
        return arrivals.score_arrivals_counted(
            rows, gazetteer, str(tmp_path / "out"), str(tmp_path / "progress"), str(tmp_path / "check"), "q", fuzzy=False)

    calls, real = [], arrivals.score_rows

    def failing(frame, *args, **options):
        calls.append(1)
        scored = real(frame, *args, **options)
        if len(calls) == 3:  # some rows of the third batch are written before it fails
            return scored.withColumn("x", F.when(F.col("review").contains("nasi"), F.raise_error(F.lit("lost"))).otherwise(1))
        return scored

    monkeypatch.setattr(arrivals, "score_rows", failing)
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    assert arrivals.read_progress(spark, str(tmp_path / "progress")).first()["processed_rows"] == 12
    start().awaitTermination()
    start().awaitTermination()  # nothing new has arrived
    total = arrivals.read_progress(spark, str(tmp_path / "progress")).first()
    assert (total["query"], total["batches"], total["processed_rows"], total["successful_rows"], total["failed_rows"]) == ("q", 4, 24, 20, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 24 and total["rows_per_second"] > 0
