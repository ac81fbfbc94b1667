"""Batch of review rows to scored rows: status, enrichment, tuples, summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.operators import contract as ct
from reviewspark.operators import sentiment as se
from reviewspark.operators.enrich import Gazetteer, enrich

Scorer = Callable[[DataFrame, str], DataFrame]
TUPLES = se.TUPLE


def rule_scorer(df: DataFrame, text: str) -> DataFrame:
    """Adds ``tuples``: the rule engine, row by row."""
    return df.withColumn("tuples", se.rule_tuples(F.col(text)))


def table_scorer(scored: DataFrame, key: str) -> Scorer:
    """Tuples from a pre-scored table (key, tuples[]) of any model."""
    def score(df: DataFrame, _text: str) -> DataFrame:
        return df.join(scored.select(key, "tuples"), key, "left").withColumn("tuples", F.coalesce("tuples", F.array().cast(f"array<{TUPLES}>")))

    return score


SCORERS: dict[str, Scorer] = {"rules": rule_scorer}


def register_scorer(name: str, scorer: Scorer) -> None:
    """Make another engine selectable by name."""
    SCORERS[name] = scorer


def score_rows(rows: DataFrame, gazetteer: Gazetteer, engine: str = "rules", max_chars: int = 10_000, failed=None, empty=None, **options) -> DataFrame:
    """The whole batch in one pass: row_number, original_fields and roles in, one scored row out.

    Rows that cannot be scored keep their status and an empty result; nothing
    is dropped and the order column stays with the row.  A row for which
    ``failed`` holds becomes a model error without failing its task. ``empty``
    tells the empty rows, by default those of a blank review.
    """
    staged = ct.row_status(rows, max_chars, failed, empty)
    ok = F.col("processing_status") == "success"
    raw = F.trim(F.coalesce("review", F.lit("")))
    staged = staged.withColumn("raw_review", raw).withColumn("_use", F.when(ok, raw).otherwise(""))
    rich = enrich(staged, gazetteer, "_use", **options)
    scored = SCORERS[engine](rich, "clean_review")
    empty = F.array().cast(f"array<{TUPLES}>")
    return scored.withColumns({
        "aspects": F.when(ok, F.col("tuples")).otherwise(empty), "clean_review": F.when(ok, F.col("clean_review")).when(F.col("processing_status") == "empty_review", "").otherwise(F.col("raw_review")),
        "warnings": F.when(ok, F.col("warnings")).otherwise(F.col("row_warnings")), "customer_class": F.when(ok, F.col("customer.customer_class")),
        "resolved_customer_id": F.when(ok, F.col("customer.customer_id")), "city_or_regency": F.when(ok, F.col("location.city_or_regency")),
        "resolved_province": F.when(ok, F.col("location.province")), "location_status": F.when(ok, F.col("location.status")),
        "location_confidence": F.when(ok, F.col("location.confidence")), "model_version": F.lit(engine)}).drop("_use", "tuples", "row_warnings")


def outcome_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("processing_status").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("aspects")).alias("tuples"))
