"""Dataset audits, inventories, summaries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark import lexicons as lx
from reviewspark.functions import text as tx
from reviewspark.scale import digest, exact_percentiles


def split_overlaps(df: DataFrame, key: str, split: str = "split", pairs=(("train", "validation"), ("train", "test"), ("validation", "test"))) -> DataFrame:
    """left, right, overlap: number of keys present in both splits of each pair.

    One aggregate over the keys; each key ends as three flags, so a key shared
    by a third of all rows costs no more than any other.
    """
    names = sorted({n for p in pairs for n in p})
    flags = df.groupBy(key).agg(*[F.max((F.col(split) == n).cast("int")).alias(f"in_{n}") for n in names])
    sums = flags.agg(*[F.coalesce(F.sum(F.col(f"in_{a}") * F.col(f"in_{b}")), F.lit(0)).cast("bigint").alias(f"{a}__{b}") for a, b in pairs])
    packed = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{a}__{b}").alias("overlap")) for a, b in pairs])
    return sums.select(F.inline(packed))


def audit_records(records: DataFrame, slots: str = lx.TEMPLATE_SLOTS, stripped: Column | None = None, approved_textless: bool = False) -> DataFrame:
    """One row of counts over review records (text, split, human_status, annotations, ...).

    Rows without text are counted and then leave.  Offsets are checked against
    the stripped text; offset 0 is a valid offset.  ``stripped`` is that text,
    by default without white space around it and blank where it is missing; a
    null leaves without being counted as missing.  ``approved_textless`` counts
    approved rows without text as approved too.
    """
    if stripped is None:
        stripped = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    base = records.withColumn("_t", stripped)
    status = F.lower(F.coalesce(F.col("human_status"), F.lit("")))
    approved = (status == "human_approved") | F.coalesce(F.col("human_approved"), F.lit(False))

    def invalid(a):
        s, e, t = a["aspect_start"], a["aspect_end"], a["aspect_term"]
        given = s.isNotNull() & e.isNotNull() & (F.coalesce(t, F.lit("")) != "")
        return given & ((s < 0) | (e > F.length("_t")) | (F.substring(F.col("_t"), s + 1, e - s) != t))

    scalars = base.agg(
        F.count(F.lit(1)).alias("review_count"), F.count_if(F.col("_t") == "").alias("missing_text_count"),
        F.coalesce(F.sum(F.when(F.col("_t") != "", F.size("annotations"))), F.lit(0)).cast("bigint").alias("annotation_count"),
        F.coalesce(F.sum(F.when(F.col("_t") != "", F.size(F.filter("annotations", invalid)))), F.lit(0)).cast("bigint").alias("invalid_offset_count"),
        F.count_if(approved if approved_textless else (F.col("_t") != "") & approved).alias("human_approved_count"),
    )
    split = F.lower(F.coalesce("split", F.lit("train")))
    keyed = base.where("_t <> ''").select(
        digest(tx.lower_key(F.col("_t"), unicode=False)).alias("k"), split.isin("train", "training").cast("int").alias("tr"),
        split.isin("val", "validation", "test").cast("int").alias("ev"), digest(tx.template_mask(F.col("_t"), slots)).alias("tpl"),
    )
    texts = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("tr").alias("tr"), F.max("ev").alias("ev")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"),
        F.coalesce(F.sum(F.col("tr") * F.col("ev")), F.lit(0)).cast("bigint").alias("split_leakage_count"),
    )
    templates = keyed.select("tpl").distinct().agg(F.count(F.lit(1)).alias("unique_templates"))
    return scalars.join(F.broadcast(texts)).join(F.broadcast(templates)).withColumn("evaluation_eligible_count", F.col("human_approved_count"))


def distribution(df: DataFrame, column: str, top: int | None = None, order: bool = True) -> DataFrame:
    """value, n; the ``top`` most frequent if asked for."""
    out = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if order:
        out = out.orderBy(F.col("n").desc(), "value")
    return out.limit(top) if top else out


def crosstab(df: DataFrame, rows: list[str], column: str, values: list[str]) -> DataFrame:
    """Counts of ``column`` per row key with an ``All`` margin on both sides."""
    counts = [F.count_if(F.col(column) == v).alias(v) for v in values] + [F.count(F.lit(1)).alias("All")]
    body = df.groupBy(*rows).agg(*counts)
    total = body.agg(*[F.sum(c).alias(c) for c in [*values, "All"]]).select(*[F.lit("All").alias(r) for r in rows], *values, "All")
    return body.select(*[F.col(r).cast("string").alias(r) for r in rows], *values, "All").unionByName(total)


def _equals(value: str):
    return lambda s: s == value


def review_summary(records: DataFrame) -> DataFrame:
    """Per domain: reviews, distinct places, observations, implicit ones and class counts."""
    label = F.transform("annotations", lambda a: tx.canonical_sentiment(a["sentiment"]))
    per = records.select(
        "domain", "place_id", F.size("annotations").alias("n"),
        F.size(F.filter("annotations", lambda a: F.coalesce(a["implicit"], F.lit(False)))).alias("imp"),
        *[F.size(F.filter(label, _equals(v))).alias(v) for v in lx.SENTIMENTS],
    )
    return per.groupBy("domain").agg(
        F.count(F.lit(1)).alias("reviews"), F.countDistinct("place_id").alias("places"), F.sum("n").alias("observations"),
        F.sum("imp").alias("implicit_observations"), *[F.sum(v).alias(v) for v in lx.SENTIMENTS],
    )


def source_composition(examples: DataFrame, source: str = "source_dataset") -> DataFrame:
    """Rows, classes, mean and effective weight of each training source."""
    return examples.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("sentiment") == s).alias(s) for s in lx.SENTIMENTS],
        F.avg("sample_weight").alias("mean_weight"), F.sum("sample_weight").alias("effective_weight"),
    )


def observation_stats(records: DataFrame, by: list[str]) -> DataFrame:
    """Reviews, observations, explicit and implicit counts."""
    exp = F.size(F.filter("annotations", lambda a: a["aspect_start"].isNotNull()))
    imp = F.size(F.filter("annotations", lambda a: F.coalesce(a["implicit"], F.lit(False)) | a["aspect_start"].isNull()))
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("review_count"), F.sum(F.size("annotations")).alias("observation_count"),
        F.sum(exp).alias("explicit"), F.sum(imp).alias("implicit"),
    )


def split_report(df: DataFrame, split: str, key: str, place: str) -> DataFrame:
    return df.groupBy(split).agg(F.count(key).alias("review_count"), F.countDistinct(place).alias("unique_places"))


def latency_summary(rows: DataFrame, latency: str, elapsed_ms: float | None = None, status: str = "processing_status") -> DataFrame:
    """Mean, median, p95, p99, extremes and throughput of the successful rows."""
    ok = rows.where(F.col(status) == "success")
    flat = ok.agg(
        F.round(F.avg(latency), 3).alias("average_latency_ms"), F.round(F.min(latency), 3).alias("min_latency_ms"),
        F.round(F.max(latency), 3).alias("max_latency_ms"), F.count(F.lit(1)).alias("successful_rows"), F.sum(latency).alias("_sum"),
    )
    pct = exact_percentiles(ok, latency, [0.5, 0.95, 0.99]).groupBy().agg(
        *[F.round(F.max(F.when(F.abs(F.col("p") - p) < 1e-9, F.col("value"))), 3).alias(n)
          for p, n in ((0.5, "median_latency_ms"), (0.95, "p95_latency_ms"), (0.99, "p99_latency_ms"))]
    )
    spent = F.lit(float(elapsed_ms)) if elapsed_ms is not None else F.col("_sum")
    return flat.join(F.broadcast(pct)).withColumn(
        "throughput_rows_per_second", F.when(spent > 0, F.round(F.col("successful_rows") / (spent / 1000), 3)).otherwise(0.0)
    ).drop("_sum")


def progress(rows: DataFrame, total: int | Column, elapsed_ms: float, status: str = "processing_status") -> DataFrame:
    """Counters by outcome, percentage done, throughput and remaining time."""
    total = F.lit(total) if isinstance(total, int) else total
    done = rows.agg(
        F.count(F.lit(1)).alias("processed_rows"), F.count_if(F.col(status) == "success").alias("successful_rows"),
        F.count_if(F.col(status) == "model_error").alias("failed_rows"),
        F.count_if(F.col(status).isin("empty_review", "invalid_input")).alias("skipped_rows"),
    )
    rate = F.col("processed_rows") / F.lit(elapsed_ms / 1000)
    return done.withColumns({
        "percentage": F.when(total > 0, F.round(F.col("processed_rows") / total * 100, 2)).otherwise(0.0),
        "throughput_rows_per_second": F.round(rate, 3),
        "estimated_remaining_ms": F.when(rate > 0, F.round((total - F.col("processed_rows")) / rate * 1000, 3)),
    })


def class_exposure(annotations: DataFrame, sentiment: str = "sentiment") -> DataFrame:
    """Share of each class in percent, out of the three-class observations."""
    counts = annotations.agg(*[F.count_if(F.lower(F.col(sentiment)) == s).alias(s) for s in lx.SENTIMENTS])
    total = sum((F.col(s) for s in lx.SENTIMENTS), F.lit(0))
    return counts.select(*[F.round(F.col(s) / F.greatest(total, F.lit(1)) * 100, 2).alias(s) for s in lx.SENTIMENTS])


def unique_templates(records: DataFrame, chars: int = 40) -> DataFrame:
    return records.agg(F.countDistinct(F.substring("text", 1, chars)).alias("unique_templates"))


def template_audit(raw: DataFrame, deduplicated: DataFrame) -> DataFrame:
    """Raw rows, unique texts, effective templates and duplicate rate of a synthetic source."""
    a = raw.agg(F.count(F.lit(1)).alias("raw_rows"), F.countDistinct(digest(tx.lower_key(F.col("text")))).alias("unique_normalized_texts"))
    b = deduplicated.agg(F.count(F.lit(1)).alias("effective_template_records"))
    return a.join(F.broadcast(b)).withColumns({
        "raw_duplicate_rows": F.col("raw_rows") - F.col("effective_template_records"),
        "duplicate_rate": F.when(F.col("raw_rows") > 0, 1 - F.col("effective_template_records") / F.col("raw_rows")).otherwise(0.0),
    })


def checks(named: dict[str, tuple[DataFrame, object]]) -> DataFrame:
    """(check, value, limit, pass) from one-value frames: a value above its limit fails; no limit means a count only."""
    out = None
    for name, (frame, limit) in named.items():
        value = frame.select(F.col(frame.columns[0]).cast("double").alias("value"))
        row = value.select(F.lit(name).alias("check"), "value", F.lit(limit).cast("double").alias("limit"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("pass", F.col("limit").isNull() | (F.col("value") <= F.col("limit")))


def declared_vs_observed(declared: DataFrame, observed: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """Full outer comparison of two small metric tables."""
    d = declared.select(key, F.col(value).alias("declared"))
    o = observed.select(key, F.col(value).alias("observed"))
    return d.join(o, key, "full_outer").withColumn("match", F.col("declared").eqNullSafe(F.col("observed")))


def ablation_matrix(experiments: DataFrame, reports: DataFrame, paths: dict[str, str], key: str = "experiment_id", payload: str = "report") -> DataFrame:
    """Completed experiments with the metrics of their JSON report, null where there is none."""
    joined = experiments.where("status = 'completed'").join(reports.select(key, payload), key, "left")
    return joined.withColumns({n: F.expr(f"try_cast(get_json_object({payload}, '{p}') as double)") for n, p in paths.items()}).drop(payload)


def benchmark_rollup(runs: DataFrame, keys: list[str], latency: str) -> DataFrame:
    """Mean and nearest-rank percentiles of repeated benchmark iterations."""
    mean = runs.groupBy(*keys).agg(F.avg(latency).alias("mean"), F.count(F.lit(1)).alias("iterations"))
    pct = exact_percentiles(runs, latency, [0.5, 0.95, 0.99], keys, method="nearest").groupBy(*keys).agg(
        *[F.max(F.when(F.abs(F.col("p") - p) < 1e-9, F.col("value"))).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])
    return mean.join(pct, keys)


def inventory(examples: DataFrame, keys=("source_dataset", "domain", "sentiment")) -> DataFrame:
    return examples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def place_conflicts(records: DataFrame, place: str = "place_id", split: str = "split") -> DataFrame:
    """Places whose reviews sit in more than one split."""
    return records.groupBy(place).agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"), F.count(F.lit(1)).alias("records")).where(
        "first_split <> last_split"
    )
