"""Shuffle-aware building blocks shared by the operators.

Every helper here answers one question: what happens when a single key holds a
third of all rows?  None of them collects a group into one task, and a
broadcast is only asked for after the side's size has been checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewspark.session import cut_lineage

BROADCAST_ROWS = 200_000
HOT_KEY_ROWS = 1_000_000
HOT_KEY_LIMIT = 1_000


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it is proven to hold at most ``max_rows`` rows.

    The probe reads at most ``max_rows + 1`` rows.  Above the bound the frame is
    returned unhinted and the join shuffles on its keys.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy row work when the input has fewer splits than cores.

    A no-op on a large table, whose scan already has far more splits than cores:
    its text is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn``; lambdas have no common-subexpression elimination."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with costly ``columns`` that are worked out once per row, where the row then is.

    A filter, also the one that ``explode`` implies, is moved below a projection and there works out for itself
    whatever it tests: the columns again, and on the scan's few splits where a repartition comes in between.
    No filter on a generated column is moved below its generator.
    """
    made = F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], made).select(*dict.fromkeys([*df.columns, *columns]))


def lower_bound(points: Column, value: Column) -> Column:
    """How many of the ascending ``points`` are below ``value``, by halving."""
    def step(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        less = (acc["lo"] < acc["hi"]) & (F.get(points, mid) < value)
        return F.struct(F.when(less, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(less, acc["hi"]).otherwise(F.when(acc["lo"] < acc["hi"], mid).otherwise(acc["hi"])).alias("hi"))

    steps = F.array_repeat(F.lit(0), F.ceil(F.log2(F.size(points) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(points).alias("hi")), step)["lo"]


def best_per_key(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the one with the smallest ``order`` struct.

    An aggregate with map-side combine replaces ``row_number() = 1``: a hot key
    is reduced to one candidate per input partition before the shuffle.
    """
    columns = [c for c in (columns or df.columns) if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_best"))
    return picked.select(*keys, *[F.col("_best")[c].alias(c) for c in columns])


def hash_rank(df: DataFrame, keys: Sequence[str], digest: Column, out: str = "rank", prefix: int = 4) -> DataFrame:
    """Exact 1-based rank of each row by a hex digest inside its key group.

    A plain ``row_number`` over the key would sort a hot class in one task.
    Here the leading hex digits cut every group into ``16**prefix`` slices:
    slice sizes are counted with map-side combine, their running sum (at most
    ``16**prefix`` rows per key) gives each slice an offset, and only the rows
    inside one slice are sorted together.
    """
    sliced = df.withColumn("_digest", digest).withColumn("_slice", F.substring("_digest", 1, prefix))
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*keys, "_slice").orderBy("_digest", *_tie_columns(df, keys))
    ranked = sliced.withColumn("_in_slice", F.row_number().over(inside))
    return (
        _null_safe_join(ranked, offsets, [*keys, "_slice"])
        .withColumn(out, F.col("_offset") + F.col("_in_slice"))
        .drop("_digest", "_slice", "_offset", "_in_slice")
    )


def _tie_columns(df: DataFrame, keys: Sequence[str]) -> list[str]:
    simple = {"string", "bigint", "int", "double", "boolean", "timestamp", "date", "float"}
    return [n for n, t in df.dtypes if t in simple and n not in keys]


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, "inner").drop(*[f"_r_{k}" for k in keys])


def hot_keys(counts: DataFrame, key: str, size: str, min_rows: int = HOT_KEY_ROWS, limit: int = HOT_KEY_LIMIT) -> DataFrame:
    """The heaviest keys, at most ``limit`` of them, so the result is always broadcastable.

    Keys beyond the limit are not lost: they are merely joined without salt.
    """
    return counts.where(F.col(size) >= min_rows).orderBy(F.col(size).desc(), key).limit(limit).select(key)


def lookup_by_key(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    size: str,
    how: str = "left",
    salts: int = 64,
    min_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Attach one ``dim`` row per key to every fact row, splitting the hot keys.

    ``dim`` is unique on ``key`` and carries the number of fact rows in
    ``size``.  Rows of a hot key are spread over ``salts`` reducers and that
    key's single ``dim`` row is repeated as often; all other keys stay unsalted.
    """
    hot = F.broadcast(hot_keys(dim, key, size, min_rows).withColumn("_hot", F.lit(True)))
    row_hash = F.pmod(F.xxhash64(*[F.col(c) for c, t in facts.dtypes if not t.startswith("map")]), F.lit(salts))
    left = facts.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), row_hash).otherwise(F.lit(0)).cast("int"))
    right = (
        dim.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )
    return left.drop("_hot").join(right, [key, "_salt"], how).drop("_salt")


def distinct_keys(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct values; an aggregate, so repeats collapse before the shuffle."""
    return df.select(*cols).distinct()


def value_slices(values: DataFrame, keys: Sequence[str], slices: int) -> DataFrame:
    """``values`` (keys, _v, _c) with ``_n``, the rows of the key, and ``_s``, the slice of the value.

    The cut points between slices are quantiles of a sketch of the distinct values, of bounded size per key, so
    slices hold about equally many values however these are spread; an outlier is just the last value of its slice.
    """
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = values.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", shares, F.lit(20 * slices))).alias("_cuts"), F.sum("_c").alias("_n"))
    return values.join(small(cut_lineage(cuts)), keys).withColumn("_s", lower_bound(F.col("_cuts"), F.col("_v"))).drop("_cuts")


def exact_percentiles(df: DataFrame, value: str, fractions: Sequence[float], keys: Sequence[str] = (), slices: int = 256,
                      method: str = "linear") -> DataFrame:
    """Exact percentiles per key without gathering a group in one task.

    Equal values are counted first, which is the only scan of ``df``. Sketched quantiles cut the values of each key
    into slices; slice counts locate the slice that holds a wanted rank, and only the
    distinct values of those slices are ordered.  ``linear`` interpolates between
    neighbours, ``nearest`` picks the value at ``round((n - 1) * p)``.
    """
    keys = list(keys) or ["_all"]
    base = df if keys != ["_all"] else df.withColumn("_all", F.lit(0))
    counted = base.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    sliced = cut_lineage(value_slices(cut_lineage(counted), keys, slices))
    stats = sliced.groupBy(*keys).agg(F.first("_n").alias("_n"))
    per_slice = sliced.groupBy(*keys, "_s").agg(F.sum("_c").alias("_sc"))
    before = W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    bounds = per_slice.withColumn("_from", F.coalesce(F.sum("_sc").over(before), F.lit(0)))
    wanted = F.array(*[F.lit(float(p)) for p in fractions])
    position = (F.col("_n") - 1) * F.col("p")
    # half-even, as the nearest-rank roll-up asks for
    lower = F.floor(position) if method == "linear" else F.bround(position, 0).cast("bigint")
    upper = F.ceil(position) if method == "linear" else lower
    targets = stats.select(*keys, "_n", F.explode(wanted).alias("p")).withColumn("_ranks", F.array_distinct(F.array(lower, upper)))
    targets = targets.withColumn("_rank", F.explode("_ranks")).drop("_ranks")
    located = targets.join(bounds.select(*keys, "_s", "_from", "_sc"), keys).where(
        (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_sc"))
    )
    inside = W.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    hot = sliced.join(located.select(*keys, "_s", "_from").distinct(), [*keys, "_s"])
    ordered = hot.withColumn("_end", F.col("_from") + F.sum("_c").over(inside)).withColumn("_start", F.col("_end") - F.col("_c"))
    found = located.select(*keys, "_s", "p", "_rank", "_n").join(ordered.select(*keys, "_s", "_v", "_start", "_end"), [*keys, "_s"]).where(
        (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end"))
    )
    both = found.groupBy(*keys, "p", "_n").agg(F.min_by("_v", "_rank").alias("_a"), F.max_by("_v", "_rank").alias("_b"))
    share = position - F.floor(position)
    out = both.withColumn("value", F.col("_a") + (F.col("_b") - F.col("_a")) * share if method == "linear" else F.col("_a"))
    return out.select(*[k for k in keys if k != "_all"], "p", "value")


def digest(text: Column) -> Column:
    """64 hex digits in place of a long text key: what a shuffle carries."""
    return F.sha2(text, 256)


def hash_running(df: DataFrame, keys: Sequence[str], digest_: Column, measure: str, out: str = "running", prefix: int = 4) -> DataFrame:
    """Exact running sum of ``measure`` (own row included) in digest order inside each key, in slices."""
    sliced = df.withColumn("_digest", digest_).withColumn("_slice", F.substring("_digest", 1, prefix))
    sizes = sliced.groupBy(*keys, "_slice").agg(F.sum(measure).alias("_m"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*keys, "_slice").orderBy("_digest", *_tie_columns(df, keys)).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = sliced.withColumn("_in", F.sum(measure).over(inside))
    return _null_safe_join(ranked, offsets, [*keys, "_slice"]).withColumn(out, F.col("_offset") + F.col("_in")).drop(
        "_digest", "_slice", "_offset", "_in")


def running_over_scores(points: DataFrame, score: str, measures: Sequence[str], keys: Sequence[str] = (), slices: int = 4096) -> DataFrame:
    """Running sums from the highest score down over one row per distinct score in [0, 1]."""
    keys = list(keys) or ["_all"]
    base = points if keys != ["_all"] else points.withColumn("_all", F.lit(0))
    sliced = base.withColumn("_s", -F.floor(F.col(score) * (slices - 1)).cast("int"))
    sums = sliced.groupBy(*keys, "_s").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    before = W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_s", *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures])
    inside = W.partitionBy(*keys, "_s").orderBy(F.col(score).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = sliced.select("*", *[F.sum(m).over(inside).alias(f"_i_{m}") for m in measures])
    out = run.join(offsets, [*keys, "_s"])
    out = out.withColumns({f"run_{m}": F.col(f"_o_{m}") + F.col(f"_i_{m}") for m in measures})
    return out.drop("_s", "_all", *[f"_{k}_{m}" for k in "oi" for m in measures])


def global_positions(df: DataFrame, order: Sequence[str], out: str = "position", first: int = 1) -> DataFrame:
    """Exact place of every row in the total order of ``order``, which should be unique.

    A range exchange puts ascending slices into partitions, each sorted for itself; the sizes of the partitions,
    one number each, are the only thing that is looked at together.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = cut_lineage(dealt).withColumn("_part", F.shiftright("_id", 33))
    offsets, at = [], first
    for r in sorted(placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((r["_part"], at))
        at += r["n"]
    known = spark.createDataFrame(offsets, "_part long, _offset long")
    return placed.join(F.broadcast(known), "_part").withColumn(out, F.col("_offset") + F.pmod(F.col("_id"), F.lit(1 << 33))).drop("_part", "_id", "_offset")
