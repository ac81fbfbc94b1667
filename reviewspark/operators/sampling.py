"""Deterministic caps, tune splits, quotas, weighted samplers and class weights.

Random draws are replaced by salted hashes, so a sample depends on the rows and
the seed alone, never on partitioning.  Ranks inside a class go through hash
slices: a class that is a third of the data is not sorted by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewspark import lexicons as lx
from reviewspark.functions import text as tx
from reviewspark.scale import digest, hash_rank, hash_running, small
from reviewspark.session import cut_lineage


def cap_positive(annotations: DataFrame, multiplier: float, key: Column, sentiment: str = "sentiment") -> DataFrame:
    """Keep at most ``multiplier`` positives per non-positive annotation, chosen by hash rank."""
    limit = annotations.agg(
        F.bround(F.lit(float(multiplier)) * F.greatest(F.lit(1), F.count_if(F.col(sentiment).isin("negative", "neutral"))), 0).alias("_limit"))
    ranked = hash_rank(annotations.where(F.col(sentiment) == "positive").withColumn("_g", F.lit(0)), ["_g"], F.sha1(key), "_rank").drop("_g")
    kept = ranked.join(F.broadcast(limit)).where(F.col("_rank") <= F.col("_limit")).drop("_rank", "_limit")
    return annotations.where(~F.col(sentiment).eqNullSafe("positive")).unionByName(kept)


def stable_sample(df: DataFrame, n: int, key: Column, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """The ``n`` rows per group with the smallest salted hash."""
    grouped = df if by else df.withColumn("_g", F.lit(0))
    salted = F.sha1(F.concat(F.lit(f"{seed}::"), key))
    return hash_rank(grouped, list(by) or ["_g"], salted, "_rank").where(F.col("_rank") <= n).drop("_rank", "_g")


def inner_tune(examples: DataFrame, record: str = "record_id", sentiment: str = "sentiment", fraction: float = 0.15, seed: int = 4211,
               floor: int = 50) -> DataFrame:
    """Record-disjoint stratified tune ids with a floor of examples per class.

    The stratum of a record is the sorted set of its labels.  Classes below the
    floor are topped up in hash order, neutral first.
    """
    per = examples.groupBy(record).agg(
        F.array_join(F.sort_array(F.collect_set(sentiment)), "+").alias("stratum"), *[F.count_if(F.col(sentiment) == s).alias(s) for s in lx.SENTIMENTS])
    salted = F.sha1(F.concat(F.lit(f"{seed}::"), F.concat_ws("::", "stratum", record)))
    sizes = per.groupBy("stratum").agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(fraction), 0)).alias("_take"))
    ranked = hash_rank(per, ["stratum"], salted, "_rank").join(F.broadcast(sizes), "stratum")
    state = cut_lineage(ranked.withColumn("in_tune", F.col("_rank") <= F.col("_take")).drop("_rank", "_take"))
    for label in ("neutral", "negative", "positive"):
        have = state.where("in_tune").agg(F.coalesce(F.sum(label), F.lit(0)).alias("_have"))
        order = F.sha1(F.concat(F.lit(f"{seed + 7}::floor::{label}::"), F.col(record)))
        pool = hash_running(state.where(~F.col("in_tune") & (F.col(label) > 0)).withColumn("_g", F.lit(0)), ["_g"], order, label, "_run")
        added = pool.join(F.broadcast(have)).where((F.col("_have") < floor) & (F.col("_have") + F.col("_run") - F.col(label) < floor)).select(record, F.lit(True).alias("_add"))
        state = state.join(added, record, "left").withColumn("in_tune", F.col("in_tune") | F.coalesce("_add", F.lit(False))).drop("_add")
        state = cut_lineage(state)
    return state


def neutral_curriculum(examples: DataFrame, text: str = "marked_context", sentiment: str = "sentiment", positive: str = lx.POSITIVE_CUES, negative: str = lx.NEGATIVE_CUES) -> DataFrame:
    """All neutral rows plus hard anchors; a class without an anchor joins whole."""
    cue = F.col(text).rlike("(?Ui)" + positive) | F.col(text).rlike("(?Ui)" + negative)
    tagged = examples.withColumn("_anchor", F.coalesce("hard_contrast", F.lit(False)) | cue)
    have = tagged.where(F.col(sentiment) != "neutral").groupBy(F.col(sentiment).alias("_s")).agg(F.max(F.col("_anchor").cast("int")).alias("_any"))
    joined = tagged.join(F.broadcast(have), F.col(sentiment) == F.col("_s"), "left")
    return joined.where((F.col(sentiment) == "neutral") | F.col("_anchor") | (F.col("_any") == 0)).drop("_anchor", "_s", "_any")


def largest_remainder(shares: DataFrame, n: str | Column, label: str = "label", prob: str = "prob") -> DataFrame:
    """Integer quotas that add up to n: floors first, the rest by largest remainder, then by label."""
    total = F.col(n) if isinstance(n, str) else n
    raw = shares.withColumn("_raw", total * F.col(prob)).withColumn("_floor", F.floor("_raw"))
    every = W.partitionBy()
    order = W.orderBy(F.round(F.col("_raw") - F.col("_floor"), 12).desc(), F.col(label).desc())
    left = total - F.sum("_floor").over(every)
    return raw.withColumn("quota", (F.col("_floor") + (F.row_number().over(order) <= left).cast("int")).cast("bigint")).drop("_raw", "_floor")


def controlled_sample(examples: DataFrame, target: dict[str, float], key: str = "example_id", seed: int = 42, domain_alpha: float = 0.5,
                      language_alpha: float = 0.7, contrast: float = 1.35) -> DataFrame:
    """One epoch with exact class quotas and tempered domains and languages.

    Rows are drawn without replacement by the key -ln(u)/w.  Only where a class
    is smaller than its quota are rows repeated, in proportion to their weight
    (systematic: each row gets the whole draws its share of the weight covers).
    """
    spark = examples.sparkSession
    probs = spark.createDataFrame(list(target.items()), "sentiment string, prob double")
    n = examples.agg(F.count(F.lit(1)).alias("_n"))
    quotas = largest_remainder(probs.join(F.broadcast(n)), "_n", "sentiment").select("sentiment", "quota")
    pool = examples.groupBy("sentiment", "domain", "language").agg(F.count(F.lit(1)).alias("_c"))
    doms = pool.groupBy("sentiment", "domain").agg(F.sum("_c").alias("_dc"))
    langs = pool.groupBy("sentiment", "language").agg(F.sum("_c").alias("_lc"))
    sizes = pool.groupBy("sentiment").agg(F.sum("_c").alias("_size"))
    w = F.pow(F.col("_dc"), F.lit(domain_alpha - 1)) * F.pow(F.col("_lc"), F.lit(language_alpha - 1)) * F.when(F.col("hard_contrast"), contrast).otherwise(1.0)
    u = tx.hash01(F.concat(F.lit(f"{seed}::"), F.col(key)))
    draw = -F.ln(F.greatest(u, F.lit(1e-15))) / F.col("_w")
    weighted = (
        examples.join(small(doms), ["sentiment", "domain"]).join(small(langs), ["sentiment", "language"])
        .join(small(quotas), "sentiment").join(small(sizes), "sentiment").withColumn("_w", w)
    )
    unit = draw / (1 + draw)
    slot = F.lower(F.lpad(F.hex((unit * F.lit(float(2**52))).cast("bigint")), 14, "0"))
    # 14 hex digits, the first always 0: four more make the slices
    ranked = hash_rank(weighted, ["sentiment"], F.substring(slot, 2, 13), "_rank")
    first = ranked.where(F.col("_rank") <= F.col("quota")).withColumn("draws", F.lit(1).cast("bigint"))
    short = first.where(F.col("quota") > F.col("_size"))
    total = short.groupBy("sentiment").agg(F.sum("_w").alias("_tw"))
    run = hash_running(short, ["sentiment"], F.sha1(F.concat(F.lit(f"{seed}::extra::"), F.col(key))), "_w", "_run").join(F.broadcast(total), "sentiment")
    rest = F.col("quota") - F.col("_size")
    upper = F.least(F.floor(rest * F.round(F.col("_run") / F.col("_tw"), 12)), rest)
    lower = F.floor(rest * F.round((F.col("_run") - F.col("_w")) / F.col("_tw"), 12))
    extra = run.withColumn("draws", F.lit(1) + upper - lower).select(*examples.columns, "draws")
    return first.where(F.col("quota") <= F.col("_size")).select(*examples.columns, "draws").unionByName(extra)


def exposure(sample: DataFrame, by: str = "sentiment") -> DataFrame:
    """Draws and share per class, language or domain of a sample."""
    counts = sample.groupBy(by).agg(F.sum("draws").alias("sampled"), F.count(F.lit(1)).alias("distinct_rows"))
    total = counts.agg(F.sum("sampled").alias("_t"))
    return counts.join(F.broadcast(total)).withColumn("exposure", F.col("sampled") / F.col("_t")).drop("_t")


def warmup_corpus(examples: DataFrame, protected_keys: DataFrame, per_class: int, seed: int = 42) -> DataFrame:
    """Document examples minus protected texts, one per text, capped per class by hash."""
    keyed = examples.withColumn("text_key", digest(tx.leakage_key(F.col("text")))).where(F.trim("text") != "")
    open_ = keyed.join(protected_keys.select("text_key").distinct(), "text_key", "left_anti")
    cols = [c for c in open_.columns if c != "text_key"]
    once = open_.groupBy("text_key").agg(F.min_by(F.struct(*cols), F.col("example_id")).alias("r")).select("text_key", "r.*")
    return stable_sample(once, per_class, F.col("example_id"), ["sentiment"], seed)


def stable_text_subset(texts: DataFrame, n: int, seed: int, key: str = "text_key") -> DataFrame:
    """Distinct texts ranked by a salted hash of their key, the first n of them."""
    once = texts.groupBy(key).agg(F.min("text").alias("text"))
    return stable_sample(once, n, F.col(key), seed=seed)


def mixed_corpus(primary: DataFrame, generic: DataFrame, protected: DataFrame, share: float = 0.70, seed: int = 1011) -> DataFrame:
    """Two text sources mixed at a fixed share without any protected text.

    Inputs carry text and text_key.  The smaller side decides the size; ranks
    are compared with limits computed in the same plan.
    """
    held = protected.select("text_key").distinct()

    def ranked(df, salt):
        once = df.join(held, "text_key", "left_anti").groupBy("text_key").agg(F.min("text").alias("text"))
        return hash_rank(once.withColumn("_g", F.lit(0)), ["_g"], F.sha1(F.concat(F.lit(f"{salt}::"), F.col("text_key"))), "_rank").drop("_g")

    p, g = ranked(primary, seed), ranked(generic, seed + 1)
    sizes = p.agg(F.count(F.lit(1)).alias("np")).join(F.broadcast(g.agg(F.count(F.lit(1)).alias("ng"))))
    want = F.bround(F.col("np") * F.lit((1 - share) / share), 0)
    limits = sizes.select(
        F.when(want > F.col("ng"), F.least(F.col("np"), F.bround(F.col("ng") * F.lit(share / (1 - share)), 0))).otherwise(F.col("np")).alias("lp"),
        F.least(want, F.col("ng")).alias("lg"))
    a = p.join(F.broadcast(limits)).where("_rank <= lp").select("text_key", "text", F.lit("primary").alias("source"))
    b = g.join(F.broadcast(limits)).where("_rank <= lg").select("text_key", "text", F.lit("generic").alias("source"))
    return a.unionByName(b)


def effective_number_weights(examples: DataFrame, label: str, labels: Sequence[str], beta: float = 0.999) -> DataFrame:
    """(1 - beta) / (1 - beta^n), divided by the mean and clipped to [0.5, 3]; unseen labels count as one row."""
    counts = examples.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    dim = examples.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    raw = dim.join(counts, "label", "left").withColumn("n", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)))
    raw = raw.withColumn("_w", (1 - F.lit(beta)) / (1 - F.pow(F.lit(beta), F.col("n"))))
    mean = raw.agg(F.avg("_w").alias("_mean"))
    return raw.join(F.broadcast(mean)).select("label", "n", F.least(F.lit(3.0), F.greatest(F.lit(0.5), F.col("_w") / F.col("_mean"))).alias("weight"))


def balanced_class_weights(rows: DataFrame, label: str, weight: str) -> DataFrame:
    """Sum of all weights over twice the weight of the class."""
    per = rows.groupBy(F.col(label).alias("label")).agg(F.sum(weight).alias("_s"))
    total = per.agg(F.sum("_s").alias("_t"))
    return per.join(F.broadcast(total)).select("label", (F.col("_t") / (2 * F.col("_s"))).alias("class_weight"))


def group_tune_split(rows: DataFrame, key: Column, fraction: float = 0.15, seed: int = 7771) -> DataFrame:
    """Group-disjoint tune split by a salted hash of the group key."""
    u = tx.hash01(F.concat(F.lit(f"{seed}::"), key))
    return rows.withColumn("part", F.when(u < fraction, "tune").otherwise("train"))
