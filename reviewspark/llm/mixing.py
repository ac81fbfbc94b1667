"""Mixing sources to target weights by weighted sampling without replacement.

Every source gets a token budget. Complete epochs of the source come first; the rest of the budget is
filled by Efraimidis-Spirakis sampling: a document draws the exponential key ``-ln(u) / weight``, the
source is ordered by key and its prefix sum is followed up to the budget. The prefix is a threshold on
the key, so a document's decision needs only its own key and its source's row of the plan: texts are
never shuffled and a hot source is not gathered. Only the one slice of keys that holds the threshold
is ordered.

Defined results: null and blank texts have size 0 and are taken 0 words; a null source is a source of
its own and comes last; rows of one id and text share a key and are interchangeable, and where the budget
ends among them as many of them are taken as come nearest to it; a document without a label has a weight of
its own; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewspark.llm.common import SMALL_KEYS, WORD, stored
from reviewspark.scale import small

MAX_EPOCHS = 3
#: Weight of documents labelled good and bad, and of those without a label.
LABEL_WEIGHTS = {1: 1.0, 0: 0.1}
UNLABELLED = 0.5


def labelled_weight(label: Column) -> Column:
    """Weight of a document in the draw by its quality label; several labels count as the best of them."""
    out = F.lit(UNLABELLED)
    for value, weight in LABEL_WEIGHTS.items():
        out = F.when(label == value, weight).otherwise(out)
    return out


def with_quality(docs: DataFrame, labels: DataFrame, name: str, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """``docs`` with the quality label of every document in ``name``; labels are broadcast up to a checked size."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_labelled")).agg(F.max(label).alias(name))
    return docs.join(small(known, SMALL_KEYS), docs[doc_id] == F.col("_labelled"), "left").drop("_labelled")


def uniform(identity: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of ``identity``."""
    bits = F.conv(F.substring(F.md5(identity), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def group_key(source: Column) -> Column:
    """Source names in code point order, null last and joinable."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def draw_key(docs: DataFrame, doc_id: str, text: str, weight: Column | None) -> Column:
    """The exponential key of a document, scaled by its weight. Rows of one id and text share it."""
    identity = F.concat(F.coalesce(docs[doc_id].cast("string"), F.lit("")), F.lit(":"), F.coalesce(docs[text].cast("string"), F.lit("")))
    return -F.log(uniform(identity)) / (F.lit(1.0) if weight is None else weight)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None) -> DataFrame:
    """(doc_id, gkey, size, draw): size in words and the exponential key of every document."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(
        docs[doc_id].alias("doc_id"), group_key(docs[source]).alias("gkey"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        draw_key(docs, doc_id, text, weight).alias("draw"))


def source_targets(sizes: DataFrame, cycle: int = 3, most: int = MAX_EPOCHS) -> DataFrame:
    """(gkey, source_size, target) from (gkey, source_size): weights 1..cycle in name order.

    All words are shared by weight; a source gets at most ``most`` times its size and what it cannot
    take is shared again among the others. The level at which this settles is found in one pass over
    the sources in the order of their cap per weight.
    """
    everything = W.partitionBy()
    named = sizes.withColumn("w", (F.row_number().over(W.orderBy("gkey")) - 1) % cycle + 1).withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("w"), "gkey")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    leveled = named.withColumn("level", level)
    # the first source whose cap lies above its level fixes the level of all from there on
    free = F.min(F.when(F.col("cap") > F.col("w") * F.col("level"), F.struct((F.col("cap") / F.col("w")).alias("r"), "gkey", "level"))).over(everything)
    return leveled.withColumn("free", free["level"]).select(
        "gkey", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * F.col("free"), F.col("cap").cast("double"))).alias("target"))


def source_plan(narrow: DataFrame, cycle: int = 3, most: int = MAX_EPOCHS) -> DataFrame:
    """(gkey, source_size, target, epochs, cut, part, rows): complete epochs, then all keys below ``cut`` and ``part`` of the ``rows`` that have it."""
    # keys are cut by their logarithm: fine slices whatever the weights of a source are
    sliced = narrow.withColumn("cell", F.floor(F.log2("draw") * 256))
    cells = stored(sliced.groupBy("gkey", "cell").agg(F.sum("size").alias("words")), "mix-cells")
    targets = source_targets(cells.groupBy("gkey").agg(F.sum("words").alias("source_size")), cycle, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    running = cells.withColumn("upto", F.sum("words").over(W.partitionBy("gkey").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)))
    running = running.join(plan.select("gkey", "rest"), "gkey")
    crossing = running.where(F.col("upto") >= F.col("rest")).groupBy("gkey").agg(
        F.min_by(F.struct("cell", (F.col("upto") - F.col("words")).alias("base"), "rest"), F.col("cell")).alias("c")).select("gkey", "c.*")
    inside = sliced.join(small(crossing), ["gkey", "cell"])
    # rows of one key are one document repeated; of a prefix's last key some rows may be in and others not
    keys = inside.groupBy("gkey", "draw", "base", "rest").agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("each"))
    words = F.col("rows") * F.col("each")
    keys = keys.withColumn("before", F.col("base") + F.sum(words).over(W.partitionBy("gkey").orderBy("draw").rowsBetween(W.unboundedPreceding, W.currentRow)) - words)
    fits = F.when(F.col("each") > 0, F.greatest(F.lit(0), F.least("rows", F.floor((F.col("rest") - F.col("before")) / F.col("each"))))).otherwise(F.col("rows"))
    tried = keys.withColumn("part", F.explode(F.array_distinct(F.array(fits, F.least("rows", fits + 1)))))
    miss = F.abs(F.col("before") + F.col("part") * F.col("each") - F.col("rest"))
    near = tried.groupBy("gkey").agg(F.min_by(F.struct("draw", "part", "rows"), F.struct(miss, "draw", "part")).alias("b"))
    near = near.select("gkey", F.col("b.draw").alias("cut"), F.col("b.part").alias("part"), F.col("b.rows").alias("rows"))
    return plan.join(near, "gkey", "left").select("gkey", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), "cut", "part", "rows")


def numbered_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``_no``: 1, 2, ... for the rows of each of ``keys``, counted per partition and shifted by what is before: no sort, no one task."""
    placed = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    # a window per 65,536 rows of a partition
    placed = stored(placed.withColumn("_slot", F.shiftright(F.pmod(F.col("_id"), F.lit(1 << 33)), 16)), "mix-lump")
    sizes = placed.groupBy(*keys, "_part", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part", "_slot").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = W.partitionBy(*keys, "_part", "_slot").orderBy("_id")
    placed = placed.withColumn("_in", F.row_number().over(inside))
    return placed.join(sizes.drop("_n"), [*keys, "_part", "_slot"]).withColumn("_no", F.col("_before") + F.col("_in")).drop(
        "_id", "_part", "_slot", "_in", "_before")


def taken_times(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """``keyed`` (gkey, draw, ...) with ``copies``, how often a row is taken, and the columns of its source's plan.

    Rows of a key that is cut within are numbered; all others are decided where they stand.
    """
    sources = small(plan)
    here = keyed.join(sources, "gkey")
    once = F.coalesce((F.col("draw") < F.col("cut")) | ((F.col("draw") == F.col("cut")) & (F.col("part") == F.col("rows"))), F.lit(False))
    if plan.where("part > 0 AND part < rows").isEmpty():
        return here.withColumn("copies", F.col("epochs") + once.cast("long"))
    within = F.coalesce((F.col("draw") == F.col("cut")) & (F.col("part") > 0) & (F.col("part") < F.col("rows")), F.lit(False))
    lump = numbered_rows(here.where(within), ["gkey"]).withColumn("copies", F.col("epochs") + (F.col("_no") <= F.col("part")).cast("long")).drop("_no")
    return here.where(~within).withColumn("copies", F.col("epochs") + once.cast("long")).unionByName(lump)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None,
        cycle: int = 3, most: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken and copies. ``weight``: a column of ``docs``."""
    narrow = stored(measured(docs, doc_id, text, source, weight), "mix-sizes")
    plan = stored(source_plan(narrow, cycle, most), "mix-plan")
    return taken_times(narrow, plan).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None,
                    cycle: int = 3, most: int = MAX_EPOCHS, columns: list[str] | None = None) -> DataFrame:
    """The mix itself: ``columns`` (all) of the rows of ``docs``, each as often as it is taken. Texts are not shuffled."""
    plan = stored(source_plan(stored(measured(docs, doc_id, text, source, weight), "mix-sizes"), cycle, most), "mix-plan")
    packed = docs.select(
        F.struct(*[docs[c] for c in columns or docs.columns]).alias("row"), group_key(docs[source]).alias("gkey"), draw_key(docs, doc_id, text, weight).alias("draw"))
    repeated = taken_times(packed, plan).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return repeated.select("row.*")
