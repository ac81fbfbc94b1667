"""Exact de-duplication, label conflicts, connected groups, deterministic roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark import lexicons as lx
from reviewspark.functions import text as tx
from reviewspark.scale import best_per_key, digest, lookup_by_key
from reviewspark.session import cut_lineage

IDENTITY = ["aspect_start", "aspect_end", "opinion_start", "opinion_end", "sentiment", "aspect_category"]


def annotation_identity(a: Column) -> Column:
    return F.struct(*[(tx.canonical_sentiment(a[c]) if c == "sentiment" else a[c]).alias(c) for c in IDENTITY])


def annotation_signature(anns: Column) -> Column:
    """Digest of the sorted annotation identities: equal labels, equal signature."""
    return digest(F.to_json(F.array_sort(F.transform(anns, annotation_identity)), {"ignoreNullFields": "false"}))


def status_rank(status: Column, ranks=None) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (ranks or lx.STATUS_RANK).items() for x in kv]), F.lower(F.coalesce(status, F.lit("pending")))), F.lit(0))


def merge_within_split(records: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Exact duplicates of one split become one record with the union of their annotations.

    Returns (merged, members).  The ids of the merged copies are rows of
    ``members``, not an array: a text that makes up a third of the data would
    otherwise end in a single cell.  Annotations are made distinct per key
    before they are gathered, so the gathered list is as short as one review's.
    """
    keyed = records.withColumn("text_key", digest(key))
    base = best_per_key(keyed, ["split", "text_key"], F.struct("id"))
    identity = keyed.select("split", "text_key", "id", F.posexplode("annotations").alias("pos", "a")).withColumn("k", annotation_identity(F.col("a")))
    distinct = identity.groupBy("split", "text_key", "k").agg(F.min(F.struct("id", "pos")).alias("o"), F.min_by("a", F.struct("id", "pos")).alias("a"))
    lists = distinct.groupBy("split", "text_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "a"))), lambda x: x["a"]).alias("annotations"))
    rejected = F.col("rejected_annotation_count") if "rejected_annotation_count" in records.columns else F.lit(0)
    sums = keyed.groupBy("split", "text_key").agg(F.count(F.lit(1)).alias("merged_duplicate_count"), F.sum(F.coalesce(rejected, F.lit(0))).alias("rejected_annotation_count"))
    empty = F.array().cast(records.schema["annotations"].dataType)
    merged = (
        base.drop("annotations", "rejected_annotation_count").join(sums, ["split", "text_key"]).join(lists, ["split", "text_key"], "left")
        .withColumn("annotations", F.coalesce("annotations", empty))
    )
    return merged, keyed.select("split", "text_key", F.col("id").alias("member_id"))


def keep_best_split(merged: DataFrame, priority=("test", "validation", "train"), key: str = "text_key") -> DataFrame:
    """A text found in several splits stays only in the one with the highest priority."""
    ranks = {s: len(priority) - i for i, s in enumerate(priority)}
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("split")), F.lit(0))
    best = merged.groupBy(key).agg(F.max(rank).alias("_best"))
    return merged.join(best, key).where(rank == F.col("_best")).drop("_best")


def best_by_id(records: DataFrame, ranks=None) -> DataFrame:
    """One record per id: human status, then annotation count, then fewest rejects."""
    order = F.struct(-status_rank(F.col("human_status"), ranks or lx.ID_STATUS_RANK), -F.size("annotations"), F.coalesce("rejected_annotation_count", F.lit(0)), F.col("source_dataset"))
    return best_per_key(records, ["id"], order)


def best_by_text(records: DataFrame) -> DataFrame:
    """One record per normalized text: status, completeness, annotation count, fewest rejects; ``copies`` counts the group."""
    keyed = records.withColumn("text_key", digest(tx.lower_key(F.col("text")))).where(F.trim("text") != "")
    order = F.struct(
        -status_rank(F.col("human_status")), (~F.coalesce("annotation_complete", F.lit(False))).cast("int"), -F.size("annotations"),
        F.coalesce("rejected_annotation_count", F.lit(0)), F.col("id"),
    )
    cols = [c for c in keyed.columns if c != "text_key"]
    out = keyed.groupBy("text_key").agg(F.min_by(F.struct(*cols), order).alias("r"), F.count(F.lit(1)).alias("copies"))
    return out.select("text_key", "copies", "r.*")


def deduplicate_fit(records: DataFrame, min_hot_rows: int = 1_000_000) -> dict[str, DataFrame]:
    """Training de-duplication: kept, aliases, conflicts, provenance.

    Texts whose copies disagree on labels leave as a whole (``conflicts``).  Of
    the others the winner is human before machine, natural before synthetic,
    heavier before lighter, then by source and id.
    """
    keyed = records.withColumns({"raw_exact_sha256": digest(tx.raw_exact_key(F.col("text"))), "_sig": annotation_signature(F.col("annotations"))})
    order = F.struct(
        ~F.coalesce("human_approved", F.lit(False)), F.coalesce("is_synthetic", F.lit(False)), -F.coalesce("sample_weight", F.lit(0.0)), F.col("source_dataset"), F.col("id"),
    )
    groups = keyed.groupBy("raw_exact_sha256").agg(
        F.min("_sig").alias("lo"), F.max("_sig").alias("hi"), F.count(F.lit(1)).alias("copies"), F.min_by("id", order).alias("kept_id"))
    state = groups.select("raw_exact_sha256", "copies", "kept_id", (F.col("lo") != F.col("hi")).alias("conflict"))
    tagged = lookup_by_key(keyed.drop("_sig"), state, "raw_exact_sha256", "copies", "inner", min_rows=min_hot_rows)
    kept = tagged.where(~F.col("conflict") & (F.col("id") == F.col("kept_id")))
    aliases = tagged.where(~F.col("conflict") & (F.col("id") != F.col("kept_id"))).select("kept_id", F.col("id").alias("alias_id"), "source_dataset", "raw_exact_sha256")
    out = {
        "kept": kept.drop("conflict", "kept_id"), "aliases": aliases,
        "conflicts": tagged.where("conflict").select("raw_exact_sha256", F.col("id").alias("record_id"), F.lit("different_annotation_signatures").alias("reason")),
    }
    if "provenance" in records.columns:
        out["provenance"] = tagged.where(~F.col("conflict")).select("kept_id", F.explode("provenance").alias("p")).select("kept_id", F.to_json("p").alias("provenance")).distinct()
    return out


def label_conflicts(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts with differing signatures, their members with signature)."""
    keyed = records.select("id", "split", digest(tx.raw_exact_key(F.col("text"))).alias("raw_exact_sha256"), annotation_signature(F.col("annotations")).alias("signature"))
    texts = keyed.groupBy("raw_exact_sha256").agg(F.min("signature").alias("lo"), F.max("signature").alias("hi"), F.count(F.lit(1)).alias("records")).where("lo <> hi")
    texts = texts.select("raw_exact_sha256", "records")
    return texts, keyed.join(texts.select("raw_exact_sha256"), "raw_exact_sha256", "left_semi")


def deduplicate_templates(records: DataFrame, key: Column | None = None) -> DataFrame:
    """One row per (text key, annotation signature) with its copy count and a template id."""
    keyed = records.withColumns({"template_key": digest(tx.lower_key(F.col("text")) if key is None else key), "_sig": annotation_signature(F.col("annotations"))})
    cols = [c for c in records.columns]
    out = keyed.groupBy("template_key", "_sig").agg(F.min_by(F.struct(*cols), F.col("id")).alias("r"), F.count(F.lit(1)).alias("raw_duplicate_count"))
    return out.select("r.*", "raw_duplicate_count", F.substring(F.sha1(F.concat("template_key", "_sig")), 1, 12).alias("template_id"))


GROUP_FIELDS = ["family_id", "parent_review_id", "translation_parent_id", "template_family_id", "template_key", "group_id"]


def group_keys(records: DataFrame, place_policy: str = "warn") -> DataFrame:
    """(id, kind, key): every key that ties a record to others."""
    def usable(c):
        return F.when(~F.col(c).cast("string").isin("", "nan", "None"), F.col(c).cast("string"))

    fields = [c for c in GROUP_FIELDS if c in records.columns] + (["place_id"] if place_policy == "hard" and "place_id" in records.columns else [])
    pairs = [F.struct(F.lit("raw_exact").alias("kind"), digest(tx.raw_exact_key(F.col("text"))).alias("key"))]
    pairs += [F.when(usable(c).isNotNull(), F.struct(F.lit(c).alias("kind"), usable(c).alias("key"))) for c in fields]
    found = F.filter(F.array(*pairs), lambda p: p.isNotNull())
    return records.select(F.col("id").cast("string").alias("id"), F.explode(found).alias("p")).select("id", "p.kind", "p.key")


def star_edges(keys: DataFrame, min_hot_rows: int = 1_000_000) -> DataFrame:
    """(a, b): each member of a shared key tied to the key's smallest id, never to every other member."""
    named = keys.select("id", F.concat_ws("\u0001", "kind", "key").alias("k"))
    centre = named.groupBy("k").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return lookup_by_key(named, centre, "k", "n", "inner", min_rows=min_hot_rows).where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 200, min_hot_rows: int = 1_000_000) -> DataFrame:
    """(id, root) for every node of the edge list; the root is the smallest id of its component.

    Alternating large-star and small-star steps: every round ties nodes to the
    smallest neighbour, so depth shrinks geometrically.  Each step shuffles the
    edge list only, hot centres are split, and every round ends in a reliable
    checkpoint.  The loop brings two numbers to the driver.
    """
    def state(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        return r["n"], r["h"]

    e = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = state(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "a"))
        large = lookup_by_key(both, low, "a", "n", "inner", min_rows=min_hot_rows).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = lookup_by_key(large, down, "a", "n", "inner", min_rows=min_hot_rows).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut_lineage(small.union(down.select("a", F.col("m").alias("b"))).distinct())
        now = state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(e.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()


def component_roots(records: DataFrame, place_policy: str = "warn", min_hot_rows: int = 1_000_000) -> DataFrame:
    """(id, root) for every record; a record tied to nothing is its own root."""
    roots = connected_components(star_edges(group_keys(records, place_policy), min_hot_rows), min_hot_rows=min_hot_rows)
    ids = records.select(F.col("id").cast("string").alias("id"))
    return ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
