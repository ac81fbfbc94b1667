"""Exact deduplication by content-defined chunk recipes.

Every text is cut into chunks at places its own content decides: a chunk ends at the first sentence or
line end after ``MIN_CHUNK`` characters, or after ``MAX_CHUNK`` characters. Distinct chunks get a
128-bit identifier that is verified (one identifier, one chunk text); a text is then its recipe, the
ordered list of identifiers, and texts are compared by their recipes. Long documents move through a
shuffle once per distinct chunk, not once per comparison, and a copied document moves nothing twice.

Defined results: a null text counts as empty; the empty text has an empty recipe and all empty texts
are one group; a null ``doc_id`` is smaller than any other; of rows that repeat both ``doc_id`` and
text exactly one stays; an empty table gives an empty table; columns beside the key and the text are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.llm.common import stored
from reviewspark.scale import lookup_by_key

MIN_CHUNK, MAX_CHUNK = 256, 4096


def chunks(text: Column, low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> Column:
    """Content-defined chunks, in order; together they are the text."""
    cut = rf"(?s).{{{low},{high}}}?(?:(?<=[.!?\n])|\z)|.{{{low},{high}}}|.+"
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(cut), F.lit(0)))


def chunk_id(chunk: Column) -> Column:
    """128 bits: two independent 64-bit hashes of the chunk."""
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(7), chunk).alias("b"))


def dictionary(docs: DataFrame, text: Column, identify=chunk_id) -> DataFrame:
    """Distinct chunks with identifiers: (id, chunk). A repeat is dropped before the shuffle."""
    return docs.select(F.explode(chunks(text)).alias("chunk")).select(identify(F.col("chunk")).alias("id"), "chunk").distinct()


def ambiguous_ids(dictionary_: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk text: the verification."""
    return dictionary_.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")


def recipes(docs: DataFrame, key: Column, text: Column, identify=chunk_id) -> DataFrame:
    """(doc_id, recipe, text_sha256): the narrow table that stands for the texts from here on."""
    return docs.select(
        key.alias("doc_id"), F.transform(chunks(text), identify).alias("recipe"), F.sha2(text, 256).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", identify=chunk_id, min_hot_rows: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, group_rows.

    The row with the largest ``doc_id`` of each group of equal texts stays. ``group_rows`` counts the
    rows that share both ``doc_id`` and text. ``identify`` is the chunk hash (a parameter for tests).
    """
    value = F.coalesce(docs[text].cast("string"), F.lit(""))
    narrow = stored(recipes(docs, docs[doc_id], value, identify), "recipes")
    bad = stored(ambiguous_ids(dictionary(docs, value, identify)), "ambiguous-chunks")
    if not bad.isEmpty():
        # an identifier stands for two chunks: texts that use it are told apart by their digest too
        hit = narrow.select("recipe", "text_sha256", F.explode("recipe").alias("id")).join(bad, "id", "left_semi")
        hit = hit.select("recipe", "text_sha256").distinct().withColumn("extra", F.col("text_sha256"))
        narrow = narrow.join(hit, ["recipe", "text_sha256"], "left").fillna("", ["extra"])
    else:
        narrow = narrow.withColumn("extra", F.lit(""))
    same = narrow.groupBy("recipe", "extra", "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.first("text_sha256").alias("sha"))
    groups = same.groupBy("recipe", "extra").agg(
        F.sum("rows").alias("group_size"), F.max("doc_id").alias("keep_id"), F.max_by("rows", F.struct("doc_id")).alias("keep_rows"))
    groups = groups.select(F.struct("recipe", "extra").alias("k"), "group_size", "keep_id", "keep_rows")
    members = same.select(F.struct("recipe", "extra").alias("k"), "doc_id", "rows", F.col("sha").alias("text_sha256"))
    joined = lookup_by_key(members, groups, "k", "group_size", "inner", min_rows=min_hot_rows)
    best = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # rows that repeat doc_id and text come back one by one; only the first of them can stay
    out = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (best & (F.col("copy") == 1)).alias("kept"),
        "text_sha256", F.col("rows").alias("group_rows"))
