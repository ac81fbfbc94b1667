"""Near duplicates: exact Jaccard join on word shingles by token-combination prefixes.

A document is its set of distinct five-word shingles. Tokens (shingle hashes) have one global order: rare
ones by hash, then the frequent ones, which a count over all documents finds. Two sets that reach the
threshold share a token in their prefixes; sets whose prefix runs into frequent tokens extend it far
enough that they share several, so that frequent tokens are indexed in pairs and rare ones alone:

* a set whose prefix is all rare indexes its prefix tokens;
* any other set is cut further by ``1 + classes`` tokens. Frequent tokens fall into ``classes`` by hash
  (their number follows from the size band of the set). Two sets that share ``1 + classes`` prefix
  tokens share a rare one, or two of the same class: one indexed pair.

Documents of equal sets are collapsed first. Signatures with few documents give pairs, which are
counted and filtered by the number of prefix tokens they share; signatures with many give a star to
one of them. What is tied so is a family. Families are verified in blocks of documents against blocks,
all sets of a block at once, and a block returns the links of a spanning forest: enough for the
groups, and linear in the documents. A large family is spread over many tasks; no pair list of a
group is ever written.

Defined results: words and folding as in ``shingles``; null and blank texts have an empty set and are
alone; rows that repeat are one group; a null id is larger than none, so it never names a group unless
all ids of the group are null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.llm.common import SMALL_KEYS, mapped, stored
from reviewspark.llm.words import shingle_sets
from reviewspark.operators.dedup import connected_components
from reviewspark.scale import lookup_by_key, small

N = 5
#: The threshold is NUM / DEN.
NUM, DEN = 3, 4
#: A token of at least so many documents is frequent; the list of frequent tokens is bounded.
FREQUENT_TOKENS = 1_000_000
#: Signatures of more documents than this become stars.
STAR_DOCS = 16
FREQUENT_DF = STAR_DOCS + 1
BLOCK_DOCS = 512
#: Tokens of a block, about: what a task holds of a family of long texts.
BLOCK_TOKENS = 1_000_000
#: Tokens that a task counts before it sends them on.
PACK_TOKENS = 2_000_000
CLASS_TOKENS = 8
#: Leading bits of a signature in the bitmap of those that several documents may have (32 MB).
TIED_BITS = 28

WORD = re.compile("[^\x20\x09-\x0D]+")
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
FOLD = {c: c + 32 for c in range(65, 91)}
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The words as text; ``words.shingle_sets`` hashes the same ones."""
    low = text.lower() if text.isascii() else text.translate(FOLD)
    return WORD.findall(low) if ODD.search(low) else low.split()


def smallest_overlap(n):
    """Tokens that a set of ``n`` shares at least with any set that reaches the threshold."""
    return (NUM * n + DEN - 1) // DEN


def band(n: int) -> int:
    """Size band; sets that reach the threshold are in the same or in neighbouring bands."""
    return int(np.floor(np.log(n) / np.log(DEN / NUM) + 1e-9))


def classes(b: int) -> int:
    """Classes of frequent tokens for pairs whose larger set is in band ``b``."""
    return max(1, int((DEN / NUM) ** b) // CLASS_TOKENS)


def combine(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    out = (a ^ (b * MIX) ^ np.uint64(salt * 2 + 1)) * MIX
    return out ^ (out >> np.uint64(31))


@functools.lru_cache(256)
def pairs_below(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def last_rare(rare: np.ndarray, used: int) -> int:
    if used == len(rare):
        return int(np.iinfo(np.int64).max)
    return int(rare[used - 1]) - (1 << 63)


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(signatures, rare tokens among them, last): what one set is indexed by.

    The rare ones come first. ``last`` is the largest rare token in the index, mapped in order to a
    signed number, or the largest number if all rare tokens of the set are in it.
    """
    n = len(tokens)
    at = np.searchsorted(frequent, tokens)
    hot = (frequent[np.minimum(at, len(frequent) - 1)] == tokens) if len(frequent) else np.zeros(n, bool)
    rare, often = tokens[~hot], tokens[hot]
    prefix = n - smallest_overlap(n) + 1
    if len(rare) >= prefix:
        return rare[:prefix], prefix, last_rare(rare, prefix)
    found, longest = [], 0
    for b in (band(n), band(n) + 1):
        c = classes(b)
        length = min(n, prefix + c)
        longest = max(longest, length)
        chosen = often[:max(0, length - len(rare))]
        group = (chosen >> np.uint64(7)) % np.uint64(c)
        for g in np.unique(group):
            m = chosen[group == g]
            i, j = pairs_below(len(m))
            if len(i):
                found.append(combine(m[i], m[j], b))
    part = rare[:longest]
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    return np.concatenate([part, pairs]), len(part), last_rare(rare, len(part))


def block_bits(spark) -> int:
    return max(8, int(np.ceil(np.log2(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))))


def packed(rows: DataFrame, arrays, bits: int) -> DataFrame:
    """The hashes that ``arrays`` finds in batches of ``rows``: packed by block (their leading bits), once or with a count.

    A hash takes four bytes of a shuffle, and one that a task meets often is one entry per task.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            low = ((tokens << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            cut = np.searchsorted(tokens, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            ids, once, more, times = [], [], [], []
            for i, (t, c) in enumerate(zip(np.split(low, cut), np.split(counts, cut))):
                if len(t):
                    ids.append(i)
                    once.append(t[c == 1].tobytes())
                    more.append(t[c > 1].tobytes())
                    times.append(c[c > 1].astype(np.uint32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *[pa.array(x, pa.binary()) for x in (once, more, times)]], ["block", "once", "more", "times"])

        for b in batches:
            for tokens in arrays(b):
                held.append(tokens)
                n += len(tokens)
                if n > PACK_TOKENS:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return mapped(rows, pack, "block int, once binary, more binary, times binary")


def summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hashes without their block, counts) of a block."""
    once, more, times = ([np.frombuffer(x.as_py(), np.uint32) for x in table.column(c)] for c in ("once", "more", "times"))
    tokens = np.concatenate([*once, *more])
    weights = np.concatenate([np.ones(sum(map(len, once)), np.int64), *[t.astype(np.int64) for t in times]])
    order = np.argsort(tokens, kind="stable")
    tokens, weights = tokens[order], weights[order]
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    return tokens[first], np.add.reduceat(weights, first)


def frequent_tokens(rows: DataFrame, least: int = FREQUENT_DF, limit: int = FREQUENT_TOKENS) -> tuple[np.ndarray, int]:
    """The tokens of at least ``least`` documents, counted over all of them: heads in ascending order, and bits.

    Where they are more than ``limit``, a histogram by frequency tells from which frequency on they are taken.

    A task sends its tokens packed by block (the leading bits of the hash), each with its own count, so
    a token of many documents is one entry per task.
    """
    spark = rows.sparkSession
    bits = block_bits(spark)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        tokens, df = summed(table)
        often = df >= least
        return pa.table({"block": np.full(often.sum(), key[0].as_py(), np.int64), "token": tokens[often].astype(np.int64), "df": df[often]})

    counted = packed(rows.select("text"), lambda b: shingle_sets(b.column("text"), N), bits).groupBy("block").applyInArrow(count, "block long, token long, df long")
    step = F.floor(F.log2("df") * 8)
    counted = stored(counted.withColumn("step", step), "jaccard-frequent")
    left, lowest = limit, None
    for r in counted.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("step").desc()).collect():
        left -= r["n"]
        if left < 0:
            break
        lowest = r["step"]
    best = counted.where(F.col("step") >= F.lit(lowest)).select("block", "token").toArrow()
    block, token = (best.column(c).to_numpy().astype(np.uint64) for c in ("block", "token"))
    return np.sort((block << np.uint64(32)) | token), bits


def indexed(rows: DataFrame, frequent: np.ndarray, bits: int) -> DataFrame:
    """Per row: doc_id, n, digest of the set, and what the set is indexed by."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for tokens in shingle_sets(b.column("text"), N):
                sigs, rare, last = np.zeros(0, np.uint64), 0, 0
                if len(tokens):
                    # frequent tokens are known by their leading bits only
                    heads = tokens >> np.uint64(32 - bits)
                    at = np.searchsorted(often, heads)
                    hot = tokens[often[np.minimum(at, len(often) - 1)] == heads] if len(often) else tokens[:0]
                    sigs, rare, last = signatures(tokens, hot)
                for column, v in zip(out, (len(tokens), hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), sigs.astype(np.int64), rare, last)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *[pa.array(c, t) for c, t in zip(out, (
                pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int64()))]], ["doc_id", "text_hash", "n", "digest", "sigs", "rare", "last"])

    return mapped(rows, run, "doc_id long, text_hash long, n long, digest binary, sigs array<long>, rare int, last long")


def verify(members: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b): links of a spanning forest in every block of every family.

    ``members``: family, part, node, tokens (packed), other: True for the second block of a pair.
    """
    def forest(nodes, sets, other):
        sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        _, codes, df = np.unique(every, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        keep = df[codes] > 1
        rank = np.cumsum(df > 1) - 1
        codes, owner = rank[codes[keep]], owner[keep]
        overlap = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(codes, kind="stable")
        codes, owner = codes[order], owner[order]
        width = 2048
        for lo in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
            i, j = np.searchsorted(codes, (lo, lo + width))
            m = np.zeros((len(sets), width), np.float32)
            m[owner[i:j], codes[i:j] - lo] = 1
            overlap += m @ m.T
        linked = (num + den) * overlap >= num * (sizes[:, None] + sizes[None, :]) - 1e-3
        if other.any() and not other.all():
            linked &= other[:, None] != other[None, :]
        label = np.arange(len(sets))
        links = []
        for a, b in zip(*np.nonzero(np.triu(linked, 1))):
            if label[a] != label[b]:
                label[label == max(label[a], label[b])] = min(label[a], label[b])
                links.append((nodes[a], nodes[b]))
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, other, links = None, [], [], [], []

        def done():
            if len(nodes) > 1:
                links.extend(forest(nodes, sets, np.array(other)))
        for b in batches:
            for f, p, node, t, o in zip(*[b.column(c).to_pylist() for c in ("family", "part", "node")], b.column("tokens"), b.column("other").to_pylist()):
                if (f, p) != key:
                    done()
                    key, nodes, sets, other = (f, p), [], [], []
                nodes.append(node)
                sets.append(np.frombuffer(t.as_py(), np.uint64))
                other.append(o)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])
            links = []
        done()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    dealt = members.repartition("family", "part").sortWithinPartitions("family", "part", "node")
    return mapped(dealt, run, "a long, b long")


def tied_signatures(own: DataFrame) -> DataFrame:
    """(sig, node, alone) of the signatures of ``own`` (uid, sigs, rare) that several nodes may have.

    Nearly all have one node. A bitmap of bounded size tells the others by their leading bits; one that it lets
    through is counted all the same.
    """
    spark, bits = own.sparkSession, block_bits(own.sparkSession)

    def flat(b):
        return b.column("sigs").flatten().to_numpy(zero_copy_only=False).view(np.uint64)

    def segment(key: tuple, table: pa.Table) -> pa.Table:
        tokens, nodes = summed(table)
        marked = np.zeros(1 << (TIED_BITS - bits), bool)
        marked[tokens[nodes > 1] >> np.uint32(32 - TIED_BITS + bits)] = True
        return pa.table({"block": [key[0].as_py()], "marked": [np.packbits(marked).tobytes()]})

    found = packed(own.select("sigs"), lambda b: [flat(b)], bits).groupBy("block").applyInArrow(segment, "block long, marked binary").toArrow()
    bitmap = np.zeros((1 << bits, 1 << (TIED_BITS - bits - 3)), np.uint8)
    for block, marked in zip(found.column("block").to_pylist(), found.column("marked")):
        bitmap[block] = np.frombuffer(marked.as_py(), np.uint8)
    shared = spark.sparkContext.broadcast(bitmap.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, sizes = flat(b), b.column("sigs").value_lengths().to_numpy()
            row = np.repeat(np.arange(b.num_rows), sizes)
            place = np.arange(len(sigs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            head = sigs >> np.uint64(64 - TIED_BITS)
            hit = (shared.value[head >> np.uint64(3)] >> (7 - (head & np.uint64(7)).astype(np.uint8))) & 1 > 0
            uid, rare = (b.column(c).to_numpy() for c in ("uid", "rare"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sigs[hit].view(np.int64), uid[row[hit]], place[hit] < rare[row[hit]])], ["sig", "node", "alone"])

    return mapped(own.select("uid", "sigs", "rare"), run, "sig long, node long, alone boolean")


def candidate_edges(sigs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) between nodes that may be linked, or that share a signature with many.

    ``sigs``: sig, node, alone (a rare token on its own); ``nodes``: node, n, rare, last.
    """
    held = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("docs"), F.min("node").alias("low")).where("docs > 1")
    tied = stored(sigs.join(held, "sig"), "jaccard-tied")
    stars = tied.where((F.col("docs") > STAR_DOCS) & (F.col("node") != F.col("low"))).select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    few = tied.where(F.col("docs") <= STAR_DOCS).select("sig", "node", "alone")
    # at most STAR_DOCS rows per signature
    lists = few.groupBy("sig", "alone").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    pairs = lists.select("alone", F.explode("nodes").alias("a"), "nodes").select("alone", "a", F.explode(F.filter("nodes", lambda x: x > F.col("a"))).alias("b"))
    shared = pairs.groupBy("a", "b").agg(F.sum(F.col("alone").cast("int")).alias("shared"))
    left, right = (nodes.select(*[F.col(c).alias(f"{c}_{s}") for c in nodes.columns]) for s in "ab")
    met = shared.join(left, F.col("a") == F.col("node_a")).join(right, F.col("b") == F.col("node_b"))
    # the set whose index ends first shares all its indexed rare tokens that the other holds
    first = F.col("last_a") <= F.col("last_b")
    most = F.when(first, F.col("n_a") - F.col("rare_a")).otherwise(F.col("n_b") - F.col("rare_b")) + F.col("shared")
    fits = (NUM + DEN) * F.least(most, "n_a", "n_b") >= NUM * (F.col("n_a") + F.col("n_b"))
    return met.where(fits).select("a", "b").union(stars)


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = FREQUENT_DF) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, text_hash and a number of its group (null without words)."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), text_hash(docs[text]).alias("text_hash"))
    frequent, bits = frequent_tokens(rows, least)
    table = stored(indexed(rows, frequent, bits).withColumn("uid", F.monotonically_increasing_id()), "jaccard-sets")
    sets = table.where("n > 0").groupBy("digest").agg(
        F.min("uid").alias("node"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    sets = stored(sets, "jaccard-classes")
    # one row per distinct set stands for all its copies
    own = table.join(small(sets.select(F.col("node").alias("uid")), SMALL_KEYS), "uid", "left_semi")
    sigs = tied_signatures(own)
    nodes = own.select(F.col("uid").alias("node"), "n", "rare", "last")
    families = connected_components(stored(candidate_edges(sigs, nodes), "jaccard-candidates")).select(F.col("id").alias("node"), F.col("root").alias("family"))
    families = stored(families, "jaccard-families")
    links = stored(verify(blocks(docs, doc_id, text, own, families)), "jaccard-links")
    linked = connected_components(links).select(F.col("id").alias("node"), F.col("root"))
    named = sets.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = named.join(groups, "root").select("digest", "component_id", "copies", F.col("root").alias("group"))
    out = lookup_by_key(table.select("doc_id", "text_hash", "n", "digest"), of_set, "digest", "copies", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "text_hash", "group")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def group_decisions(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dropped, repeated) keys (doc_id, text_hash): one row of each group stays, of the smallest doc_id and hash."""
    rows = found.where(F.col("group").isNotNull()).groupBy("group", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    stays = rows.groupBy("group").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    judged = lookup_by_key(rows, stays, "group", "members", "inner").withColumn("stay", order == F.col("first"))
    return judged.where(~F.col("stay")), rows.where("rows > 1").join(judged.where(~F.col("stay")), ["group", "doc_id", "text_hash"], "left_anti")


def blocks(docs: DataFrame, doc_id: str, text: str, own: DataFrame, families: DataFrame) -> DataFrame:
    """(family, part, node, tokens, other): every two blocks of a family meet in one part."""
    weighed = families.join(own.select(F.col("uid").alias("node"), "n"), "node")
    sizes = weighed.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"))
    cut = F.greatest(F.ceil(F.col("members") / BLOCK_DOCS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    placed = lookup_by_key(families, sizes, "family", "members", "inner").withColumn("cut", cut).drop("tokens").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))
    wanted = stored(placed.join(own.select(F.col("uid").alias("node"), "doc_id", "digest"), "node"), "jaccard-members")
    # a null id is looked up as the smallest number; the digest tells rows of one id apart
    key = F.coalesce(docs[doc_id].cast("long"), F.lit(-(2**63)))
    rows = docs.select(key.alias("k"), docs[text].cast("string").alias("text"))
    rows = rows.join(small(wanted.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k")).distinct(), SMALL_KEYS), "k", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [tokens.tobytes() for tokens in shingle_sets(b.column("text"), N)]
            digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["k", "digest", "tokens"])

    made = mapped(rows, run, "k long, digest binary, tokens binary").dropDuplicates(["digest"])
    full = wanted.select("family", "node", "cut", "block", "digest").join(made.select("digest", "tokens"), "digest")
    # block i meets block j: part (i, j) with i <= j; the part of a block with itself compares all its members
    met = F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda o: F.struct(
        (F.least("block", o) * F.col("cut") + F.greatest("block", o)).alias("part"), ((F.col("block") > o)).alias("other")))
    return full.select("family", "node", "tokens", F.explode(met).alias("m")).select("family", "m.part", "node", "tokens", "m.other")
