"""Nearest vectors by cosine with a hash-prefix forest.

Every tree hashes a vector to a string of ``BITS`` bits (sides of random planes through the mean of a
bounded sample) and keeps the vectors in the order of their strings. A directory counts, per tree, the
vectors below every prefix of up to ``DEPTH`` bits. A query descends all trees to its longest prefix
and ascends in all of them together, a bit at a time, until the ranges below its prefixes hold enough
candidates; each tree's range is a contiguous piece of its sorted array. The pieces are cut into
segments, and a segment compares its queries with their ranges and returns the best few. The queries of a
segment are counted first and split over blocks, so a task holds a bounded number of vectors and of queries.

How many candidates are enough is measured, not guessed: ``SAMPLE_QUERIES`` queries are answered by brute
force against all vectors, and the deepest level of ascent at which the forest finds at least
``WANTED_RECALL`` of their neighbours sets the number.

Equal vectors are one entry that keeps its ``k + 1`` smallest ids: no other of its ids can be among the k
nearest, ties going to smaller ids. A prefix of many vectors is split over several segments.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do
rows without id and, where lengths differ, vectors of another length than most have; repeated rows with the same id and vector are one candidate; with fewer candidates than k, all
are returned; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewspark.llm.common import SMALL_KEYS, stored
from reviewspark.scale import small

TREES = 20
BITS = 32
DEPTH = 16
SAMPLE_ROWS = 2_000
SAMPLE_QUERIES = 200
WANTED_RECALL = 0.96
SEGMENT_ROWS = 8_192
#: Queries that meet a segment in one task, about; those of a segment are split over blocks, each with its own copy of the segment.
BLOCK_QUERIES = 8_192
#: Queries compared with their range in one matrix.
SLICE_QUERIES = 256
#: Rows of questions that a task holds before it sends them on.
PACK_ROWS = 10_000


class Planes:
    def __init__(self, sample: np.ndarray, seed: int = 3):
        self.centre = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
        self.normals = np.random.default_rng(seed).standard_normal((sample.shape[1], TREES * BITS))

    def codes(self, units: np.ndarray) -> np.ndarray:
        """One integer of ``BITS`` bits per vector and tree."""
        sides = ((units - self.centre) @ self.normals > 0).reshape(len(units), TREES, BITS)
        return sides @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def vectors_of(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def taking_part(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(table[vec_id].cast("long").alias("id"), table[embedding].cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def usual_length(rows: DataFrame) -> int:
    """The length that most vectors have; of equally frequent ones the largest."""
    found = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).agg(F.max(F.struct("c", "n")).alias("m")).first()
    return found["m"]["n"] if found["m"] else 0


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids, uid): distinct vectors with their smallest ids; extra ids are dropped before the shuffle."""
    order = W.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= keep)
    return few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("uid", F.col("ids")[0])


def best(q: np.ndarray, c: np.ndarray, k: int, ids: list[np.ndarray]) -> list[np.ndarray]:
    """Per query the ``k`` candidates of the largest cosine, ties to the smaller id."""
    s = unit(q) @ unit(c).T
    first = np.array([i[0] for i in ids])
    return [np.lexsort((first, -row))[:k] for row in s] if len(c) <= 4 * k else [_top(row, first, k) for row in s]


def _top(row: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    edge = np.partition(row, len(row) - k)[len(row) - k]
    near = np.flatnonzero(row >= edge)
    return near[np.lexsort((first[near], -row[near]))][:k]


def brute_force(table: DataFrame, queries: np.ndarray, keep: int) -> list[np.ndarray]:
    """The ``keep`` nearest entries' vectors of each of a few queries, against all entries."""
    shared = table.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = vectors_of(b.column("v"))
            s = unit(shared.value) @ unit(c).T
            at = np.argsort(-s, axis=1)[:, :keep]
            q = np.repeat(np.arange(len(at)), at.shape[1])
            flat = at.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(s[q, flat]), b.column("v").take(pa.array(flat))], ["q", "s", "v"])

    found = table.select("v").mapInArrow(run, "q long, s double, v array<double>")
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.col("s").desc(), F.xxhash64("v")))).where(F.col("r") <= keep)
    rows = ranked.orderBy("q", "r").toArrow()
    q, v = rows.column("q").to_numpy(), vectors_of(rows.column("v"))
    return [v[q == i] for i in range(len(queries))]


class Directory:
    """Exact counts of vectors below every prefix of up to ``DEPTH`` bits, and the segments of the arrays."""

    def __init__(self, counts: np.ndarray):
        self.upto = np.concatenate([np.zeros((TREES, 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
        self.cells = counts
        self.segment = (self.upto[:, :-1] // SEGMENT_ROWS).astype(np.int64)
        self.salts = np.maximum(1, -(-counts // SEGMENT_ROWS)).astype(np.int64)

    def below(self, codes: np.ndarray, level: int) -> np.ndarray:
        """Vectors below the prefix of ``level`` bits, by query and tree."""
        p = codes >> (BITS - level)
        width = DEPTH - level
        trees = np.arange(TREES)
        return self.upto[trees, (p + 1) << width] - self.upto[trees, p << width]

    def levels(self, codes: np.ndarray, enough: int) -> np.ndarray:
        """The deepest level at which all trees together hold ``enough`` candidates."""
        out = np.zeros(len(codes), np.int64)
        for level in range(1, DEPTH + 1):
            out[self.below(codes, level).sum(axis=1) >= enough] = level
        return out


def enough_candidates(planes: Planes, directory: Directory, queries: np.ndarray, truth: list[np.ndarray]) -> int:
    """The smallest number on a ladder of shares of all entries that reaches the wanted recall."""
    total = int(directory.upto[0, -1])
    codes = planes.codes(unit(queries))
    near = [planes.codes(unit(t)) for t in truth]
    for share in 0.75 ** np.arange(40, -1, -1):
        enough = max(1, int(share * total * TREES))
        levels = directory.levels(codes, enough)
        found = [((c[None, :] ^ n) >> (BITS - level) == 0).any(axis=1).mean() if level else 1.0 for c, n, level in zip(codes, near, levels) if len(n)]
        if not found or np.mean(found) >= WANTED_RECALL:
            return enough
    return total * TREES


def nearest(table: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest others of every row that ``is_query`` marks."""
    spark = table.sparkSession
    rows = taking_part(table, vec_id, embedding)
    same = F.size("v") == usual_length(rows)
    all_entries = stored(entries(rows.where(same), k + 1), "forest-entries")
    queries = stored(taking_part(table.where(is_query), vec_id, embedding).where(same).distinct(), "forest-queries")
    sample = vectors_of(all_entries.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE_ROWS).select("v").toArrow().column("v"))
    empty = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], empty)
    planes = spark.sparkContext.broadcast(Planes(unit(sample)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = vectors_of(b.column("v"))
            codes = planes.value.codes(unit(v))
            at = np.repeat(np.arange(len(v)), TREES)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(np.arange(TREES), len(v))), pa.array(codes.ravel()), b.column("uid").take(pa.array(at)), b.column("ids").take(pa.array(at)),
                pa.array([x.tobytes() for x in v], pa.binary()).take(pa.array(at))], ["tree", "code", "uid", "ids", "v"])

    placed = stored(all_entries.select("uid", "ids", "v").mapInArrow(hashed, "tree long, code long, uid long, ids array<long>, v binary"), "forest-arrays")
    cell = F.shiftright("code", BITS - DEPTH)
    counts = np.zeros((TREES, 1 << DEPTH), np.int64)
    counted = placed.groupBy("tree", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts[counted.column("tree").to_numpy(), counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    directory = Directory(counts)
    asked = vectors_of(queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).select("v").toArrow().column("v"))
    enough = enough_candidates(planes.value, directory, asked, brute_force(all_entries, asked, k + 1)) if len(asked) else 1
    shared = spark.sparkContext.broadcast(directory)

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for b in batches:
            tree, code, uid = (b.column(c).to_numpy() for c in ("tree", "code", "uid"))
            c = code >> (BITS - DEPTH)
            salt = (uid * 2654435761 >> 7) % d.salts[tree, c]
            yield pa.RecordBatch.from_arrays([b.column("tree"), pa.array(d.segment[tree, c]), pa.array(salt), *[b.column(x) for x in ("code", "ids", "v")]],
                                             ["tree", "segment", "salt", "code", "ids", "v"])

    def routes(d: Directory, b: pa.RecordBatch) -> Iterator[tuple]:
        """(place in the batch, tree, low, high, segments and salts met) of every query and tree."""
        v = vectors_of(b.column("v"))
        if not len(v):
            return
        codes = planes.value.codes(unit(v))
        levels = d.levels(codes, enough)
        for i in range(len(v)):
            span, shift = DEPTH - levels[i], BITS - levels[i]
            for t in range(TREES):
                p = codes[i, t] >> shift
                held = np.flatnonzero(d.cells[t, p << span:(p + 1) << span]) + (p << span)
                met = {(int(s), j) for s, n in zip(d.segment[t, held], d.salts[t, held]) for j in range(int(n))}
                yield i, t, int(p << shift), int((p + 1) << shift), met

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for _, t, _, _, met in routes(shared.value, b):
                n.update((t, s, j) for s, j in met)
        columns = [*zip(*((*k, c) for k, c in n.items()))] or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["tree", "segment", "salt", "n"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "segment", "salt", "query", "low", "high", "qv"]
        for b in batches:
            ids, vectors = b.column("id").to_pylist(), vectors_of(b.column("v"))
            out: list[tuple] = []
            for i, t, low, high, met in routes(shared.value, b):
                packed = vectors[i].tobytes()
                for s, j in met:
                    out.append((t, s, j, ids[i], low, high, packed))
                    if len(out) >= PACK_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(left) and len(right):
            left = left.sort_values("code")
            code, ids = left["code"].to_numpy(), left["ids"].to_numpy()
            c = np.stack([np.frombuffer(x) for x in left["v"]])
            asked_id, asked_v = right["query"].to_numpy(), right["qv"].to_numpy()
            lo, hi = np.searchsorted(code, right["low"].to_numpy()), np.searchsorted(code, right["high"].to_numpy())
            for (a, b), at in pd.DataFrame({"a": lo, "b": hi}).groupby(["a", "b"]).indices.items():
                for some in np.split(at, range(SLICE_QUERIES, len(at), SLICE_QUERIES)) if b > a else []:
                    q = np.stack([np.frombuffer(x) for x in asked_v[some]])
                    for i, one, near in zip(some, q, best(q, c[a:b], k + 1, list(ids[a:b]))):
                        for n in near:
                            v = c[a + n]
                            found.append((asked_id[i], ids[a + n], float(one @ v) / (np.sqrt(one @ one) * np.sqrt(v @ v))))
        return pd.DataFrame(found, columns=["query_id", "ids", "score"])

    arrays = placed.mapInArrow(stand, "tree long, segment long, salt long, code long, ids array<long>, v binary")
    place = ["tree", "segment", "salt"]
    kinds = "tree long, segment long, salt long"
    tallied = queries.mapInArrow(tally, f"{kinds}, n long").groupBy(*place).agg(F.ceil(F.sum("n") / BLOCK_QUERIES).alias("blocks"))
    blocks = small(stored(tallied, "forest-blocks"), SMALL_KEYS)
    routed = queries.mapInArrow(ask, f"{kinds}, query long, low long, high long, qv binary").join(blocks, place)
    routed = routed.withColumn("block", F.pmod(F.xxhash64("query", "qv"), "blocks")).drop("blocks")
    copied = arrays.join(blocks, place).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    key = [*place, "block"]
    met = copied.groupBy(*key).cogroup(routed.groupBy(*key)).applyInPandas(meet, "query_id long, ids array<long>, score double")
    each = met.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
