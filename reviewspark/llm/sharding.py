"""A uniform shuffle into shards of exact sizes by a communication matrix.

Row counts of the shards are fixed in advance (at most one apart). How many rows each input partition
sends to each shard is drawn from the multivariate hypergeometric law, which is what a uniform
permutation of all rows would give. Rows are permuted within their partition, the matrix cuts each
permuted partition into runs for the shards, the runs are exchanged, and rows are permuted again
within their shard. Partitions are the splits of a stored narrow table, so a lost task sees the same
rows in the same places again and draws the same numbers.

The matrix is drawn in two steps: the driver draws for at most ``BLOCKS`` blocks of partitions, and each
block's share is drawn for its partitions in a task. Neither step grows with the rows.

Defined results: a null text counts as empty; null ids and repeated rows are placed like any others;
with fewer rows than shards the first shards get one row each; an empty table gives an empty table;
other columns are ignored, whatever their names. Equal texts are not kept together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewspark.llm.common import stored

BLOCKS = 256
SLICES = 4096
#: numpy's own sampler is used up to this population; beyond it the law is inverted over a window.
NUMPY_POPULATION = 900_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good ones among ``n`` drawn without replacement from ``good + bad``."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean = n * good / total
    spread = (mean * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5
    low, high = max(0, n - bad, int(mean - 12 * spread - 12)), min(n, good, int(mean + 12 * spread + 12))
    k = np.arange(low, high, dtype=np.float64)
    # ratios of neighbouring probabilities, summed in logarithms
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(logs - logs.max())
    return low + int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum()))


def draw_matrix(rng: np.random.Generator, rows: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Matrix with the row sums ``rows`` and the column sums ``room``."""
    room = room.astype(np.int64).copy()
    out = np.zeros((len(rows), len(room)), dtype=np.int64)
    for i, n in enumerate(rows):
        left, rest = int(n), int(room.sum())
        for s in range(len(room)):
            rest -= int(room[s])
            out[i, s] = hypergeometric(rng, int(room[s]), rest, left)
            left -= int(out[i, s])
        room -= out[i]
    return out


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], dtype=np.int64)


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, bounds) from (part, n): where each shard's run ends in the permuted partition."""
    spark = counts.sparkSession
    blocked = counts.withColumn("block", F.pmod(F.xxhash64("part"), F.lit(BLOCKS)).cast("int"))
    sums = blocked.groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").collect()
    sizes = np.array([r["n"] for r in sums], dtype=np.int64)
    share = draw_matrix(np.random.default_rng(seed), sizes, shard_sizes(int(sizes.sum()), shards))
    rooms = spark.createDataFrame([(int(r["block"]), [int(x) for x in m]) for r, m in zip(sums, share)], "block int, room array<long>")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        matrix = draw_matrix(np.random.default_rng([seed, int(pdf["block"].iloc[0])]), pdf["n"].to_numpy(), np.asarray(pdf["room"].iloc[0]))
        return pd.DataFrame({"part": pdf["part"].to_numpy(), "bounds": [row.tolist() for row in np.cumsum(matrix, axis=1)]})

    return blocked.join(rooms, "block").groupBy("block").applyInPandas(within, "part long, bounds array<long>")


def order_key(seed: int, step: int) -> Column:
    return F.xxhash64(F.lit(seed * 2 + step), F.col("place"))


def shard(docs: DataFrame, shards: int = 40, seed: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row."""
    body = F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(
        docs[doc_id].alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"))
    rows = stored(narrow, "shard-rows").withColumn("part", F.shiftright("place", 33))
    bounds = stored(communication_matrix(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), shards, seed), "shard-matrix")
    local = rows.withColumn("at", F.row_number().over(W.partitionBy("part").orderBy(order_key(seed, 0), "place")) - 1)
    # a run ends at its bound: the shard is the number of runs that end at or before this place
    sent = local.join(bounds, "part").withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("at"))).cast("int"))
    placed = stored(sent.select("doc_id", "size", "text_crc32", "shard", order_key(seed, 1).alias("key"), "place"), "shard-runs")
    sliced = placed.withColumn("slice", F.shiftright("key", 64 - int(np.log2(SLICES))))
    before = W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sliced.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("shard", "slice").orderBy("key", "place")) - 1
    return sliced.withColumn("inside", inside).join(offsets, ["shard", "slice"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("inside")).cast("long").alias("slot"))
