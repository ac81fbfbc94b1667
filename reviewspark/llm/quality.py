"""Quality scores from random-indexing word vectors and a small neural network.

Every token (words and runs of signs, case kept) has a sparse random index vector. A token's word vector
is the sum of the index vectors of its neighbours over the whole corpus: integers, summed by Spark, so
that the result does not depend on the order of tasks. A document is pooled from the word vectors of its
whole text (mean and spread, frequent tokens damped). A two-layer network turns the pool into a logit,
and a temperature fitted on rows kept aside turns logits into calibrated probabilities.

Tokens share ``BUCKETS`` hash buckets, which bounds the model. The network is fitted on at most
``TRAIN_ROWS`` labelled rows, taken in the order of a hash of their id; vectors are counted over all
documents and every document is scored. Only the text is an input of a score.

Defined results: null and empty texts have a zero pool and get the network's score for it; a null id is
scored and not held out; several labels of one id count as 1 if one does; without two classes
to learn from, the score is the share of label 1 (0.5 without any row); an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.llm.common import mapped, stored

BUCKETS = 1 << 14
DIMENSIONS = 32
NONZERO = 2
WINDOW = 2
TRAIN_ROWS = 20_000
HIDDEN = 32
DAMPING = 1e-3
THRESHOLD = 0.3
REMEMBERED = 400_000
BATCH_TOKENS = 1_000_000
TOKEN = re.compile(r"[^\W_]+|[\W_]+")


class Tokens:
    """Whole texts to arrays of buckets; a chunk between white space is split once and remembered."""

    def __init__(self):
        self.known: dict[str, tuple] = {}

    def chunk(self, c: str) -> tuple:
        out = tuple(zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in TOKEN.findall(c))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[c] = out
        return out

    def ids(self, text: str | None) -> np.ndarray:
        get, chunk = self.known.get, self.chunk
        return np.fromiter(chain.from_iterable([get(c) or chunk(c) for c in (text or "").split()]), np.int64)


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every bucket's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), rng.choice([-1, 1], (BUCKETS, NONZERO))


def word_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(vectors, counts) of all buckets, over all documents. The driver receives ``BUCKETS`` rows."""
    columns = [f"v{d}" for d in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, (places, signs) = Tokens(), index_vectors()
        total, counts = np.zeros(BUCKETS * DIMENSIONS), np.zeros(BUCKETS, np.int64)

        def add(parts):
            ids = np.concatenate(parts)
            doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            nonlocal total, counts
            counts += np.bincount(ids, minlength=BUCKETS)
            for o in range(1, WINDOW + 1):
                near = doc[o:] == doc[:-o]
                left, right = ids[:-o][near], ids[o:][near]
                for a, b in ((left, right), (right, left)):
                    for j in range(NONZERO):
                        total += np.bincount(a * DIMENSIONS + places[b, j], weights=signs[b, j], minlength=BUCKETS * DIMENSIONS)

        held, n = [], 0
        for batch in batches:
            for t in batch.column("text"):
                held.append(tokens.ids(t.as_py()))
                n += len(held[-1])
                if n > BATCH_TOKENS:
                    add(held)
                    held, n = [], 0
        if n:
            add(held)
        seen = np.flatnonzero(counts)
        table = total.reshape(BUCKETS, DIMENSIONS)[seen].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen]), *[pa.array(table[:, d]) for d in range(DIMENSIONS)]], ["bucket", "n", *columns])

    parts = mapped(docs.select(docs[text].cast("string").alias("text")), run, "bucket long, n long, " + ", ".join(f"{c} long" for c in columns))
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]).toArrow()
    vectors, counts = np.zeros((BUCKETS, DIMENSIONS), np.float32), np.zeros(BUCKETS)
    at = sums.column("bucket").to_numpy()
    counts[at] = sums.column("n").to_numpy()
    vectors[at] = np.stack([sums.column(c).to_numpy() for c in columns], axis=1)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.maximum(norms, 1e-9), counts


def pooled(docs: DataFrame, vectors: np.ndarray, counts: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pool): mean and standard deviation of the damped word vectors of the whole text."""
    weights = (DAMPING / (DAMPING + counts / max(counts.sum(), 1))).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((vectors * weights[:, None], weights))
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, (table, weight) = Tokens(), shared.value
        for b in batches:
            pools = np.zeros((b.num_rows, 2 * DIMENSIONS), np.float32)
            for i, t in enumerate(b.column("text")):
                ids = tokens.ids(t.as_py())
                if len(ids):
                    v = table[ids]
                    mean = v.sum(axis=0) / weight[ids].sum()
                    pools[i] = np.r_[mean, v.std(axis=0)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(pools), pa.list_(pa.float32()))], ["doc_id", "pool"])

    return mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, pool array<float>")


class Network:
    """Standardised pool, one hidden layer, a logit and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray, seed: int = 5, epochs: int = 60):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.temperature, self.share = 1.0, float(y.mean()) if len(y) else 0.5
        self.trained = len(np.unique(y[~aside])) == 2
        if not self.trained:
            return
        z, t = (x[~aside] - self.mean) / self.scale, y[~aside].astype(np.float64)
        self.weights = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        m, v = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(t))
            for at in np.array_split(order, max(1, len(t) // 128)):
                step += 1
                for k, g in enumerate(self._slopes(z[at], t[at])):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if aside.any():
            logits, truth = self._logits((x[aside] - self.mean) / self.scale), y[aside]

            def loss(heat):
                return np.mean(np.logaddexp(0, logits / heat) - truth * logits / heat)
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def _logits(self, z: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(z @ a + b) @ c + d[0]

    def _slopes(self, z: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
        a, b, c, d = self.weights
        h = np.tanh(z @ a + b)
        e = (1 / (1 + np.exp(-np.clip(h @ c + d[0], -30, 30))) - t) / len(t)
        back = np.outer(e, c) * (1 - h * h)
        return [z.T @ back + 1e-4 * a, back.sum(axis=0), h.T @ e + 1e-4 * c, np.array([e.sum()])]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.scale) / self.temperature, -30, 30)))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    vectors, counts = word_vectors(docs, text)
    pools = stored(pooled(docs, vectors, counts, doc_id, text), "quality-pools")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    train = pools.join(chosen, "doc_id").orderBy("doc_id", F.xxhash64("pool")).toArrow()
    x = np.array(train.column("pool").to_pylist(), np.float64).reshape(-1, 2 * DIMENSIONS)
    y = train.column("y").to_numpy().astype(np.float64)
    aside = np.array([zlib.crc32(f"aside{i}".encode()) % 5 == 0 for i in train.column("doc_id").to_pylist()], bool)
    shared = docs.sparkSession.sparkContext.broadcast(Network(x, y, aside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pool = b.column("pool").flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * DIMENSIONS).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.scores(pool), pa.float64())], ["doc_id", "score"])

    scored = mapped(pools, run, f"doc_id {pools.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
