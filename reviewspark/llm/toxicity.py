"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model sees the text features and the
probabilities of the categories before it. While training, those probabilities are out-of-fold: a
document's earlier probability comes from a model that did not see it, so later models learn from the
errors that they will meet. The last category is ``toxic`` itself, as labelled; the earlier ones are
labelled rows that are toxic and hold a seed word of the category.

Features are words and word beginnings (4 to 8 letters) of the whole text, and marks for beginnings that
occur at least 2 or 3 times in it, chosen by their association with the label over the training rows. The models are fitted on at most ``TRAIN_ROWS``
labelled rows, taken in the order of a hash of their id; every document is scored.

Defined results: null and empty texts have no features and are scored like any text; an unlabelled or
null id is scored too; several labels of one id count as toxic if one does; without labelled rows, or with
one class only, nothing is toxic; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.llm.common import mapped, stored

# Categories before the last, with the seed words that mark their training labels.
SEEDS = {
    "insult": ("idiot", "moron", "stupid", "clown", "loser"),
    "contempt": ("worthless", "pathetic", "trash", "scum", "disgusting"),
}
CATEGORIES = (*SEEDS, "toxic")
TRAIN_ROWS = 10_000
FEATURES = 256
LEAST_ROWS = 5
FOLDS = 3
THRESHOLD = 0.5
BEGINNINGS = range(4, 9)
#: A beginning that occurs so often in a text is marked by the number behind it; words hold no digits.
REPEATS = (2, 3)
REMEMBERED = 100_000
WORDS = re.compile(r"[^\W\d_]+")


def chunk_features(chunk: str) -> list[str]:
    """Words and beginnings, as often as they occur."""
    out = []
    for w in WORDS.findall(chunk.lower()):
        out.append("w" + w)
        out.extend(f"{n}{w[:n]}" for n in BEGINNINGS if len(w) >= n)
    return out


def text_features(text: str) -> set[str]:
    counts: Counter = Counter()
    for chunk, n in Counter(text.split()).items():
        for f in chunk_features(chunk):
            counts[f] += n
    return {*counts, *(f"{f}{n}" for f, c in counts.items() if f[0] != "w" for n in REPEATS if c >= n)}


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights and bias of a logistic regression, by full-batch gradient steps with adaptive rates."""
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    w, m, v = (np.zeros(x1.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w.astype(np.float32), -30, 30)))
        g = (p - y).astype(np.float32) @ x1 / len(y) + ridge * np.r_[w[:-1], 0.0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def apply_linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """One weight vector per category; the inputs of a later one end with out-of-fold probabilities of the earlier."""
    models, inputs = [], x
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(np.float64)
        models.append(fit_linear(inputs, y))
        held = np.zeros(len(y))
        for k in range(FOLDS):
            away, here = folds != k, folds == k
            if here.any():
                held[here] = apply_linear(inputs[here], fit_linear(inputs[away], y[away])) if away.any() else y.mean()
        inputs = np.hstack([inputs, held[:, None]])
    return models


def apply_chain(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    out, inputs = [], x
    for w in models:
        out.append(apply_linear(inputs, w))
        inputs = np.hstack([inputs, out[-1][:, None]])
    return np.stack(out, axis=1)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int, doc_id: str, text: str, label: str) -> DataFrame:
    """(doc_id, toxic, fold, features) of at most ``rows`` labelled documents."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("toxic"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    picked = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text")).join(chosen, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(text_features(t.as_py() or "")) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(found, pa.list_(pa.string()))], ["doc_id", "toxic", "features"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    made = mapped(picked.select("doc_id", "toxic", "text"), run, f"doc_id {kind}, toxic int, features array<string>")
    return stored(made.withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")), "toxicity-rows")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"):
    """(feature names, chain) or None where the labels hold less than two classes."""
    train = training_rows(docs, labels, rows, doc_id, text, label)
    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    counts = train.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    lift = F.log((F.col("a") + 0.5) / (F.col("b") + 0.5) * (n[0] / n[1]))
    best = counts.where(F.col("a") >= LEAST_ROWS).orderBy((F.col("a") * lift).desc(), "f").limit(FEATURES)
    names = [r["f"] for r in best.collect()]
    place = {f: i for i, f in enumerate(names)}
    seeds = [[f"w{w}" for w in words] for words in SEEDS.values()]
    wanted = F.array(*[F.lit(f) for f in [*names, *[s for ws in seeds for s in ws if s not in place]]])
    data = train.select("doc_id", "toxic", "fold", F.array_intersect("features", wanted).alias("f")).orderBy("doc_id").collect()
    x, y = np.zeros((len(data), len(names)), np.float32), np.zeros((len(data), len(CATEGORIES)))
    for i, r in enumerate(data):
        held = set(r["f"])
        x[i, [place[f] for f in held if f in place]] = 1
        y[i] = [*(r["toxic"] and any(s in held for s in ws) for ws in seeds), r["toxic"]]
    return names, fit_chain(x, y, np.array([r["fold"] for r in data]))


class Scorer:
    """Probabilities of whole texts; the features of a chunk of text are looked up once and remembered."""

    def __init__(self, model):
        names, self.chain = model or ([], None)
        split = [(f[:-1], int(f[-1])) if f[-1].isdigit() else (f, 1) for f in names]
        self.place = {f: i for i, f in enumerate(dict.fromkeys(f for f, _ in split))}
        self.of, self.least, self.known = np.array([self.place[f] for f, _ in split], int), np.array([n for _, n in split], int), {}

    def probabilities(self, texts: list) -> np.ndarray:
        counts = np.zeros((len(texts), len(self.place)), np.int64)
        for i, t in enumerate(texts):
            for chunk, n in Counter((t or "").split()).items():
                at = self.known.get(chunk)
                if at is None:
                    at = tuple(self.place[f] for f in chunk_features(chunk) if f in self.place)
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[chunk] = at
                for j in at:
                    counts[i, j] += n
        x = (counts[:, self.of] >= self.least).astype(np.float32)
        return apply_chain(x, self.chain) if self.chain else np.zeros((len(texts), len(CATEGORIES)))


def score(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, one probability per category, toxic) for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            p = scorer.probabilities(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(p[:, c], pa.float64()) for c in range(len(CATEGORIES))], pa.array(p[:, -1] >= threshold)],
                ["doc_id", *[f"p_{c}" for c in CATEGORIES], "toxic"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows, run, f"doc_id {kind}, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean")


def clean_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that are not toxic, with all their columns; a row is judged where it stands."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            p = scorer.probabilities(b.column(b.schema.names.index(text)).cast(pa.string()).to_pylist())
            yield b.filter(pa.array(p[:, -1] < threshold))

    return mapped(docs, run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    return score(docs, fit(docs, labels, rows))
