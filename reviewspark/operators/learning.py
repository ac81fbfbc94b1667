"""Spark ML heads: sentiment, pair relation, category; isotonic tuple calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.operators import evaluation as ev
from reviewspark.operators.sampling import balanced_class_weights
from reviewspark.session import cut_lineage


def text_features(text: str, features: int = 1 << 16) -> list:
    """Words and word pairs, hashed and weighted; a fixed feature size whatever the vocabulary."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}_\[\]/]+"),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
        HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_text_features"),
    ]


def fit_text_classifiers(train: DataFrame, text: str, label: str, weight: str, labels: Sequence[str], features: int = 1 << 16, regs: Sequence[float] = (0.01,), max_iter: int = 30) -> list:
    """Weighted multinomial logistic regressions on hashed text, one per ``regs``; the label order is fixed by ``labels``.

    The models differ in their last stage only: terms are hashed once, and the weights of the terms and every fit read the hashed counts.
    """
    rows = train.where(F.col(label).isin(list(labels)))
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(rows)
    *words, idf = text_features(text, features)
    counts = PipelineModel([index, *words]).transform(rows).select("_y", weight, "_tf").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weights = idf.fit(counts)
        x = weights.transform(counts)
        heads = [LogisticRegression(
            featuresCol="_text_features", labelCol="_y", weightCol=weight, family="multinomial", regParam=reg, maxIter=max_iter, probabilityCol="_prob", predictionCol="_guess").fit(x) for reg in regs]
    finally:
        counts.unpersist()
    return [PipelineModel([index, *words, weights, head]) for head in heads]


def fit_text_classifier(train: DataFrame, text: str, label: str, weight: str, labels: Sequence[str], features: int = 1 << 16, reg: float = 0.01, max_iter: int = 30):
    """One model of ``fit_text_classifiers``."""
    return fit_text_classifiers(train, text, label, weight, labels, features, [reg], max_iter)[0]


def classify(model, rows: DataFrame, out: str = "predicted") -> DataFrame:
    """Predicted label, its probability and the map of all probabilities."""
    names = model.stages[0].labels
    guess = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("_guess") + 1).cast("int"))
    scored = model.transform(rows)
    probs = vector_to_array("_prob")
    return scored.select(*rows.columns, guess.alias(out), F.array_max(probs).alias(f"{out}_confidence"),
                         F.map_from_arrays(F.array(*[F.lit(n) for n in names]), probs).alias(f"{out}_probabilities"))


def select_category_model(candidates: Sequence, validation: DataFrame, label: str, labels: Sequence[str]):
    """The candidate with the best .6 macro F1 (labels that occur) + .4 accuracy, and its score."""
    scores = []
    for model in candidates:
        # a row per label, read twice below
        rep = cut_lineage(ev.class_report(classify(model, validation), label, "predicted", labels))
        row = ev.macro_scores(rep, present_only=True).select((0.6 * F.col("macro_f1") + 0.4 * F.col("accuracy")).alias("s")).first()
        scores.append(row["s"] or 0.0)
    best = max(range(len(candidates)), key=lambda i: scores[i])
    return candidates[best], scores[best]


def fit_relation(train: DataFrame, tune: DataFrame, features: str = "features", label: str = "label", weight: str = "sample_weight", min_per_class: int = 20, min_tune_per_class: int = 5, gate_f1: float = 0.75, gate_recall: float = 0.70):
    """(model or None, threshold, status) for pair relations.

    Too few rows of a class, a collapsed model or no threshold behind the gate
    end in no model: a relation head is only used once it has earned it.
    """
    for rows, least in ((train, min_per_class), (tune, min_tune_per_class)):
        floor = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least")).first()
        if floor["classes"] < 2 or floor["least"] < least:
            return None, 0.5, "not_trained_insufficient_safe_supervision"
    weights = balanced_class_weights(train, label, weight)
    weighted = train.join(F.broadcast(weights), train[label] == weights["label"]).drop(weights["label"]).withColumn("_w", F.col(weight) * F.col("class_weight"))
    size = len(train.select(features).first()[0])
    vec = VectorAssembler(inputCols=[f"_f{i}" for i in range(size)], outputCol="_v")

    def vectors(df):
        return vec.transform(df.select("*", *[F.col(features)[i].alias(f"_f{i}") for i in range(size)]))

    model = LogisticRegression(featuresCol="_v", labelCol=label, weightCol="_w", maxIter=50, probabilityCol="_p").fit(vectors(weighted))
    scored = model.transform(vectors(tune)).select(vector_to_array("_p")[1].alias("score"), F.col(label).alias("y"))
    share = scored.agg(F.avg((F.col("score") >= 0.5).cast("double")).alias("s")).first()["s"]
    if share is None or not 0.05 <= share <= 0.95:
        return None, 0.5, "stopped_collapsed_checkpoint"
    best = ev.sweep_pairs(scored, "score", "y", [i / 100 for i in range(20, 81, 2)], gate_f1, gate_recall).where("selected").select("threshold").first()
    return (model, best["threshold"], "trained_gate_passed") if best else (None, 0.5, "failed_relation_gate")


def fit_tuple_calibrator(tuples: DataFrame, score: str, correct: str, min_samples: int = 100, min_class: int = 10):
    """Isotonic score calibration, or (None, status) without enough human-checked tuples of both outcomes."""
    c = tuples.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("int")).alias("hits")).first()
    hits = c["hits"] or 0
    if c["n"] < min_samples or min(hits, c["n"] - hits) < min_class:
        return None, "not_fitted_insufficient_human_tuples"
    rows = tuples.select(F.col(score).cast("double").alias("x"), F.col(correct).cast("double").alias("label"))
    # equal scores are pooled before fitting: the model sees distinct scores, not rows
    pooled = rows.groupBy("x").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="x", labelCol="label", weightCol="weight").fit(pooled.select(F.col("x"), "label", "weight").transform(_as_vector)), "fitted"


def _as_vector(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["x"], outputCol="_x").transform(df).drop("x").withColumnRenamed("_x", "x")


def calibrate(model, tuples: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
    """Linear interpolation between the fitted steps, clipped to them and to [0, 1]."""
    staged = _as_vector(tuples.withColumn("x", F.col(score).cast("double")))
    return model.setPredictionCol(out).transform(staged).drop("x").withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(out))))
