"""Exact-match, class, calibration, threshold, gate and promotion reports.

Gold and prediction rows are compared by one union and one aggregate on the
match key; from there on every table is as small as the number of classes,
bins, thresholds or slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewspark import lexicons as lx
from reviewspark.scale import running_over_scores


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf_columns(df: DataFrame) -> DataFrame:
    """precision, recall, f1 and support from tp, fp, fn."""
    df = df.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return df.withColumns({
        "f1": ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "support": F.col("tp") + F.col("fn"),
    })


def match_flags(gold: DataFrame, pred: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per distinct key with in_gold / in_pred (0 or 1)."""
    g = gold.select(*key, F.lit(1).alias("g"), F.lit(0).alias("p"))
    p = pred.select(*key, F.lit(0).alias("g"), F.lit(1).alias("p"))
    return g.unionByName(p).groupBy(*key).agg(F.max("g").alias("in_gold"), F.max("p").alias("in_pred"))


def micro_prf(gold: DataFrame, pred: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Micro scores over sets of keys per review; ``by`` columns must be part of the key."""
    flags = match_flags(gold, pred, key)
    counts = flags.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("in_gold") * F.col("in_pred")), F.lit(0)).alias("tp"),
        F.coalesce(F.sum((1 - F.col("in_gold")) * F.col("in_pred")), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.col("in_gold") * (1 - F.col("in_pred"))), F.lit(0)).alias("fn"),
    )
    return prf_columns(counts)


def tuple_keys(rows: DataFrame, keep: Sequence[str] = ("id",), pair: Column | None = None, auto: Column | None = None) -> DataFrame:
    """Each tuple as its aspect, opinion, pair and triplet key, in one pass.

    Pairs and triplets only where ``pair`` holds; a triplet counts as auto accepted, too, where ``auto`` holds.
    """
    a, o = (F.col("aspect_start"), F.col("aspect_end")), (F.col("opinion_start"), F.col("opinion_end"))
    none_i, none_s = F.lit(None).cast("int"), F.lit(None).cast("string")

    def key(kind, x, y, s, ok):
        return F.when(ok, F.struct(F.lit(kind).alias("kind"), x[0].alias("k1"), x[1].alias("k2"), y[0].alias("k3"), y[1].alias("k4"), s.alias("k5")))

    blank = (none_i, none_i)
    paired = o[0].isNotNull() if pair is None else o[0].isNotNull() & pair
    keys = [
        key("aspect", a, blank, none_s, a[0].isNotNull()), key("opinion", blank, o, none_s, o[0].isNotNull()),
        key("pair", a, o, none_s, paired), key("triplet", a, o, F.col("sentiment"), paired),
        key("negative_triplet", a, o, F.col("sentiment"), paired & (F.col("sentiment") == "negative")),
    ]
    if auto is not None:
        keys.append(key("auto_accepted", a, o, F.col("sentiment"), paired & auto))
    return rows.select(*keep, F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("k")).select(*keep, "k.*")


TUPLE_KEY = ["kind", "id", "k1", "k2", "k3", "k4", "k5"]


def exact_evaluation(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Scores by kind (aspect, opinion, pair, triplet, negative triplet, auto accepted) with coverage.

    Pair and triplet gold needs a three-class label and a relation that is not
    denied; the auto-accepted row keeps the gold and drops queued predictions.
    Both sides are read once; the distinct predicted triplets are those of the triplet row.
    """
    g = tuple_keys(gold, pair=F.col("sentiment").isin(lx.SENTIMENTS) & F.coalesce("relation", F.lit(True)), auto=F.lit(True))
    p = tuple_keys(pred, auto=~F.coalesce("needs_human_review", F.lit(True)))
    scores = micro_prf(g, p, TUPLE_KEY, ["kind"])
    # one row per kind
    total = F.max(F.when(F.col("kind") == "triplet", F.col("tp") + F.col("fp"))).over(W.partitionBy())
    return scores.withColumn("_total", total).withColumn(
        "prediction_coverage", F.when(F.col("kind") == "auto_accepted", ratio(F.col("tp") + F.col("fp"), F.col("_total")))
    ).drop("_total")


def evidence_triplets(pred: DataFrame, key: str = "id") -> DataFrame:
    """(id, aspect span, opinion span, sentiment) from predictions with evidence lists."""
    return pred.where("aspect_start is not null").select(key, "aspect_start", "aspect_end", "sentiment", F.explode("opinion_evidence").alias("e")).select(
        key, "aspect_start", "aspect_end", F.col("e.start").alias("opinion_start"), F.col("e.end").alias("opinion_end"), "sentiment"
    ).where("opinion_start is not null and opinion_end is not null").distinct()


def method_counts(pred: DataFrame) -> DataFrame:
    return pred.groupBy(F.coalesce("relation_method", F.lit("unknown")).alias("method")).agg(F.count(F.lit(1)).alias("n"))


def class_report(rows: DataFrame, truth: str, guess: str, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 (one row per label, absent labels as zeros)."""
    cells = rows.groupBy(*by, F.col(truth).alias("y"), F.col(guess).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    names = F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")
    wide = cells.select(*by, "y", "p", "n", names)
    out = wide.groupBy(*by, "label").agg(
        F.sum(F.when((F.col("y") == F.col("label")) & (F.col("p") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("y") != F.col("label")) & (F.col("p") == F.col("label")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("y") == F.col("label")) & (F.col("p") != F.col("label")), F.col("n")).otherwise(0)).alias("fn"),
    )
    return prf_columns(out)


def macro_scores(report: DataFrame, by: Sequence[str] = (), present_only: bool = False) -> DataFrame:
    """Macro F1 and accuracy from a class report; optionally over the labels that occur."""
    base = report.where("support > 0") if present_only else report
    macro = base.groupBy(*by).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    total = report.groupBy(*by).agg(ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.sum("support").alias("n"))
    return macro.join(total, list(by)) if by else macro.join(F.broadcast(total))


def confusion(rows: DataFrame, truth: str, guess: str, labels: Sequence[str]) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth")).agg(*[F.count_if(F.col(guess) == v).alias(v) for v in labels])


def average_precision(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the precision-recall steps over the distinct scores, highest first."""
    points = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("all_"))
    run = running_over_scores(points, "s", ["pos", "all_"])
    total = points.agg(F.sum("pos").alias("_total"))
    step = run.join(F.broadcast(total)).select((F.col("pos") / F.col("_total") * (F.col("run_pos") / F.col("run_all_"))).alias("a"), "_total")
    return step.agg(F.sum(F.when(F.col("_total") > 0, F.col("a"))).alias("pr_auc"))


def pair_metrics(rows: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """One row: class scores, macro F1, balanced accuracy, MCC, composite and score statistics."""
    s, y = F.col(score), F.col(label)
    guess = s >= threshold
    c = rows.agg(
        F.count_if((y == 1) & guess).cast("double").alias("tp"), F.count_if((y == 0) & guess).cast("double").alias("fp"),
        F.count_if((y == 1) & ~guess).cast("double").alias("fn"), F.count_if((y == 0) & ~guess).cast("double").alias("tn"),
        F.min(s).alias("score_min"), F.max(s).alias("score_max"), F.stddev_pop(s).alias("score_std"),
    )
    return _pair_scores(c)


def _pair_scores(c: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "_f1_neg": ratio(2 * tn, 2 * tn + fp + fn), "positive_recall": ratio(tp, tp + fn), "negative_recall": ratio(tn, tn + fp),
        "predicted_related_fraction": ratio(tp + fp, tp + fp + fn + tn),
    })
    both = ((tp + fn) > 0) & ((tn + fp) > 0)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    c = c.withColumns({
        "macro_f1": (F.col("f1") + F.col("_f1_neg")) / 2,
        "balanced_accuracy": F.when(both, (F.col("positive_recall") + F.col("negative_recall")) / 2).otherwise(0.0),
        "mcc": F.when(both & (den > 0), (tp * tn - fp * fn) / den).otherwise(0.0),
    })
    return c.withColumn("composite", 0.45 * F.col("macro_f1") + 0.30 * F.col("balanced_accuracy") + 0.25 * F.greatest(F.lit(0.0), F.col("mcc"))).drop("_f1_neg")


def relation_gate(floor: float = 0.75, min_recall: float = 0.70) -> Column:
    return (
        (F.col("macro_f1") >= floor) & (F.col("balanced_accuracy") >= floor)
        & (F.least("negative_recall", "positive_recall") >= min_recall) & F.col("predicted_related_fraction").between(0.05, 0.95)
    )


def threshold_counts(rows: DataFrame, score: str, thresholds: Sequence[float], measures: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Sums of ``measures`` over the rows at or above each threshold.

    A row is counted once, in the highest threshold it reaches; the sums then
    run down over the few thresholds.  No row is repeated per threshold.
    """
    cuts = sorted(thresholds)
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in cuts]), lambda t: t <= F.col(score)))
    cells = rows.groupBy(*by, reached.alias("i")).agg(*[F.sum(m).alias(n) for n, m in measures.items()])
    grid = rows.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(cuts)], "i int, threshold double")
    if by:
        grid = cells.select(*by).distinct().join(F.broadcast(grid))
    full = grid.join(cells, [*by, "i"], "left").na.fill(0, list(measures))
    down = W.partitionBy(*by).orderBy(F.col("i").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return full.select(*by, "threshold", *[F.sum(n).over(down).alias(n) for n in measures])


def sweep_spans(gold: DataFrame, pred: DataFrame, key: Sequence[str], score: str, thresholds: Sequence[float], beta: float = 1.0, precision_floor: float = 0.0) -> DataFrame:
    """Span threshold sweep with F-beta; ``selected`` marks the best row that keeps the precision floor.

    Suppression of overlapping spans is greedy from the highest score, so spans
    suppressed once stay suppressed at every threshold: it runs before the sweep.
    """
    g = gold.select(*key, F.lit(1).alias("g"), F.lit(None).cast("double").alias("s"))
    p = pred.select(*key, F.lit(0).alias("g"), F.col(score).cast("double").alias("s"))
    cells = g.unionByName(p).groupBy(*key).agg(F.max("g").alias("g"), F.max("s").alias("s"))
    total = cells.agg(F.sum("g").alias("_gold"))
    counts = threshold_counts(cells.where("s is not null"), "s", thresholds, {"tp": F.col("g"), "fp": 1 - F.col("g")})
    table = prf_columns(counts.join(F.broadcast(total)).withColumn("fn", F.col("_gold") - F.col("tp")).drop("_gold"))
    b2 = beta * beta
    table = table.withColumn("fbeta", ratio((1 + b2) * F.col("precision") * F.col("recall"), b2 * F.col("precision") + F.col("recall")))
    ok = (F.col("precision") >= precision_floor).cast("int")
    order = W.orderBy(ok.desc(), F.col("fbeta").desc(), F.col("f1").desc(), F.col("precision").desc(), F.col("threshold"))
    return table.withColumn("selected", F.row_number().over(order) == 1)


def sweep_pairs(rows: DataFrame, score: str, label: str, thresholds: Sequence[float], floor: float = 0.75, min_recall: float = 0.70) -> DataFrame:
    """Pair threshold sweep on the composite score behind the gate."""
    y = F.col(label)
    totals = rows.agg(F.sum(y).cast("double").alias("_p"), F.sum(1 - y).cast("double").alias("_n"))
    c = threshold_counts(rows, score, thresholds, {"tp": y.cast("double"), "fp": (1 - y).cast("double")}).join(F.broadcast(totals))
    c = c.withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp")}).drop("_p", "_n")
    scored = _pair_scores(c).withColumn("gate", relation_gate(floor, min_recall))
    order = W.orderBy(F.col("gate").cast("int").desc(), F.col("composite").desc(), "threshold")
    return scored.withColumn("selected", F.col("gate") & (F.row_number().over(order) == 1))


def sweep_f1(rows: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Plain F1 sweep; ties go to the higher precision."""
    y = F.col(label)
    total = rows.agg(F.sum(y).alias("_p"))
    c = threshold_counts(rows, score, thresholds, {"tp": y, "fp": 1 - y}).join(F.broadcast(total)).withColumn("fn", F.col("_p") - F.col("tp")).drop("_p")
    order = W.orderBy(F.col("f1").desc(), F.col("precision").desc(), "threshold")
    return prf_columns(c).withColumn("selected", F.row_number().over(order) == 1)


def calibration(rows: DataFrame, score: str, correct: str, bins: int = 10, right_closed: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """n, expected calibration error and Brier score of a confidence column."""
    s, y = F.col(score), F.col(correct).cast("double")
    index = F.ceil(s * bins) - 1 if right_closed else F.least(F.floor(s * bins), F.lit(bins - 1))
    cells = rows.groupBy(*by, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("conf"), F.avg(y).alias("acc"), F.sum((s - y) * (s - y)).alias("sq"))
    return cells.groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum(F.when(F.col("bin") >= 0, F.col("n") * F.abs(F.col("conf") - F.col("acc"))).otherwise(0.0)) / F.sum("n")).alias("ece"),
        (F.sum("sq") / F.sum("n")).alias("brier"),
    )


def softmax(logits: Sequence[Column], temperature: float = 1.0) -> list[Column]:
    top = F.greatest(*logits)
    exps = [F.exp((x - top) / temperature) for x in logits]
    total = sum(exps[1:], exps[0])
    return [e / total for e in exps]


def multiclass_calibration(rows: DataFrame, logits: Sequence[str], label: str, temperature: float = 1.0, bins: int = 15) -> DataFrame:
    """ECE over the top class and the multiclass Brier score of a logits table."""
    probs = softmax([F.col(c) for c in logits], temperature)
    named = rows.select(F.array(*probs).alias("p"), F.col(label).alias("y"))
    named = named.select("p", "y", F.array_max("p").alias("conf"))
    named = named.withColumn("hit", (F.array_position("p", F.col("conf")) - 1 == F.col("y")).cast("int"))
    square = F.aggregate(
        F.transform("p", lambda x, i: F.pow(x - F.when(i == F.col("y"), 1.0).otherwise(0.0), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    ece = calibration(named, "conf", "hit", bins, right_closed=True).select("n", "ece")
    return ece.join(F.broadcast(named.agg(F.avg(square).alias("brier"))))


def selective_curve(rows: DataFrame, score: str, correct: str, thresholds: Sequence[float] = (0.0, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95)) -> DataFrame:
    """threshold, accepted, accepted precision and coverage."""
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    c = threshold_counts(rows, score, thresholds, {"accepted": F.lit(1), "hits": F.col(correct).cast("int")})
    return c.join(F.broadcast(total)).select(
        "threshold", "accepted", F.when(F.col("accepted") > 0, F.col("hits") / F.col("accepted")).alias("accepted_precision"),
        ratio(F.col("accepted"), F.col("_n")).alias("coverage"))


def selective_threshold(curve: DataFrame, precision: float = 0.85, coverage: float = 0.20, fallback: float = 0.80) -> DataFrame:
    """The lowest threshold that reaches both targets, else the fallback with its status."""
    ok = (F.col("accepted_precision") >= precision) & (F.col("coverage") >= coverage)
    best = curve.agg(F.min(F.when(ok, F.col("threshold"))).alias("t"))
    return best.select(
        F.coalesce("t", F.lit(fallback)).alias("threshold"),
        F.when(F.col("t").isNotNull(), "TARGET_MET_ON_VALIDATION").otherwise("FALLBACK_TARGET_NOT_MET").alias("status"))


def fit_temperature(rows: DataFrame, logits: Sequence[str], label: str, low: float = 0.05, high: float = 20.0, grid: int = 24, rounds: int = 4) -> float:
    """Temperature with the least mean negative log likelihood.

    Each round is one pass that sums the loss of a whole grid of temperatures;
    the next grid spans the neighbours of the best one.
    """
    cols = [F.col(c) for c in logits]
    picked = F.element_at(F.array(*cols), (F.col(label) + 1).cast("int"))
    top = F.greatest(*cols)
    for _ in range(rounds):
        step = (high / low) ** (1 / (grid - 1))
        temps = [low * step**i for i in range(grid)]
        sums = rows.agg(*[
            F.avg(F.ln(sum((F.exp((x - top) / t) for x in cols[1:]), F.exp((cols[0] - top) / t))) - (picked - top) / t).alias(f"t{i}") for i, t in enumerate(temps)
        ]).first()
        if sums[0] is None:
            return 1.0
        best = min(range(grid), key=lambda i: sums[i])
        low, high = temps[max(0, best - 1)], temps[min(grid - 1, best + 1)]
    return (low * high) ** 0.5


def by_dimension(rows: DataFrame, truth: str, guess: str, labels: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Per dimension value: n, macro F1, accuracy and the F1 of each label."""
    report = class_report(rows, truth, guess, labels, dims)
    wide = report.groupBy(*dims).agg(*[F.max(F.when(F.col("label") == v, F.col("f1"))).alias(f"{v}_f1") for v in labels])
    return macro_scores(report, dims).join(wide, list(dims))


def worst_and_macro(per_dim: DataFrame, metric: str = "macro_f1") -> DataFrame:
    return per_dim.agg(F.avg(metric).alias("macro_domain"), F.min(metric).alias("worst_domain"))


def operational_report(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Aspect, aspect+sentiment and relation F1, negative-complaint recall and taxonomy accuracy in one row.

    ``gold`` and ``pred`` hold id, aspect span, opinion span, sentiment and
    taxonomy key; predictions are unique on (id, aspect span, opinion span).
    """
    explicit = gold.where("aspect_start is not null")
    span = ["id", "aspect_start", "aspect_end"]
    a = micro_prf(explicit, pred, span).select(F.col("f1").alias("aspect_f1"))
    s = micro_prf(explicit.where(F.col("sentiment").isin(lx.SENTIMENTS)), pred, [*span, "sentiment"]).select(F.col("f1").alias("aspect_sentiment_f1"))
    pair = [*span, "opinion_start", "opinion_end"]
    r = micro_prf(explicit.where("opinion_start is not null and coalesce(relation, true)"), pred.where("opinion_start is not null"), pair).select(F.col("f1").alias("relation_f1"))
    per_span = pred.groupBy(*span).agg(F.max((F.col("sentiment") == "negative").cast("int")).alias("_neg"), F.min("taxonomy").alias("_tax"))
    joined = explicit.join(per_span, span, "left")
    o = joined.agg(
        ratio(F.count_if((F.col("sentiment") == "negative") & (F.col("_neg") == 1)), F.count_if(F.col("sentiment") == "negative")).alias("negative_complaint_recall"),
        ratio(F.count_if(F.col("taxonomy") == F.col("_tax")), F.count_if(F.coalesce("taxonomy", F.lit("")) != "")).alias("taxonomy_accuracy"),
    )
    return a.join(F.broadcast(s)).join(F.broadcast(r)).join(F.broadcast(o))


def error_table(gold: DataFrame, pred: DataFrame, coreference: str = "coreferent") -> DataFrame:
    """One row per error: missed or spurious aspect, wrong sentiment or taxonomy, relation, implicit and coreference failures.

    ``gold``: id, aspect span and term, opinion_term, sentiment, taxonomy,
    implicit and a boolean ``coreferent`` on the review text.  ``pred``: one row
    per (id, aspect span) with ``opinion_terms``.
    """
    span = ["id", "aspect_start", "aspect_end"]
    g = gold.where(F.col("sentiment").isin(lx.SENTIMENTS))
    implicit = F.coalesce("implicit", F.lit(False)) | F.col("aspect_start").isNull()
    p = pred.select(*span, F.col("sentiment").alias("pred_sentiment"), F.col("taxonomy").alias("pred_taxonomy"), F.col("opinion_terms").alias("pred_opinions"), F.lit(True).alias("_hit"))
    joined = g.join(p, span, "left")
    hit = F.coalesce("_hit", F.lit(False))
    lost_relation = hit & F.col("opinion_term").isNotNull() & ~F.coalesce(F.array_contains("pred_opinions", F.col("opinion_term")), F.lit(False))
    missed = ~implicit & ~hit
    kinds = F.array(
        F.when(implicit, "implicit aspect failure"), F.when(missed, "missed aspect"),
        F.when(~implicit & hit & (F.col("pred_sentiment") != F.col("sentiment")), "wrong sentiment"),
        F.when(~implicit & hit & ~F.col("pred_taxonomy").eqNullSafe(F.col("taxonomy")), "wrong taxonomy"),
        F.when(~implicit & lost_relation, "relation failure"),
        F.when((missed | (~implicit & lost_relation)) & F.col(coreference), "coreference failure"),
    )
    found = joined.select(*span, "sentiment", "pred_sentiment", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("error_type"))
    spurious = pred.join(g.where(~implicit).select(*span).distinct(), span, "left_anti").select(
        *span, F.lit(None).cast("string").alias("sentiment"), F.col("sentiment").alias("pred_sentiment"), F.lit("spurious aspect").alias("error_type"))
    return found.unionByName(spurious)


def set_jaccard(left: DataFrame, right: DataFrame, family: str, signature: Sequence[str]) -> DataFrame:
    """Per family: Jaccard similarity of the signature sets of two languages (1.0 if both are empty is left to the caller)."""
    flags = match_flags(left, right, [family, *signature])
    return flags.groupBy(family).agg(
        F.sum(F.col("in_gold") * F.col("in_pred")).alias("shared"), F.count(F.lit(1)).alias("union"),
    ).withColumn("jaccard", F.col("shared") / F.col("union"))


def parallel_families(records: DataFrame, left: str, right: str, family: str = "family_id", language: str = "language") -> DataFrame:
    """Families that exist in both languages, with one record id of each."""
    pair = records.where(F.col(language).isin(left, right)).groupBy(family).agg(
        F.min(F.when(F.col(language) == left, F.col("id"))).alias("left_id"), F.min(F.when(F.col(language) == right, F.col("id"))).alias("right_id"))
    return pair.where("left_id is not null and right_id is not null")


def majority_baseline(train: DataFrame, test: DataFrame, label: str, labels: Sequence[str]) -> DataFrame:
    """Accuracy and macro F1 of always answering the most frequent training label."""
    best = train.groupBy(F.col(label).alias("majority_label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "majority_label").limit(1).select("majority_label")
    guessed = test.select(F.col(label).alias("y")).join(F.broadcast(best))
    return macro_scores(class_report(guessed, "y", "majority_label", labels)).join(F.broadcast(best)).select("majority_label", "n", "accuracy", "macro_f1")


def gates(metrics: DataFrame, targets: dict[str, float]) -> DataFrame:
    """metric, value, target, gap, pass; a metric that was not measured fails."""
    dim = metrics.sparkSession.createDataFrame(list(targets.items()), "metric string, target double")
    out = dim.join(metrics, "metric", "left")
    return out.withColumns({"gap_to_target": F.col("target") - F.col("value"), "evaluated": F.col("value").isNotNull(), "pass": F.coalesce(F.col("value") >= F.col("target"), F.lit(False))})


def gate_status(gated: DataFrame) -> DataFrame:
    return gated.agg(F.bool_and("pass").alias("all_pass"), F.count_if(~F.col("pass")).alias("failed"))


PRIMARY = ["relation_macro_f1", "triplet_exact_f1", "negative_triplet_recall"]
COMPARABILITY = ["dataset_fingerprint", "split_fingerprint", "profile", "neutral_policy", "metric_schema"]


def promotion(candidate: DataFrame, baseline: DataFrame, required: Sequence[str] | None = None, tolerance: float = 0.0, seeds=("42", "52", "62")) -> DataFrame:
    """Paired per-seed comparison: (kind, metric, mean, std, paired_mean_delta, worst_seed_delta, passed).

    Inputs are long tables (seed, metric, value).  Metrics without all seeds on
    both sides come out as ``missing_metric``; a last row says whether any
    primary metric improved.
    """
    required = list(required or [*lx.RESEARCH_TARGETS, "opinion_exact_f1", "triplet_exact_f1", "negative_triplet_recall"])
    spark = candidate.sparkSession
    wanted = spark.createDataFrame([(m,) for m in required], "metric string")
    c = candidate.where(F.col("seed").isin(*seeds)).select("seed", "metric", F.col("value").alias("c"))
    b = baseline.where(F.col("seed").isin(*seeds)).select("seed", "metric", F.col("value").alias("b"))
    paired = c.join(b, ["seed", "metric"]).where(F.col("c").isNotNull() & F.col("b").isNotNull() & ~F.isnan("c") & ~F.isnan("b") & (F.abs("c") < float("inf")) & (F.abs("b") < float("inf")))
    stats = paired.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean"), F.stddev_samp("c").alias("std"), F.avg(F.col("c") - F.col("b")).alias("paired_mean_delta"),
        F.min(F.col("c") - F.col("b")).alias("worst_seed_delta"))
    rows = wanted.join(stats, "metric", "left").select(
        F.when(F.coalesce("n", F.lit(0)) == len(seeds), "metric").otherwise("missing_metric").alias("kind"), "metric", "mean", "std", "paired_mean_delta", "worst_seed_delta",
        (F.coalesce(F.col("n") == len(seeds), F.lit(False)) & F.coalesce(F.col("worst_seed_delta") >= -tolerance, F.lit(False))).alias("passed"))
    improved = rows.where(F.col("metric").isin(PRIMARY) & (F.col("kind") == "metric")).agg(
        F.lit("primary_improvement").alias("kind"), F.lit("any").alias("metric"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"),
        F.max("paired_mean_delta").alias("paired_mean_delta"), F.lit(None).cast("double").alias("worst_seed_delta"),
        F.coalesce(F.max("paired_mean_delta") > tolerance, F.lit(False)).alias("passed"))
    return rows.unionByName(improved)


def comparability(candidate: dict, baseline: dict) -> list[str]:
    """Names of the run properties that make two reports incomparable."""
    return [f"incomparable_{k}" for k in COMPARABILITY if not candidate.get(k) or candidate.get(k) != baseline.get(k)]


def fit_diagnosis(history: DataFrame, validation_f1: float | None = None, test_f1: float | None = None, max_gap: float = 0.12, by: Sequence[str] = ()) -> DataFrame:
    """Overfit, generalisation-gap and underfit flags of a training history (epoch, train_loss, validation_loss)."""
    known = F.col("validation_loss").isNotNull()
    h = history.groupBy(*by).agg(
        F.min("validation_loss").alias("best_val_loss"), F.max_by("validation_loss", F.when(known, F.col("epoch"))).alias("last_val_loss"),
        F.count("validation_loss").alias("points"), F.max_by("train_loss", F.when(F.col("train_loss").isNotNull(), F.col("epoch"))).alias("last_train_loss"))
    gap = F.lit(validation_f1 - test_f1 if validation_f1 is not None and test_f1 is not None else None).cast("double")
    out = h.withColumns({
        "curve_overfit": (F.col("points") >= 2) & F.coalesce(F.col("last_val_loss") > F.col("best_val_loss") * 1.10, F.lit(False)),
        "gap_overfit": F.coalesce(gap > max_gap, F.lit(False)),
        "underfit": F.lit(validation_f1 is not None and validation_f1 < 0.45) & F.coalesce(F.col("last_train_loss") > 0.80, F.lit(True)),
    })
    return out.withColumn("status", F.when(F.col("curve_overfit") | F.col("gap_overfit"), "OVERFIT_RISK").when(F.col("underfit"), "UNDERFIT_OR_DATA_LIMITATION_RISK").otherwise("NO_STRONG_FIT_PATHOLOGY_DETECTED"))


def checkpoint_scores(history: DataFrame, run: Sequence[str], weights=None, tolerance: float = 0.05) -> DataFrame:
    """Weighted F1s minus half the loss excess over the best loss seen so far in the run."""
    w = weights or lx.CHECKPOINT_WEIGHTS
    seen = W.partitionBy(*run).orderBy("epoch").rowsBetween(W.unboundedPreceding, W.currentRow)
    base = sum((F.lit(v) * F.col(k) for k, v in list(w.items())[1:]), F.lit(list(w.values())[0]) * F.col(list(w)[0]))
    excess = F.greatest(F.lit(0.0), F.col("validation_loss") - F.min("validation_loss").over(seen) - tolerance)
    return history.withColumn("checkpoint_score", base - 0.5 * excess)


def long_metrics(parts: dict[tuple[str, str], DataFrame], scope: str) -> DataFrame:
    """One canonical table (component, metric, columns of the part, scope) from differently shaped reports."""
    out = None
    for (component, metric), frame in parts.items():
        named = frame.withColumns({"component": F.lit(component), "metric": F.lit(metric) if metric else F.col("label"), "scope": F.lit(scope)})
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out
