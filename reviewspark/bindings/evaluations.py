"""Evaluation reports: gold annotations of the documents against perturbed predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewspark import lexicons as lx
from reviewspark.bindings.audits import ann_rows
from reviewspark.bindings.common import OPINION_RE, SQL_ANNOTATED, annotated, documents, reviews
from reviewspark.functions import text as tx
from reviewspark.functions.spans import find_spans
from reviewspark.operators import evaluation as ev
from reviewspark.registry import query, table
from reviewspark.scale import computed
from reviewspark.session import cut_lineage

SQL_GP = SQL_ANNOTATED + """,
gold AS (SELECT id, s, e, (e + 1)::INTEGER AS os, (e + 5)::INTEGER AS oe, sentiment, lower(term) AS tax, s % 6 <> 0 AS rel FROM ann),
pred AS (
  SELECT id, s, (CASE WHEN s % 10 = 0 THEN e + 1 ELSE e END)::INTEGER AS e, (e + 1)::INTEGER AS os, (e + 5)::INTEGER AS oe,
    CASE WHEN s % 4 = 0 THEN 'positive' ELSE sentiment END AS sentiment, CASE WHEN s % 8 = 0 THEN 'other' ELSE lower(term) END AS tax, round((s % 101) / 100.0::DOUBLE, 2) AS conf, s % 5 = 0 AS review FROM ann WHERE s % 7 <> 0
  UNION ALL SELECT doc_id::VARCHAR, s, e, e + 2, e + 6, 'negative', 'spurious', round((s % 101) / 100.0::DOUBLE, 2), TRUE FROM opn WHERE s % 9 = 0)"""


def gold_and_pred(spark, sf):
    """Gold rows and perturbed predictions; both are read several times, the texts behind them once."""
    r = annotated(spark, sf).withColumn("annotations", F.transform("annotations", lambda a: F.struct(
        a["aspect_start"].alias("aspect_start"), a["aspect_end"].alias("aspect_end"), tx.canonical_sentiment(a["sentiment"]).alias("sentiment"), a["aspect_term"].alias("aspect_term"),
        a["annotation_confidence"].alias("annotation_confidence"), a["implicit"].alias("implicit"))))
    opinions = F.transform(find_spans(F.col("text"), OPINION_RE), lambda o: F.struct(o["start"].alias("aspect_start"), o["end"].alias("aspect_end")))
    found = cut_lineage(computed(r, {"opinions": opinions}).select("id", "domain", "language", "split", "annotations", "opinions"))
    gold = found.select("id", "domain", "language", "split", F.explode("annotations").alias("a")).select("id", "domain", "language", "split", "a.*").select(
        "id", "domain", "language", "split", "aspect_start", "aspect_end", (F.col("aspect_end") + 1).alias("opinion_start"), (F.col("aspect_end") + 5).alias("opinion_end"),
        "sentiment", F.lower("aspect_term").alias("taxonomy"), (F.col("aspect_start") % 6 != 0).alias("relation"), "aspect_term", "annotation_confidence", "implicit")
    s = F.col("aspect_start")
    conf = F.round((s % 101) / F.lit(100.0), 2)
    kept = gold.where(s % 7 != 0).select(
        "id", "aspect_start", F.when(s % 10 == 0, F.col("aspect_end") + 1).otherwise(F.col("aspect_end")).alias("aspect_end"), "opinion_start", "opinion_end",
        F.when(s % 4 == 0, "positive").otherwise(F.col("sentiment")).alias("sentiment"), F.when(s % 8 == 0, "other").otherwise(F.col("taxonomy")).alias("taxonomy"),
        conf.alias("overall_confidence"), (s % 5 == 0).alias("needs_human_review"))
    o = found.select("id", F.explode("opinions").alias("o")).select("id", "o.*").where(s % 9 == 0)
    extra = o.select("id", "aspect_start", "aspect_end", (F.col("aspect_end") + 2).alias("opinion_start"), (F.col("aspect_end") + 6).alias("opinion_end"),
                     F.lit("negative").alias("sentiment"), F.lit("spurious").alias("taxonomy"), conf.alias("overall_confidence"), F.lit(True).alias("needs_human_review"))
    return gold, kept.unionByName(extra)


def _r(df, *cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _sql_prf(g, p, prefix="", extra=""):
    return f"""(SELECT {extra} tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 9) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 9) AS recall,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 9) AS f1, tp + fn AS support FROM
 (SELECT (SELECT count(*) FROM ({g} INTERSECT {p})) AS tp, (SELECT count(*) FROM ({p} EXCEPT {g})) AS fp, (SELECT count(*) FROM ({g} EXCEPT {p})) AS fn))"""


@query("evl_micro_prf", f"WITH {SQL_GP} SELECT * FROM " + _sql_prf("SELECT id, s, e, sentiment FROM gold", "SELECT id, s, e, sentiment FROM pred"))
def micro_prf(spark, sf):
    g, p = gold_and_pred(spark, sf)
    return _r(ev.micro_prf(g, p, ["id", "aspect_start", "aspect_end", "sentiment"]), "precision", "recall", "f1")


_GT = "SELECT id, s, e, os, oe, sentiment FROM gold WHERE rel"


@query("evl_exact_by_kind", f"""WITH {SQL_GP},
u AS (SELECT * FROM {_sql_prf("SELECT id, s, e FROM gold", "SELECT id, s, e FROM pred", extra="'aspect' AS kind,")}
UNION ALL SELECT * FROM {_sql_prf("SELECT id, os, oe FROM gold", "SELECT id, os, oe FROM pred", extra="'opinion' AS kind,")}
UNION ALL SELECT * FROM {_sql_prf("SELECT id, s, e, os, oe FROM gold WHERE rel", "SELECT id, s, e, os, oe FROM pred", extra="'pair' AS kind,")}
UNION ALL SELECT * FROM {_sql_prf(_GT, "SELECT id, s, e, os, oe, sentiment FROM pred", extra="'triplet' AS kind,")}
UNION ALL SELECT * FROM {_sql_prf(_GT + " AND sentiment = 'negative'", "SELECT id, s, e, os, oe, sentiment FROM pred WHERE sentiment = 'negative'", extra="'negative_triplet' AS kind,")}
UNION ALL SELECT * FROM {_sql_prf(_GT, "SELECT id, s, e, os, oe, sentiment FROM pred WHERE NOT review", extra="'auto_accepted' AS kind,")})
SELECT *, round(CASE WHEN kind = 'auto_accepted' THEN (tp + fp) / (SELECT count(*) FROM (SELECT DISTINCT id, s, e, os, oe, sentiment FROM pred))::DOUBLE ELSE -1 END, 9) AS coverage FROM u""")
def exact_by_kind(spark, sf):
    out = ev.exact_evaluation(*gold_and_pred(spark, sf))
    return _r(out.withColumn("coverage", F.coalesce("prediction_coverage", F.lit(-1.0))).drop("prediction_coverage"), "precision", "recall", "f1", "coverage")


@query("evl_evidence_triplets", f"""WITH {SQL_GP} SELECT * FROM {_sql_prf("SELECT id, s, e, os, oe, sentiment FROM gold WHERE id IN (SELECT id FROM reviews WHERE language <> 'en')",
 "SELECT id, s, e, os, oe, sentiment FROM pred WHERE id IN (SELECT id FROM reviews WHERE language <> 'en')")}""")
def evidence_triplets(spark, sf):
    g, p = gold_and_pred(spark, sf)
    p = p.join(reviews(spark, sf).where("language <> 'en'").select("id"), "id", "left_semi").withColumn(
        "opinion_evidence", F.array(F.struct(F.col("opinion_start").alias("start"), F.col("opinion_end").alias("end"))))
    key = ["id", "aspect_start", "aspect_end", "opinion_start", "opinion_end", "sentiment"]
    return _r(ev.micro_prf(g.where("language <> 'en'").select(*key), ev.evidence_triplets(p), key), "precision", "recall", "f1")


# class truth and guess per order, for the class reports
_Y = "CASE o_orderstatus WHEN 'F' THEN 'positive' WHEN 'O' THEN 'negative' ELSE 'neutral' END"
_P = "CASE WHEN o_orderkey % 5 = 0 THEN 'positive' WHEN o_orderkey % 11 = 0 THEN 'neutral' ELSE " + _Y + " END"


def labelled(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.expr(_Y).alias("y"), F.expr(_P).alias("p"), "o_totalprice")


def _sql_class(dim="", src="SELECT o_orderpriority, " + _Y + " AS y, " + _P + " AS p FROM orders"):
    d = dim + ", " if dim else ""
    g = f"GROUP BY {d} l" if dim else "GROUP BY l"
    return f"""x AS ({src}), c AS (SELECT {d} l AS label, count(*) FILTER (y = l AND p = l) AS tp, count(*) FILTER (y <> l AND p = l) AS fp, count(*) FILTER (y = l AND p <> l) AS fn
 FROM x, (VALUES ('positive'), ('negative'), ('neutral')) v(l) {g}),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS prec, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS rec, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f FROM c)"""


@query("evl_class_report", f"""WITH {_sql_class()}
SELECT label, tp, fp, fn, round(prec, 9) AS "precision", round(rec, 9) AS recall, round(f, 9) AS f1, tp + fn AS support FROM r
UNION ALL SELECT 'macro', sum(tp)::BIGINT, 0, 0, round(avg(prec), 9), round(avg(rec), 9), round(avg(f), 9), sum(tp + fn)::BIGINT FROM r""")
def class_report(spark, sf):
    rep = ev.class_report(labelled(spark, sf), "y", "p", lx.SENTIMENTS)
    m = ev.macro_scores(rep).select(
        F.lit("macro").alias("label"), F.bround(F.col("accuracy") * F.col("n"), 0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("fn"),
        F.col("macro_precision").alias("precision"), F.col("macro_recall").alias("recall"), F.col("macro_f1").alias("f1"), F.col("n").alias("support"))
    return _r(rep.unionByName(m), "precision", "recall", "f1")


@query("evl_confusion", f"SELECT y AS truth, count(*) FILTER (p = 'positive') AS positive, count(*) FILTER (p = 'negative') AS negative, count(*) FILTER (p = 'neutral') AS neutral FROM (SELECT {_Y} AS y, {_P} AS p FROM orders) GROUP BY 1")
def confusion(spark, sf):
    return ev.confusion(labelled(spark, sf), "y", "p", lx.SENTIMENTS)


# scores in [0, 1] per line item; the label follows the discount
_S = "round(((l_orderkey * 7 + l_linenumber * 13) % 997) / 997.0, 4)"
_L = "CASE WHEN l_returnflag = 'R' OR (l_orderkey * 7 + l_linenumber * 13) % 997 > 700 THEN 1 ELSE 0 END"
_SQLS = _S.replace("997.0", "997.0::DOUBLE")


def scored(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_S.replace("997.0", "997.0D")).alias("s"), F.expr(_L).alias("y"), "l_returnflag")


@query("evl_pair_metrics", f"""
WITH x AS (SELECT {_SQLS} AS s, {_L} AS y FROM lineitem), c AS (SELECT (count(*) FILTER (y=1 AND s>=0.5))::DOUBLE AS tp, (count(*) FILTER (y=0 AND s>=0.5))::DOUBLE AS fp, (count(*) FILTER (y=1 AND s<0.5))::DOUBLE AS fn, (count(*) FILTER (y=0 AND s<0.5))::DOUBLE AS tn,
  stddev_pop(s) AS sd FROM x),
d AS (SELECT s, sum(y) AS pos, count(*) AS n FROM x GROUP BY 1), w AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS rp, sum(n) OVER (ORDER BY s DESC) AS rn FROM d)
SELECT round(2*tp/(2*tp+fp+fn), 9) AS f1, round((2*tp/(2*tp+fp+fn) + 2*tn/(2*tn+fp+fn)) / 2, 9) AS macro_f1, round((tp/(tp+fn) + tn/(tn+fp)) / 2, 9) AS balanced_accuracy,
 round((tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)), 9) AS mcc, round(sd, 6) AS score_std, (SELECT round(sum(pos / (SELECT sum(pos) FROM d)::DOUBLE * rp / rn::DOUBLE), 9) FROM w) AS pr_auc FROM c""")
def pair_metrics(spark, sf):
    rows = scored(spark, sf)
    m = ev.pair_metrics(rows, "s", "y").join(ev.average_precision(rows, "s", "y"))
    return m.select(*[F.round(c, 9).alias(c) for c in ("f1", "macro_f1", "balanced_accuracy", "mcc")], F.round("score_std", 6).alias("score_std"), F.round("pr_auc", 9).alias("pr_auc"))


@query("evl_threshold_sweeps", f"""
WITH {SQL_GP}, t AS (SELECT (10 + 5 * i) / 100.0::DOUBLE AS threshold FROM range(17) r(i)),
p AS (SELECT id, s, e, max(conf) AS c FROM pred GROUP BY ALL), gs AS (SELECT DISTINCT id, s, e FROM gold),
m AS (SELECT p.*, (gs.id IS NOT NULL)::INT AS g FROM p LEFT JOIN gs USING (id, s, e)),
k AS (SELECT threshold, sum(g) AS tp, sum(1 - g) AS fp, (SELECT count(*) FROM gs) - sum(g) AS fn FROM t JOIN m ON m.c >= threshold GROUP BY 1)
SELECT 'span' AS sweep, threshold, tp::DOUBLE AS tp, fp::DOUBLE AS fp, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1 FROM k
UNION ALL SELECT 'pair', threshold, sum(y)::DOUBLE, sum(1 - y)::DOUBLE, round(2 * sum(y) / (2 * sum(y) + sum(1 - y) + (SELECT sum({_L}) FROM lineitem) - sum(y))::DOUBLE, 9)
 FROM (SELECT (20 + 2 * i) / 100.0::DOUBLE AS threshold FROM range(31) r(i)) JOIN (SELECT {_SQLS} AS s, {_L} AS y FROM lineitem) ON s >= threshold GROUP BY threshold""")
def threshold_sweeps(spark, sf):
    span = ["id", "aspect_start", "aspect_end"]
    a = ev.sweep_spans(*gold_and_pred(spark, sf), span, "overall_confidence", [round(0.1 + 0.05 * i, 2) for i in range(17)])
    b = ev.sweep_pairs(scored(spark, sf), "s", "y", [round(0.2 + 0.02 * i, 2) for i in range(31)])
    cols = ["threshold", F.col("tp").cast("double").alias("tp"), F.col("fp").cast("double").alias("fp"), F.round("f1", 9).alias("f1")]
    return a.select(F.lit("span").alias("sweep"), *cols).union(b.select(F.lit("pair"), *cols))


@query("evl_calibration", f"""
WITH x AS (SELECT l_returnflag, {_SQLS} AS s, {_L} AS y FROM lineitem), b AS (SELECT l_returnflag, least(floor(s * 10), 9) AS bin, count(*) AS n, avg(s) AS c, avg(y) AS a, sum((s - y) * (s - y)) AS q FROM x GROUP BY ALL)
SELECT l_returnflag, sum(n)::BIGINT AS n, round(sum(n * abs(c - a)) / sum(n), 9) AS ece, round(sum(q) / sum(n), 9) AS brier FROM b GROUP BY 1""")
def calibration(spark, sf):
    return _r(ev.calibration(scored(spark, sf), "s", "y", by=["l_returnflag"]), "ece", "brier")


_LOGITS = "SELECT vec_id, embedding[1]::DOUBLE * 8 AS a, embedding[2]::DOUBLE * 8 AS b, embedding[3]::DOUBLE * 8 AS c, label % 3 AS y FROM embeddings"


def logits(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", *[(e[i].cast("double") * 8).alias(n) for i, n in enumerate("abc")], (F.col("label") % 3).alias("y"))


@query("evl_multiclass_calibration", f"""
WITH x AS ({_LOGITS}), e AS (SELECT y, a, b, c, exp((a - m) / 1.5) AS ea, exp((b - m) / 1.5) AS eb, exp((c - m) / 1.5) AS ec FROM (SELECT *, greatest(a, b, c) AS m FROM x)),
p AS (SELECT y, ea / (ea + eb + ec) AS pa, eb / (ea + eb + ec) AS pb, ec / (ea + eb + ec) AS pc FROM e),
t AS (SELECT *, greatest(pa, pb, pc) AS conf, (CASE WHEN pa >= pb AND pa >= pc THEN 0 WHEN pb >= pc THEN 1 ELSE 2 END = y)::INT AS hit FROM p),
g AS (SELECT ceil(conf * 15) AS bin, count(*) AS n, avg(conf) AS c, avg(hit) AS h FROM t GROUP BY 1)
SELECT (SELECT count(*) FROM t) AS n, (SELECT round(sum(n * abs(c - h)) / sum(n), 9) FROM g) AS ece,
 (SELECT round(avg(pow(pa - (y = 0)::INT, 2) + pow(pb - (y = 1)::INT, 2) + pow(pc - (y = 2)::INT, 2)), 9) FROM t) AS brier""")
def multiclass_calibration(spark, sf):
    return _r(ev.multiclass_calibration(logits(spark, sf), ["a", "b", "c"], "y", 1.5), "ece", "brier")


@query("evl_temperature")
def temperature(spark, sf):
    rows = logits(spark, sf)
    t = ev.fit_temperature(rows, ["a", "b", "c"], "y")
    return ev.multiclass_calibration(rows, ["a", "b", "c"], "y", t).withColumn("temperature", F.lit(t))


@query("evl_selective_curve", f"""
WITH x AS (SELECT {_SQLS} AS s, {_L} AS y FROM lineitem), c AS (SELECT t AS threshold, count(*) AS accepted, avg(y) AS p, count(*) / (SELECT count(*) FROM x)::DOUBLE AS cov FROM (VALUES (0.0), (0.5), (0.6), (0.7), (0.8), (0.85), (0.9), (0.95)) v(t) JOIN x ON s >= t GROUP BY 1)
SELECT threshold::DOUBLE AS threshold, accepted, round(p, 9) AS accepted_precision, round(cov, 9) AS coverage, (SELECT min(threshold) FROM c WHERE p >= 0.85 AND cov >= 0.2)::DOUBLE AS selected FROM c""")
def selective_curve(spark, sf):
    c = ev.selective_curve(scored(spark, sf), "s", "y")
    pick = ev.selective_threshold(c).select(F.col("threshold").alias("selected"))
    return _r(c.join(F.broadcast(pick)), "accepted_precision", "coverage")


@query("evl_by_dimension", f"""WITH {_sql_class('o_orderpriority')},
d AS (SELECT o_orderpriority, avg(f) AS m, sum(tp) / sum(tp + fn)::DOUBLE AS acc, sum(tp + fn)::BIGINT AS n, max(f) FILTER (label = 'neutral') AS nf FROM r GROUP BY 1)
SELECT o_orderpriority, round(m, 9) AS macro_f1, round(acc, 9) AS accuracy, n, round(nf, 9) AS neutral_f1, (SELECT round(min(m), 9) FROM d) AS worst_domain, (SELECT round(avg(m), 9) FROM d) AS macro_domain FROM d""")
def by_dimension(spark, sf):
    d = ev.by_dimension(labelled(spark, sf), "y", "p", lx.SENTIMENTS, ["o_orderpriority"])
    out = d.join(F.broadcast(ev.worst_and_macro(d))).select("o_orderpriority", "macro_f1", "accuracy", "n", "neutral_f1", "worst_domain", "macro_domain")
    return _r(out, "macro_f1", "accuracy", "neutral_f1", "worst_domain", "macro_domain")


@query("evl_operational", f"""WITH {SQL_GP},
ps AS (SELECT id, s, e, max((sentiment = 'negative')::INT) AS neg, min(tax) AS tax FROM pred GROUP BY ALL),
j AS (SELECT g.sentiment, g.tax AS gt, ps.neg, ps.tax AS pt FROM gold g LEFT JOIN ps USING (id, s, e))
SELECT (SELECT f1 FROM {_sql_prf("SELECT id, s, e FROM gold", "SELECT id, s, e FROM pred")}) AS aspect_f1,
 (SELECT f1 FROM {_sql_prf("SELECT id, s, e, sentiment FROM gold", "SELECT id, s, e, sentiment FROM pred")}) AS aspect_sentiment_f1,
 (SELECT f1 FROM {_sql_prf("SELECT id, s, e, os, oe FROM gold WHERE rel", "SELECT id, s, e, os, oe FROM pred")}) AS relation_f1,
 (SELECT round(count(*) FILTER (sentiment = 'negative' AND neg = 1) / count(*) FILTER (sentiment = 'negative')::DOUBLE, 9) FROM j) AS negative_complaint_recall,
 (SELECT round(count(*) FILTER (gt = pt) / count(*)::DOUBLE, 9) FROM j) AS taxonomy_accuracy""")
def operational(spark, sf):
    out = ev.operational_report(*gold_and_pred(spark, sf))
    return _r(out, *out.columns)


@query("evl_error_types", f"""WITH {SQL_GP},
pp AS (SELECT DISTINCT id, s, e, sentiment, tax, os FROM pred), g AS (SELECT gold.*, r.doc_id % 2 = 0 AS coref, CASE WHEN gold.s % 13 = 0 THEN 'x' ELSE 'o' || os END AS term FROM gold JOIN reviews r USING (id)),
j AS (SELECT g.*, p.sentiment AS ps, p.tax AS pt, p.id IS NOT NULL AS hit FROM g LEFT JOIN pp p USING (id, s, e)),
x AS (SELECT 'missed aspect' AS error_type FROM j WHERE NOT hit UNION ALL SELECT 'wrong sentiment' FROM j WHERE hit AND ps <> sentiment UNION ALL SELECT 'wrong taxonomy' FROM j WHERE hit AND pt IS DISTINCT FROM tax
 UNION ALL SELECT 'relation failure' FROM j WHERE hit AND term = 'x' UNION ALL SELECT 'coreference failure' FROM j WHERE coref AND (NOT hit OR term = 'x')
 UNION ALL SELECT 'spurious aspect' FROM pp WHERE (id, s, e) NOT IN (SELECT id, s, e FROM gold))
SELECT error_type, count(*) AS n FROM x GROUP BY 1""")
def error_types(spark, sf):
    g, p = gold_and_pred(spark, sf)
    g = g.withColumns({
        "opinion_term": F.when(F.col("aspect_start") % 13 == 0, "x").otherwise(F.concat(F.lit("o"), F.col("opinion_start").cast("string"))), "coreferent": F.col("id").cast("bigint") % 2 == 0})
    p = p.withColumn("opinion_terms", F.array(F.concat(F.lit("o"), F.col("opinion_start").cast("string"))))
    return ev.error_table(g, p).groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


@query("evl_family_consistency", f"""WITH {SQL_ANNOTATED},
x AS (SELECT a.doc_id // 2 AS fam, a.doc_id % 2 AS side, lower(term) AS tax, sentiment FROM ann a), l AS (SELECT DISTINCT fam, tax, sentiment FROM x WHERE side = 0), r AS (SELECT DISTINCT fam, tax, sentiment FROM x WHERE side = 1),
u AS (SELECT fam, tax, sentiment FROM l UNION SELECT fam, tax, sentiment FROM r), i AS (SELECT fam, tax, sentiment FROM l INTERSECT SELECT fam, tax, sentiment FROM r)
SELECT fam AS family_id, (SELECT count(*) FROM i WHERE i.fam = u.fam) AS shared, count(*) AS "union", round((SELECT count(*) FROM i WHERE i.fam = u.fam) / count(*)::DOUBLE, 9) AS jaccard FROM u GROUP BY fam""")
def family_consistency(spark, sf):
    a = ann_rows(spark, sf).select((F.floor(F.col("doc_id") / 2)).alias("family_id"), (F.col("doc_id") % 2).alias("side"), F.lower("aspect_term").alias("tax"), "sentiment")
    j = ev.set_jaccard(a.where("side = 0"), a.where("side = 1"), "family_id", ["tax", "sentiment"])
    return j.withColumn("shared", F.col("shared").cast("bigint")).withColumn("jaccard", F.round("jaccard", 9))


@query("jn_parallel_families", "SELECT doc_id // 4 AS family_id, min(doc_id::VARCHAR) FILTER (lang = 'en') AS left_id, min(doc_id::VARCHAR) FILTER (lang = 'fr') AS right_id FROM documents GROUP BY 1 HAVING count(*) FILTER (lang = 'en') > 0 AND count(*) FILTER (lang = 'fr') > 0")
def parallel_families(spark, sf):
    d = reviews(spark, sf).withColumn("family_id", F.floor(F.col("doc_id") / 4))
    return ev.parallel_families(d, "en", "fr")


@query("evl_majority_baseline", f"""
WITH tr AS (SELECT {_Y} AS y FROM orders WHERE o_orderkey % 10 < 8), te AS (SELECT {_Y} AS y FROM orders WHERE o_orderkey % 10 >= 8), m AS (SELECT y AS m FROM tr GROUP BY 1 ORDER BY count(*) DESC, y LIMIT 1),
c AS (SELECT count(*) FILTER (y = m) AS hit, count(*) AS n FROM te, m)
SELECT (SELECT m FROM m) AS majority_label, n, round(hit / n::DOUBLE, 9) AS accuracy, round(2 * hit / (n + hit)::DOUBLE / 3, 9) AS macro_f1 FROM c""")
def majority_baseline(spark, sf):
    x = labelled(spark, sf)
    return _r(ev.majority_baseline(x.where("o_orderkey % 10 < 8"), x.where("o_orderkey % 10 >= 8"), "y", lx.SENTIMENTS), "accuracy", "macro_f1")


@query("evl_gates", f"""WITH {_sql_class()}, v AS (SELECT label || '_f1' AS metric, f AS value FROM r UNION ALL SELECT 'sentiment_macro_f1', avg(f) FROM r), t(metric, target) AS (VALUES ('sentiment_macro_f1', 0.80), ('positive_f1', 0.90), ('negative_f1', 0.84), ('neutral_f1', 0.68), ('aspect_exact_f1', 0.74), ('aspect_sentiment_f1', 0.68), ('relation_macro_f1', 0.75), ('relation_balanced_accuracy', 0.75), ('macro_domain_f1', 0.72), ('worst_domain_f1', 0.62))
SELECT metric, round(coalesce(value, -1), 9) AS value, target::DOUBLE AS target, round(coalesce(target - value, -1), 9)::DOUBLE AS gap_to_target, value IS NOT NULL AS evaluated, coalesce(value >= target, FALSE) AS pass FROM t LEFT JOIN v USING (metric)""")
def gates(spark, sf):
    rep = ev.class_report(labelled(spark, sf), "y", "p", lx.SENTIMENTS)
    m = rep.select(F.concat("label", F.lit("_f1")).alias("metric"), F.col("f1").alias("value")).union(ev.macro_scores(rep).select(F.lit("sentiment_macro_f1"), "macro_f1"))
    return _r(ev.gates(m, lx.RESEARCH_TARGETS).na.fill(-1.0, ["value", "gap_to_target"]), "value", "gap_to_target")


@query("evl_promotion", """
WITH c AS (SELECT (CASE user_id % 3 WHEN 0 THEN '42' WHEN 1 THEN '52' ELSE '62' END) AS seed, event_type AS metric, avg(value) / 100 AS c, avg(CASE WHEN event_id % 2 = 0 THEN value END) / 100 AS b FROM events WHERE NOT (event_type = 'view' AND user_id % 3 = 1) GROUP BY ALL),
s AS (SELECT metric, count(*) AS n, avg(c) AS mean, stddev_samp(c) AS sd, avg(c - b) AS d, min(c - b) AS w FROM c GROUP BY 1)
SELECT CASE WHEN n = 3 THEN 'metric' ELSE 'missing_metric' END AS kind, metric, round(mean, 9) AS mean, round(sd, 9) AS std, round(d, 9) AS paired_mean_delta, round(w, 9) AS worst_seed_delta, n = 3 AND w >= -0.05 AS passed FROM s""")
def promotion(spark, sf):
    e = table(spark, sf, "events").where("not (event_type = 'view' and user_id % 3 = 1)").withColumn("seed", F.expr("CASE user_id % 3 WHEN 0 THEN '42' WHEN 1 THEN '52' ELSE '62' END"))
    runs = e.groupBy("seed", F.col("event_type").alias("metric")).agg((F.avg("value") / 100).alias("c"), (F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))) / 100).alias("b"))
    metrics = ["click", "error", "purchase", "scroll", "view", "login", "logout", "signup"]
    out = ev.promotion(runs.select("seed", "metric", F.col("c").alias("value")), runs.select("seed", "metric", F.col("b").alias("value")), metrics, 0.05)
    out = out.where("kind <> 'primary_improvement' and mean is not null")
    return _r(out, "mean", "std", "paired_mean_delta", "worst_seed_delta")


# a training history per customer: epochs ordered by order key
_HIST = "SELECT o_custkey % 50 AS run, o_orderkey AS epoch, o_totalprice / 100000 AS validation_loss, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice / 200000 END AS train_loss FROM orders"


def history(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("run"), F.col("o_orderkey").alias("epoch"), (F.col("o_totalprice") / 100000).alias("validation_loss"),
                                             F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") / 200000).alias("train_loss"))


@query("evl_fit_diagnosis", f"""WITH h AS ({_HIST}), s AS (SELECT run, min(validation_loss) AS best, arg_max(validation_loss, epoch) AS last, arg_max(train_loss, epoch) FILTER (train_loss IS NOT NULL) AS lt FROM h GROUP BY 1)
SELECT run, round(best, 9) AS best_val_loss, round(last, 9) AS last_val_loss, CASE WHEN last > best * 1.10 THEN 'OVERFIT_RISK' WHEN lt > 0.8 THEN 'UNDERFIT_OR_DATA_LIMITATION_RISK' ELSE 'NO_STRONG_FIT_PATHOLOGY_DETECTED' END AS status FROM s""")
def fit_diagnosis(spark, sf):
    return _r(ev.fit_diagnosis(history(spark, sf), 0.40, 0.39, by=["run"]).select("run", "best_val_loss", "last_val_loss", "status"), "best_val_loss", "last_val_loss")


@query("evl_checkpoint_scores", f"""WITH h AS ({_HIST}), m AS (SELECT *, validation_loss / 10 AS x, min(validation_loss) OVER (PARTITION BY run ORDER BY epoch) AS seen FROM h)
SELECT run, epoch, round(0.45 * x + 0.30 * x * x + 0.20 * x + 0.05 - 0.5 * greatest(0, validation_loss - seen - 0.05), 9) AS checkpoint_score FROM m""")
def checkpoint_scores(spark, sf):
    x = F.col("validation_loss") / 10
    h = history(spark, sf).withColumns({"macro_f1": x, "neutral_f1": x * x, "negative_f1": x, "positive_f1": F.lit(1.0)})
    return _r(ev.checkpoint_scores(h, ["run"]).select("run", "epoch", "checkpoint_score"), "checkpoint_score")


@query("evl_long_metrics", f"""WITH {_sql_class()}
SELECT 'sentiment' AS component, label AS metric, 'heldout_core' AS scope, round(f, 9) AS f1, -1.0::DOUBLE AS accuracy FROM r
UNION ALL SELECT 'sentiment', 'macro', 'heldout_core', -1.0, round(sum(tp) / sum(tp + fn)::DOUBLE, 9) FROM r""")
def long_metrics(spark, sf):
    rep = ev.class_report(labelled(spark, sf), "y", "p", lx.SENTIMENTS)
    out = ev.long_metrics({("sentiment", ""): rep.select("label", "f1"), ("sentiment", "macro"): ev.macro_scores(rep).select("accuracy")}, "heldout_core")
    return _r(out.select("component", "metric", "scope", "f1", "accuracy").na.fill(-1.0), "f1", "accuracy")
