"""Caps, tune splits, quotas, samplers and weights on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewspark import lexicons as lx
from reviewspark.bindings.audits import ann_rows
from reviewspark.bindings.common import SQL_ANNOTATED, SQL_LEAK, SQL_REVIEWS, documents, reviews, sql_hash01
from reviewspark.functions import text as tx
from reviewspark.operators import sampling as sm
from reviewspark.registry import query, table
from reviewspark.scale import digest, small
from reviewspark.session import cut_lineage


@query("smp_cap_positive", f"""WITH {SQL_ANNOTATED}, lim AS (SELECT round_even(0.25 * greatest(1, count(*) FILTER (sentiment <> 'positive')), 0) AS n FROM ann),
p AS (SELECT id, s, sentiment, row_number() OVER (ORDER BY sha1(id || '::' || s), id, s) AS rn FROM ann WHERE sentiment = 'positive')
SELECT id, s AS aspect_start, sentiment FROM ann WHERE sentiment <> 'positive' UNION ALL SELECT id, s, sentiment FROM p, lim WHERE rn <= n""")
def cap_positive(spark, sf):
    a = ann_rows(spark, sf).select("id", "aspect_start", "sentiment")
    return sm.cap_positive(a, 0.25, F.concat_ws("::", "id", F.col("aspect_start").cast("string")))


@query("smp_stable_sample", f"WITH {SQL_REVIEWS} SELECT language, id FROM (SELECT language, id, row_number() OVER (PARTITION BY language ORDER BY sha1('42::' || id)) AS rn FROM reviews) WHERE rn <= 60")
def stable_sample(spark, sf):
    return sm.stable_sample(reviews(spark, sf).select("language", "id"), 60, F.col("id"), ["language"])


@query("smp_inner_tune", f"""WITH {SQL_ANNOTATED},
per AS (SELECT id, array_to_string(list_sort(list_distinct(list(sentiment))), '+') AS st, count(*) FILTER (sentiment = 'neutral') AS nu, count(*) FILTER (sentiment = 'negative') AS ne, count(*) FILTER (sentiment = 'positive') AS po FROM ann GROUP BY 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY sha1('4211::' || st || '::' || id)) AS r, greatest(1, round_even(count(*) OVER (PARTITION BY st) * 0.1, 0)) AS take FROM per),
t0 AS (SELECT *, r <= take AS tune FROM rk),
p1 AS (SELECT id, nu, sum(nu) OVER (ORDER BY sha1('4218::floor::neutral::' || id)) AS run FROM t0 WHERE NOT tune AND nu > 0),
t1 AS (SELECT t0.* EXCLUDE tune, tune OR EXISTS (SELECT 1 FROM p1 WHERE p1.id = t0.id AND (SELECT sum(nu) FROM t0 WHERE tune) < 400 AND (SELECT sum(nu) FROM t0 WHERE tune) + run - nu < 400) AS tune FROM t0),
p2 AS (SELECT id, ne, sum(ne) OVER (ORDER BY sha1('4218::floor::negative::' || id)) AS run FROM t1 WHERE NOT tune AND ne > 0),
t2 AS (SELECT t1.* EXCLUDE tune, tune OR EXISTS (SELECT 1 FROM p2 WHERE p2.id = t1.id AND (SELECT sum(ne) FROM t1 WHERE tune) < 400 AND (SELECT sum(ne) FROM t1 WHERE tune) + run - ne < 400) AS tune FROM t1),
p3 AS (SELECT id, po, sum(po) OVER (ORDER BY sha1('4218::floor::positive::' || id)) AS run FROM t2 WHERE NOT tune AND po > 0),
t3 AS (SELECT t2.* EXCLUDE tune, tune OR EXISTS (SELECT 1 FROM p3 WHERE p3.id = t2.id AND (SELECT sum(po) FROM t2 WHERE tune) < 400 AND (SELECT sum(po) FROM t2 WHERE tune) + run - po < 400) AS tune FROM t2)
SELECT id AS record_id, st AS stratum, tune AS in_tune FROM t3""")
def inner_tune(spark, sf):
    a = ann_rows(spark, sf).select(F.col("id").alias("record_id"), "sentiment")
    return sm.inner_tune(a, fraction=0.1, floor=400).select("record_id", "stratum", "in_tune")


@query("smp_neutral_curriculum", """
WITH x AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS y, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(thble|than|sich|los)([^\\p{L}\\p{N}_]|$)') AS cue FROM labels l JOIN documents USING (doc_id))
SELECT doc_id, y AS sentiment FROM x WHERE y = 'neutral' OR cue OR NOT EXISTS (SELECT 1 FROM x z WHERE z.y = x.y AND z.cue)""")
def neutral_curriculum(spark, sf):
    y = F.expr("CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END")
    x = table(spark, sf, "labels").join(documents(spark, sf), "doc_id").select("doc_id", "text", y.alias("sentiment"), F.lit(False).alias("hard_contrast"))
    return sm.neutral_curriculum(x, "text", positive=r"\b(thble|than)\b", negative=r"\b(sich|los)\b").select("doc_id", "sentiment")


@query("smp_largest_remainder", """
WITH s AS (SELECT o_orderpriority AS label, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS prob FROM orders GROUP BY 1), r AS (SELECT *, 997 * prob AS raw, floor(997 * prob) AS f FROM s)
SELECT label, (f + (row_number() OVER (ORDER BY round(raw - f, 12) DESC, label DESC) <= 997 - sum(f) OVER ())::INT)::BIGINT AS quota FROM r""")
def largest_remainder(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("c"))
    n = o.agg(F.sum("c").alias("t"))
    return sm.largest_remainder(o.join(F.broadcast(n)).select("label", (F.col("c") / F.col("t")).alias("prob")), F.lit(997)).select("label", "quota")


_U = sql_hash01("'42::' || (id || '#' || s)", 12, "281474976710655.0")


@query("smp_controlled_sample", f"""WITH {SQL_ANNOTATED},
x AS (SELECT a.id || '#' || a.s AS k, sentiment, domain, language, a.s % 5 = 0 AS hc, {_U} AS u FROM ann a JOIN reviews r USING (id)),
w AS (SELECT *, pow(count(*) OVER (PARTITION BY sentiment, domain), -0.5) * pow(count(*) OVER (PARTITION BY sentiment, language), 0.7 - 1) * CASE WHEN hc THEN 1.35 ELSE 1 END AS w,
  count(*) OVER (PARTITION BY sentiment) AS size, count(*) OVER () AS n FROM x),
q AS (SELECT sentiment, CASE sentiment WHEN 'positive' THEN 0.25 WHEN 'negative' THEN 0.25 ELSE 0.5 END * n AS raw, n, size FROM w GROUP BY ALL),
f AS (SELECT *, (floor(raw) + (row_number() OVER (ORDER BY round(raw - floor(raw), 12) DESC, sentiment DESC) <= n - sum(floor(raw)) OVER ())::INT)::BIGINT AS quota FROM q),
r AS (SELECT w.*, quota, row_number() OVER (PARTITION BY w.sentiment ORDER BY -ln(greatest(u, 1e-15)) / w, k) AS rk FROM w JOIN f USING (sentiment))
SELECT k AS example_id, sentiment, quota AS sampled, least(quota, size) AS distinct_rows FROM r WHERE rk <= quota""")
def controlled_sample(spark, sf):
    """Every member of the sample, with the draws and rows of its class."""
    a = ann_rows(spark, sf).select(F.concat_ws("#", "id", F.col("aspect_start").cast("string")).alias("example_id"), "sentiment", "domain", "language", (F.col("aspect_start") % 5 == 0).alias("hard_contrast"))
    s = cut_lineage(sm.controlled_sample(a, {"positive": 0.25, "negative": 0.25, "neutral": 0.5}).select("example_id", "sentiment", "draws"))
    return s.join(small(sm.exposure(s)), "sentiment").select("example_id", "sentiment", "sampled", "distinct_rows")


@query("smp_warmup_corpus", f"""WITH {SQL_REVIEWS},
x AS (SELECT id, split, {SQL_LEAK} AS k, CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS y FROM reviews WHERE trim(text) <> ''),
o AS (SELECT k, min(id) AS id, arg_min(y, id) AS y FROM x WHERE split = 'train' AND k NOT IN (SELECT k FROM x WHERE split <> 'train') GROUP BY 1)
SELECT id AS example_id, y AS sentiment FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY sha1('42::' || id)) AS rn FROM o) WHERE rn <= 100""")
def warmup_corpus(spark, sf):
    x = reviews(spark, sf).select(F.col("id").alias("example_id"), "text", "split", F.expr("CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END").alias("sentiment"))
    held = x.where("split <> 'train'").select(digest(tx.leakage_key(F.col("text"))).alias("text_key"))
    return sm.warmup_corpus(x.where("split = 'train'"), held, 100).select("example_id", "sentiment")


@query("smp_mixed_corpus", f"""
WITH d AS (SELECT sha256({SQL_LEAK}) AS k, source FROM documents), h AS (SELECT sha256({SQL_LEAK}) AS k FROM (SELECT text FROM documents WHERE doc_id % 10 = 0)),
p AS (SELECT k, row_number() OVER (ORDER BY sha1('1011::' || k)) AS rk FROM (SELECT DISTINCT k FROM d WHERE source < 'src15' AND k NOT IN (SELECT k FROM h))),
g AS (SELECT k, row_number() OVER (ORDER BY sha1('1012::' || k)) AS rk FROM (SELECT DISTINCT k FROM d WHERE source >= 'src15' AND k NOT IN (SELECT k FROM h))),
z AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng), l AS (SELECT CASE WHEN round_even(np * 3 / 7.0::DOUBLE, 0) > ng THEN least(np, round_even(ng * 7 / 3.0::DOUBLE, 0)) ELSE np END AS lp, least(round_even(np * 3 / 7.0::DOUBLE, 0), ng) AS lg FROM z)
SELECT k AS text_key, 'primary' AS source FROM p, l WHERE rk <= lp UNION ALL SELECT k, 'generic' FROM g, l WHERE rk <= lg""")
def mixed_corpus(spark, sf):
    d = documents(spark, sf).withColumn("text_key", digest(tx.leakage_key(F.col("text"))))
    held = d.where("doc_id % 10 = 0")
    return sm.mixed_corpus(d.where("source < 'src15'"), d.where("source >= 'src15'"), held).select("text_key", "source")


@query("smp_effective_number_weights", f"""WITH {SQL_ANNOTATED}, c AS (SELECT l, greatest(1, (SELECT count(*) FROM ann WHERE sentiment = l)) AS n FROM (VALUES ('positive'), ('negative'), ('neutral'), ('conflict')) v(l)),
w AS (SELECT l, n, (1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, n)) AS w FROM c) SELECT l AS label, n, round(least(3.0::DOUBLE, greatest(0.5::DOUBLE, w / (SELECT avg(w) FROM w))), 9) AS weight FROM w""")
def effective_number_weights(spark, sf):
    return sm.effective_number_weights(ann_rows(spark, sf), "sentiment", [*lx.SENTIMENTS, "conflict"]).withColumn("weight", F.round("weight", 9))


@query("smp_balanced_class_weights", "SELECT l_returnflag AS label, round((SELECT sum(l_discount) FROM lineitem) / (2 * sum(l_discount)), 9) AS class_weight FROM lineitem GROUP BY 1")
def balanced_class_weights(spark, sf):
    return sm.balanced_class_weights(table(spark, sf, "lineitem"), "l_returnflag", "l_discount").withColumn("class_weight", F.round("class_weight", 9))


@query("smp_group_tune_split", f"SELECT o_orderkey, CASE WHEN {sql_hash01(chr(39) + '7771::' + chr(39) + ' || o_custkey', 12, '281474976710655.0')} < 0.15 THEN 'tune' ELSE 'train' END AS part FROM orders")
def group_tune_split(spark, sf):
    return sm.group_tune_split(table(spark, sf, "orders"), F.col("o_custkey").cast("string")).select("o_orderkey", "part")
