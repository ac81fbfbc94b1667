"""Text keys and string scalars over the whole documents, pages and labels tables."""

from pyspark.sql import functions as F

from reviewspark import lexicons as lx
from reviewspark.bindings.common import (
    OPINION_WORDS, SQL_LEAK, SQL_TOKENS, documents, sql_fold, sql_hash01, sql_list, sql_place_split, sql_ws,
)
from reviewspark.functions import text as tx
from reviewspark.registry import query, table

def T():
    return F.col("text")


@query("txt_raw_exact_key", f"SELECT doc_id, {sql_ws('text')} AS raw_exact_key FROM documents")
def raw_exact_key(spark, sf):
    return documents(spark, sf).select("doc_id", tx.raw_exact_key(T()).alias("raw_exact_key"))


def _sql_soft():
    base = sql_ws(f"regexp_replace({sql_fold('text')}, '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g')")
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.SOFT_KEY_WORDS.items())
    mapped = f"array_to_string(list_transform(string_split({base}, ' '), lambda t: CASE t {cases} ELSE t END), ' ')"
    joined = f"regexp_replace({mapped}, '([\\p{{L}}\\p{{N}}_-]+)\\s+(nya|ku|mu)\\b', '\\1\\2', 'g')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        joined = f"regexp_replace({joined}, '{c}{{3,}}', '{c}{c}', 'g')"
    return joined


@query("txt_soft_key", f"SELECT doc_id, sha256({_sql_soft()}) AS soft_sha FROM documents")
def soft_key(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2(tx.soft_key(T()), 256).alias("soft_sha"))


@query("txt_lower_key", f"SELECT doc_id, sha256({sql_ws('lower(text)')}) AS key_sha, {sql_ws('lower(text)')} = lower(text) AS unchanged FROM documents")
def lower_key(spark, sf):
    key = tx.lower_key(T())
    return documents(spark, sf).select("doc_id", F.sha2(key, 256).alias("key_sha"), (key == F.lower(T())).alias("unchanged"))


@query("txt_leakage_key", f"SELECT doc_id, {SQL_LEAK} AS leakage_key FROM documents")
def leakage_key(spark, sf):
    return documents(spark, sf).select("doc_id", tx.leakage_key(T()).alias("leakage_key"))


# labels carry 0/1 classes; spelled-out aliases exercise the whole lookup
_LABEL_SPELLING = "CASE WHEN quality = 1 AND toxic = 0 THEN 'Positif' WHEN quality = 0 AND toxic = 1 THEN ' NEG-POS ' WHEN toxic = 1 THEN 'neu' ELSE 'negatif' END"


@query("txt_canonical_sentiment", f"""
WITH s AS (SELECT doc_id, replace(lower(trim({_LABEL_SPELLING})), '-', '_') AS low FROM labels)
SELECT doc_id, CASE low WHEN 'positif' THEN 'positive' WHEN 'negatif' THEN 'negative' WHEN 'neu' THEN 'neutral'
       WHEN 'neg_pos' THEN 'conflict' ELSE low END AS sentiment,
       CASE replace(low, '_', '-') WHEN 'positif' THEN 'positive' WHEN 'negatif' THEN 'negative' WHEN 'neu' THEN 'neutral'
       ELSE replace(low, '_', '-') END AS api_sentiment FROM s""")
def canonical_sentiment(spark, sf):
    raw = F.expr(_LABEL_SPELLING)
    return table(spark, sf, "labels").select(
        "doc_id", tx.canonical_sentiment(raw).alias("sentiment"), tx.api_sentiment(raw).alias("api_sentiment")
    )


# the corpus has no emoji: repeated punctuation stands in for them
_EMOJI_STANDIN = {"!!": "[EMOJI_POS]", "!": "[EMOJI_NEU]", "%%%": "[EMOJI_NEG]"}


@query("txt_emoji_tokens", """
SELECT doc_id, sha256(replace(replace(replace(text, '%%%', '[EMOJI_NEG]'), '!!', '[EMOJI_POS]'), '!', '[EMOJI_NEU]')) AS text_sha,
  ((length(text) - length(replace(text, '!!', ''))) // 2)::BIGINT AS pairs FROM documents""")
def emoji_tokens(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.sha2(tx.replace_emoji(T(), _EMOJI_STANDIN), 256).alias("text_sha"),
        ((F.length(T()) - F.length(F.replace(T(), F.lit("!!"), F.lit("")))) / 2).cast("bigint").alias("pairs"),
    )


def _sql_squeeze(keep):
    out = "text"
    for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out = f"regexp_replace({out}, '{c}{{3,}}', '{c * keep}', 'g')"
    return out


@query("txt_elongation_squeeze", f"SELECT doc_id, sha256({_sql_squeeze(2)}) AS two_sha, sha256({_sql_squeeze(1)}) AS one_sha FROM documents")
def elongation(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.sha2(tx.squeeze_letters(T(), 2), 256).alias("two_sha"), F.sha2(tx.squeeze_letters(T(), 1), 256).alias("one_sha")
    )


@query("txt_number_unit", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT || CASE l_linenumber % 5 WHEN 0 THEN 'mnt' WHEN 1 THEN 'k' WHEN 2 THEN 'RB' WHEN 3 THEN 'km' ELSE 'pcs' END AS token FROM lineitem)
SELECT l_orderkey, l_linenumber, token,
  CASE WHEN regexp_matches(token, '(?i)^[0-9]+(mnt|k|rb|km)$') THEN regexp_extract(token, '^([0-9]+)', 1) || ' ' ||
    CASE lower(regexp_extract(token, '([A-Za-z]+)$', 1)) WHEN 'mnt' THEN 'menit' WHEN 'k' THEN 'ribu' WHEN 'rb' THEN 'ribu' ELSE 'km' END
  ELSE token END AS expanded FROM t""")
def number_unit(spark, sf):
    unit = F.expr("CASE l_linenumber % 5 WHEN 0 THEN 'mnt' WHEN 1 THEN 'k' WHEN 2 THEN 'RB' WHEN 3 THEN 'km' ELSE 'pcs' END")
    li = table(spark, sf, "lineitem").withColumn("token", F.concat(F.col("l_quantity").cast("bigint").cast("string"), unit))
    return li.select("l_orderkey", "l_linenumber", "token", tx.split_number_unit(F.col("token")).alias("expanded"))


_SQL_CLASS = """CASE
  WHEN regexp_matches(token, '(?i)^(https?://\\S+|www\\.\\S+)$') THEN 'url'
  WHEN regexp_matches(token, '^[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_.-]+\\.[A-Za-z]{2,}$') THEN 'email'
  WHEN starts_with(token, '#') THEN 'hashtag'
  WHEN regexp_matches(token, '^\\+?[0-9][0-9() .-]{7,}[0-9]$') THEN 'phone'
  WHEN length(token) >= 6 AND regexp_matches(token, '[A-Za-z]') AND regexp_matches(token, '[0-9]') THEN 'transaction_or_product_id'
  WHEN length(token) > 1 AND regexp_matches(token, '\\p{Lu}') AND NOT regexp_matches(token, '\\p{Ll}') THEN 'acronym_or_brand'
  WHEN i > 0 AND regexp_matches(token, '^\\p{Lu}') THEN 'proper_name_candidate' END"""


@query("txt_protected_tokens", f"""
WITH t AS (SELECT unnest(string_split(url || ' ' || html, ' ')) AS token,
                  unnest(range(len(string_split(url || ' ' || html, ' ')))) AS i FROM pages)
SELECT coalesce({_SQL_CLASS}, 'free') AS token_class, count(*) AS n, count(DISTINCT token) AS distinct_tokens
FROM t GROUP BY 1""")
def protected_tokens(spark, sf):
    words = F.split(F.concat_ws(" ", "url", "html"), " ")
    t = table(spark, sf, "pages").select(F.posexplode(words).alias("i", "token"))
    return t.groupBy(F.coalesce(tx.token_class(F.col("token"), F.col("i")), F.lit("free")).alias("token_class")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("token").alias("distinct_tokens")
    )


@query("txt_privacy_mask", """
WITH m AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url || ' ' || html,
   '(?i)https?://\\S+|www\\.\\S+', '[URL]', 'g'), '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'),
   '\\+?[0-9][0-9() .-]{7,}[0-9]', '[PHONE]', 'g') AS masked FROM pages)
SELECT page_id, (len(regexp_extract_all(masked, '\\[URL\\]')))::INTEGER AS urls, (len(regexp_extract_all(masked, '\\[EMAIL\\]')))::INTEGER AS emails,
  (len(regexp_extract_all(masked, '\\[PHONE\\]')))::INTEGER AS phones FROM m""")
def privacy_mask(spark, sf):
    masked = tx.mask_private(F.concat_ws(" ", "url", "html"))
    p = table(spark, sf, "pages").select("page_id", masked.alias("masked"))
    return p.select("page_id", *[F.regexp_count("masked", F.lit(rf"\[{k}\]")).alias(n) for k, n in [("URL", "urls"), ("EMAIL", "emails"), ("PHONE", "phones")]])


_HINTS = {"latin": ["dans", "que", "los", "una"], "germanic": ["und", "der", "sich", "the"], "other": ["with", "from"]}


@query("txt_domain_resolution", """
WITH s AS (SELECT doc_id,
  contains(low,'dans')::INT + contains(low,'que')::INT + contains(low,'los')::INT + contains(low,'una')::INT AS a,
  contains(low,'und')::INT + contains(low,'der')::INT + contains(low,'sich')::INT + contains(low,'the')::INT AS b,
  contains(low,'with')::INT + contains(low,'from')::INT AS c, low FROM (SELECT doc_id, lower(text) AS low FROM documents))
SELECT doc_id, CASE WHEN greatest(a,b,c) = 0 THEN NULL WHEN a >= b AND a >= c THEN 'latin' WHEN b >= c THEN 'germanic' ELSE 'other' END AS domain,
  CASE WHEN regexp_matches(low, '(^|[^\\p{L}\\p{N}_])(than|thor)([^\\p{L}\\p{N}_]|$)') THEN 'x' WHEN regexp_matches(low, '(^|[^\\p{L}\\p{N}_])(los|mit)([^\\p{L}\\p{N}_]|$)') THEN 'y' ELSE 'generic' END AS semantic FROM s""")
def domain_resolution(spark, sf):
    return documents(spark, sf).select(
        "doc_id", tx.resolve_domain(T(), None, _HINTS).alias("domain"),
        tx.semantic_domain(T(), [("x", r"\b(than|thor)\b"), ("y", r"\b(los|mit)\b")]).alias("semantic"),
    )


_IDW, _ENW = ["der", "die", "und", "le", "la"], ["the", "of", "and"]


@query("txt_language_id", f"""
WITH w AS (SELECT doc_id, lang, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_''-]+'), lambda x: trim(lower(x), '-''')) AS ws FROM documents),
c AS (SELECT doc_id, lang, len(list_filter(ws, lambda x: x IN ({sql_list(_IDW)}))) AS ids, len(list_filter(ws, lambda x: x IN ({sql_list(_ENW)}))) AS ens FROM w)
SELECT doc_id, CASE WHEN ids > 0 AND ens > 0 THEN 'id-en' WHEN lang = 'en' THEN 'en' WHEN ids > ens THEN 'id' WHEN ens > ids THEN 'en' ELSE 'unknown' END AS language,
 round(CASE WHEN ids > 0 AND ens > 0 THEN least(0.95, 0.65 + 0.04 * least(ids, ens)) WHEN lang = 'en' THEN 1.0 WHEN ids > ens THEN least(0.95, 0.55 + 0.06 * ids)
   WHEN ens > ids THEN least(0.95, 0.55 + 0.06 * ens) ELSE 0.3 END::DOUBLE, 4) AS confidence,
 (ids > 0 AND ens > 0) AS is_code_switched FROM c""")
def language_id(spark, sf):
    meta = tx.language_metadata(T(), F.when(F.col("lang") == "en", F.col("lang")), _IDW, _ENW)
    return documents(spark, sf).select("doc_id", meta.alias("m")).select("doc_id", "m.language", "m.confidence", "m.is_code_switched")


@query("txt_template_mask", f"""
SELECT substring(regexp_replace({sql_ws('lower(text)')}, '\\b(from|with|this|that)\\b', '[SLOT]', 'g'), 1, 60) AS template, count(*) AS n
FROM documents WHERE lang = 'en' GROUP BY 1""")
def template_mask(spark, sf):
    d = documents(spark, sf).where("lang = 'en'")
    return d.groupBy(tx.template_mask(T(), r"\b(from|with|this|that)\b").alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query("txt_content_ids", f"""
SELECT doc_id, sha256('reviews::' || source || '::' || doc_id || '::' || text) AS record_id,
       'aux::' || sha256({sql_ws('text')}) AS example_id FROM documents""")
def content_ids(spark, sf):
    return documents(spark, sf).select(
        "doc_id", tx.content_id(F.lit("reviews"), F.col("source"), F.col("doc_id").cast("string"), T()).alias("record_id"),
        F.concat(F.lit("aux::"), F.sha2(tx.raw_exact_key(T()), 256)).alias("example_id"),
    )


@query("txt_coercions", """
WITH x AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS a, event_type AS b,
   CASE event_id % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' 0' WHEN 2 THEN 'yes' WHEN 3 THEN 'maybe' ELSE NULL END AS flag,
   CASE event_id % 4 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN event_id || '.0' WHEN 2 THEN event_id || '.5' ELSE 'n/a' END AS num FROM events)
SELECT event_id, CASE WHEN a <> '' THEN a ELSE b END AS picked,
  CASE WHEN lower(trim(flag)) IN ('true','1') THEN TRUE WHEN lower(trim(flag)) IN ('false','0') THEN FALSE END IS NOT NULL AS strict_known,
  coalesce(lower(trim(flag)) IN ('true','1'), FALSE) AS strict_true,
  coalesce(lower(trim(flag)) IN ('1','true','yes','y'), FALSE) AS tolerant_flag,
  CASE WHEN event_id % 4 IN (0,1) THEN event_id::INTEGER ELSE -1 END AS whole FROM x""")
def coercions(spark, sf):
    e = table(spark, sf, "events")
    flag = F.expr("CASE event_id % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' 0' WHEN 2 THEN 'yes' WHEN 3 THEN 'maybe' ELSE NULL END")
    num = F.expr("CASE event_id % 4 WHEN 0 THEN string(event_id) WHEN 1 THEN event_id || '.0' WHEN 2 THEN event_id || '.5' ELSE 'n/a' END")
    a = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    return e.select(
        "event_id", tx.first_nonempty(a, F.col("event_type")).alias("picked"), tx.strict_bool(flag).isNotNull().alias("strict_known"),
        F.coalesce(tx.strict_bool(flag), F.lit(False)).alias("strict_true"),
        tx.tolerant_bool(flag).alias("tolerant_flag"), F.coalesce(tx.int_or_null(num), F.lit(-1)).alias("whole"),
    )


_SQL_NEG = f"""
WITH {SQL_TOKENS},
op AS (SELECT t.doc_id, t.s, t.e, substring(d.text, greatest(0, t.s - 32) + 1, t.s - greatest(0, t.s - 32)) AS prefix, d.text
       FROM tok t JOIN documents d USING (doc_id) WHERE lower(t.term) IN ({sql_list(OPINION_WORDS)})),
k AS (SELECT doc_id, s, e, text, s - length(string_split_regex(prefix, '[,;.!?]')[-1]) AS f FROM op),
sc AS (SELECT doc_id, s, e, f, regexp_extract_all(substring(text, f + 1, e - f), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM k),
m AS (SELECT doc_id, s, e, f, list_filter(ws, lambda x: lower(x) IN ('the', 'le', 'die')) AS terms FROM sc)
SELECT doc_id, s AS opinion_start, len(terms) > 0 AS negated, CASE WHEN len(terms) > 0 THEN f::INTEGER ELSE -1 END AS scope_start,
  array_to_string(terms, '|') AS terms FROM m"""


@query("txt_negation_scope", _SQL_NEG)
def negation_scope(spark, sf):
    from reviewspark.bindings.common import OPINION_RE
    from reviewspark.functions.spans import find_spans

    op = documents(spark, sf).select("doc_id", "text", F.explode(find_spans(T(), OPINION_RE)).alias("o"))
    scope = tx.negation_scope(T(), F.col("o.start"), F.col("o.end"), r"[,;.!?]", r"\b(?:the|le|die)\b")
    return op.select("doc_id", F.col("o.start").alias("opinion_start"), scope.alias("n")).select(
        "doc_id", "opinion_start", "n.negated", F.coalesce("n.scope_start", F.lit(-1)).alias("scope_start"), F.array_join("n.terms", "|").alias("terms")
    )


@query("txt_sentence_bounds", f"""
WITH {SQL_TOKENS},
a AS (SELECT t.doc_id, t.s, t.e, d.text FROM tok t JOIN documents d USING (doc_id) WHERE lower(t.term) IN ('this', 'from', 'sich', 'dans'))
SELECT doc_id, s AS aspect_start, (s - length(regexp_extract(substring(text, 1, s), '[^.!?;\\n]*$')))::INTEGER AS sentence_start,
  (e + length(regexp_extract(substring(text, e + 1), '^[^.!?;\\n]*[.!?;\\n]?')))::INTEGER AS sentence_end,
  len(regexp_extract_all(substring(text, 1, s), '[.!?]+(\\s+|$)'))::INTEGER AS sentence_index,
  len(regexp_extract_all(substring(text, 1, s), '[,;:]'))::INTEGER AS comma_index FROM a""")
def sentence_bounds(spark, sf):
    from reviewspark.functions.spans import find_spans

    d = documents(spark, sf).select("doc_id", "text", F.explode(find_spans(T(), r"(?Ui)\b(?:this|from|sich|dans)\b")).alias("a"))
    s, e = F.col("a.start"), F.col("a.end")
    return d.select(
        "doc_id", s.alias("aspect_start"), tx.sentence_left(T(), s).alias("sentence_start"), tx.sentence_right(T(), e).alias("sentence_end"),
        tx.sentence_index(T(), s).alias("sentence_index"), tx.clause_index(T(), s).alias("comma_index"),
    )


@query("txt_clause_split", """
WITH c AS (SELECT doc_id, string_split_regex(text, '[,.\\n;]') AS parts FROM documents)
SELECT doc_id, len(parts)::INTEGER AS clauses, len(list_filter(parts, lambda x: trim(x) <> ''))::INTEGER AS nonempty,
  list_max(list_transform(parts, lambda x: length(x)))::INTEGER AS longest FROM c""")
def clause_split(spark, sf):
    parts = F.split(T(), "(?Ui)" + lx.CLAUSE_CUT, -1)
    return documents(spark, sf).select("doc_id", parts.alias("p")).select(
        "doc_id", F.size("p").alias("clauses"), F.size(F.filter("p", lambda x: F.trim(x) != "")).alias("nonempty"),
        F.array_max(F.transform("p", lambda x: F.length(x))).alias("longest"),
    )


@query("txt_hash_fractions", f"""
SELECT doc_id, round({sql_hash01("'4211::' || doc_id", 12, '281474976710655.0')}, 12) AS u,
  CASE WHEN {sql_hash01("'42|' || doc_id", 12, '281474976710656.0', 'sha256')} < 0.1 THEN 'inner_tune'
       WHEN {sql_hash01("'42|' || doc_id", 12, '281474976710656.0', 'sha256')} < 0.2 THEN 'calibration' ELSE 'fit' END AS role,
  {sql_place_split('source')} AS place_split FROM documents""")
def hash_fractions(spark, sf):
    key = F.col("doc_id").cast("string")
    return documents(spark, sf).select(
        "doc_id", F.round(tx.hash01(F.concat(F.lit("4211::"), key)), 12).alias("u"), tx.internal_role(key).alias("role"),
        tx.place_split(F.col("source")).alias("place_split"),
    )


@query("txt_mark_pair", f"""
WITH {SQL_TOKENS},
a AS (SELECT doc_id, min(s) AS s, arg_min(e, s) AS e FROM tok WHERE lower(term) = 'this' GROUP BY 1),
o AS (SELECT doc_id, min(s) AS s, arg_min(e, s) AS e FROM tok WHERE lower(term) = 'was' GROUP BY 1)
SELECT d.doc_id, sha256(CASE WHEN a.s < o.s THEN substring(text,1,a.s) || '[ASP] ' || substring(text,a.s+1,a.e-a.s) || ' [/ASP]' || substring(text,a.e+1,o.s-a.e) || '[OPN] ' || substring(text,o.s+1,o.e-o.s) || ' [/OPN]' || substring(text,o.e+1)
  ELSE substring(text,1,o.s) || '[OPN] ' || substring(text,o.s+1,o.e-o.s) || ' [/OPN]' || substring(text,o.e+1,a.s-o.e) || '[ASP] ' || substring(text,a.s+1,a.e-a.s) || ' [/ASP]' || substring(text,a.e+1) END) AS marked_sha
FROM documents d JOIN a USING (doc_id) JOIN o USING (doc_id)""")
def mark_pair(spark, sf):
    from reviewspark.functions.spans import find_spans

    d = documents(spark, sf).select(
        "doc_id", "text", F.get(find_spans(T(), r"(?Ui)\bthis\b"), F.lit(0)).alias("a"), F.get(find_spans(T(), r"(?Ui)\bwas\b"), F.lit(0)).alias("o")
    ).where("a is not null and o is not null")
    marked = tx.mark_pair(T(), F.col("a.start"), F.col("a.end"), F.col("o.start"), F.col("o.end"))
    return d.select("doc_id", F.sha2(marked, 256).alias("marked_sha"))
