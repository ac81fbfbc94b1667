"""The dealt operators bound to the driver tables, with their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.llm import bpe, exact_dedup, merkle, mixing, ngram_join, quality, repeats, secret_scan, sharding, spelling, toxicity, url_filter, vector_search
from reviewspark.registry import query, table

SQL_WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"

SQL_MIX = f"""
WITH q AS (
  SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT d.doc_id, coalesce('s' || source, 't') AS gkey, {SQL_WORDS} AS size,
    -ln((CAST(('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13)) AS UBIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE WHEN quality = 0 THEN 0.1::DOUBLE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS draw
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id
), s AS (
  SELECT gkey, source_size, w, 3 * source_size AS cap,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM (SELECT gkey, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY gkey) - 1) % 3 + 1 AS w FROM d GROUP BY gkey)
  WINDOW before AS (ORDER BY 3 * source_size / w::DOUBLE, gkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), free AS (
  SELECT arg_min(level, (cap / w::DOUBLE, gkey)) AS level FROM s WHERE cap > w * level
), t AS (
  SELECT gkey, source_size, least(cap::DOUBLE, coalesce(w * free.level, cap::DOUBLE)) AS target FROM s CROSS JOIN free
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), k AS (
  SELECT d.gkey, draw, count(*) AS n, any_value(size) AS each, sum(sum(size)) OVER (PARTITION BY d.gkey ORDER BY draw) - sum(size) AS before,
    any_value(target - epochs * source_size) AS rest
  FROM d JOIN e ON d.gkey = e.gkey GROUP BY d.gkey, draw
), p AS (
  SELECT *, unnest([fits, least(n, fits + 1)]) AS part FROM (
    SELECT *, CASE WHEN each > 0 THEN greatest(0, least(n, floor((rest - before) / each)))::BIGINT ELSE n END AS fits FROM k)
), c AS (
  SELECT gkey, arg_min((draw, part), (abs(before + part * each - rest), draw, part)) AS cut FROM p GROUP BY gkey
), r AS (
  SELECT *, row_number() OVER (PARTITION BY gkey, draw) AS no FROM d
)
SELECT doc_id, r.size::BIGINT AS size, source_size, target,
  (r.size * (epochs + CASE WHEN draw < cut[1] OR (draw = cut[1] AND no <= cut[2]) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN e ON r.gkey = e.gkey JOIN c ON r.gkey = c.gkey"""


@query("op1_source_mix", SQL_MIX)
def source_mix(spark: SparkSession, sf: str) -> DataFrame:
    docs = mixing.with_quality(table(spark, sf, "documents"), table(spark, sf, "labels"), "_quality")
    return mixing.mix(docs, weight=mixing.labelled_weight(docs["_quality"])).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_hypergeometric_shards")
def hypergeometric_shards(spark: SparkSession, sf: str) -> DataFrame:
    out = sharding.shard(table(spark, sf, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL_EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM d WINDOW g AS (PARTITION BY body)"""


@query("op4_chunk_recipes", SQL_EXACT)
def chunk_recipes(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def sql_spans(kind: str, pattern: str, group: int = 0, least: int = 1) -> str:
    """Spans of one rule per document: lengths of the gaps and of the matches, summed up."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, (gaps_before + lens_before)::BIGINT AS s, (gaps_before + lens_before + l)::BIGINT AS e FROM (
    SELECT doc_id, l, part, sum(g) OVER w AS gaps_before, sum(l) OVER w - l AS lens_before FROM (
      SELECT doc_id, unnest(range(len(m))) AS i, length(unnest(gaps[:len(m)])) AS g, length(unnest(m)) AS l, length(unnest(v)) AS part FROM (
        SELECT doc_id, regexp_extract_all(body, '{p}') AS m, regexp_extract_all(body, '{p}', {group}) AS v, string_split_regex(body, '{p}') AS gaps
        FROM d WHERE regexp_matches(body, '{p}')))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE part >= {least}"""


def _sql_secrets() -> str:
    rules = secret_scan.RULES
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE_RULES)
    rank = " ".join(f"WHEN '{r.kind}' THEN {i}" for i, r in enumerate(rules))
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, CASE kind {rank} END) {where}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
spans AS ({' UNION ALL '.join(sql_spans(r.kind, r.pattern, r.group, r.least) for r in rules)})
SELECT d.doc_id, {', '.join(f"count(kind) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE_RULES)},
  sha256({listed.format(rank=rank, where=f'FILTER (WHERE kind IN ({base}))')}) AS base_sha256,
  {listed.format(rank=rank, where='FILTER (WHERE kind IS NOT NULL)')} AS spans
FROM d LEFT JOIN spans ON d.doc_id = spans.doc_id GROUP BY d.doc_id"""


@query("op8_trigram_secrets", _sql_secrets())
def trigram_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf, "documents"))
    counts = [F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in secret_scan.BASE_RULES]
    return found.select(
        "doc_id", *counts, F.sha2(secret_scan.joined_spans(secret_scan.BASE_RULES), 256).alias("base_sha256"),
        secret_scan.joined_spans(secret_scan.RULES).alias("spans"))


SQL_URLS = f"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '{'|'.join(url_filter.LISTED_WORDS)}') THEN 'block' ELSE 'allow' END AS verdict
FROM r"""


@query("op9_bloom_cascade", SQL_URLS)
def bloom_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op7_lexicon_bpe")
def lexicon_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_toxicity_chain")
def toxicity_chain(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


SQL_NEAR = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 4], ' ')) AS g FROM (
    SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id"""


@query("op6_combination_prefixes", SQL_NEAR)
def combination_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_duplicate_groups(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op2_random_indexing")
def random_indexing(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op10_prefix_forest")
def prefix_forest(spark: SparkSession, sf: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


#: Unsigned crc32 of a list of byte values; the table of 256 entries comes from the polynomial.
SQL_CRC_TABLE = """(SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""


def sql_crc(codes: str) -> str:
    """``codes``: a list of byte values; the table is the column ``t``."""
    return f"xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


def _sql_merkle() -> str:
    def field(v):
        return f"coalesce(octet_length(encode(({v})::VARCHAR))::VARCHAR || ':' || ({v})::VARCHAR, '-')"
    fixed = " || ".join(field(c) for c in ("doc_id", "source", "lang"))
    up = "list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))"
    path = """list_transform(range(1, len(stack)), lambda l: CASE WHEN (place >> (l - 1)) % 2 = 1 THEN stack[l][place >> (l - 1)] || '|'
      ELSE '|' || coalesce(stack[l][(place >> (l - 1)) + 2], '') END)"""
    crc = sql_crc("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)")
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({fixed} || {field('n_chars')} || {field('text')}) AS leaf,
    CASE WHEN {crc} % 7 = 0 THEN sha256({fixed} || {field('n_chars::HUGEINT + 1')} || {field('text')}) END AS other
  FROM documents, {SQL_CRC_TABLE}
), levels AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY doc_id NULLS FIRST, leaf) AS nodes FROM d GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, {up} FROM levels WHERE len(nodes) > 1
), trees AS (
  SELECT lang, list(nodes ORDER BY level) AS stack FROM levels GROUP BY lang
), tops AS (
  SELECT 0 AS level, list(stack[len(stack)][1] ORDER BY lang NULLS FIRST) AS nodes FROM trees
  UNION ALL
  SELECT level + 1, {up} FROM tops WHERE len(nodes) > 1
), top_stack AS (
  SELECT list(nodes ORDER BY level) AS stack FROM tops
), tree_paths AS (
  SELECT lang, stack[len(stack)][1] AS root, {path} AS path
  FROM (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM trees), top_stack
), leaf_paths AS (
  SELECT doc_id, d.lang, leaf, other, stack[len(stack)][1] AS subroot, {path} AS path
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d) d JOIN trees t ON d.lang IS NOT DISTINCT FROM t.lang
), folded AS (
  SELECT doc_id, leaf, subroot, root, l.path || p.path AS path,
    list_reduce([coalesce(other, leaf)] || l.path || p.path, lambda a, s: sha256(string_split(s, '|')[1] || a || string_split(s, '|')[2])) AS folded_root
  FROM leaf_paths l JOIN tree_paths p ON l.lang IS NOT DISTINCT FROM p.lang
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


@query("op13_merkle_manifest", _sql_merkle())
def merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf, "documents"))


SQL_SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents) GROUP BY ALL
), summed AS (
  SELECT run, c, {sql_crc("flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [195::BIGINT, unicode(s)::BIGINT - 64] END))")} AS h
  FROM runs, {SQL_CRC_TABLE}
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM summed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.v = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.v = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS form_n, arg_min(other, (-other_n, other)) AS form FROM near GROUP BY word
), forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word
), follow AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL
  SELECT follow.word, forms.word, forms.form FROM follow JOIN forms ON follow.next = forms.word
)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN follow ON forms.word = follow.word AND follow.next IS NULL"""


@query("op12_spelling_variants", SQL_SPELLING)
def spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf, "documents"))


#: Texts as hex digits, so that positions are bytes.
SQL_REPEATS = """
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT uid, doc_id, j, substr(h, 2 * j + 1, 1122) AS piece FROM (SELECT uid, doc_id, h, unnest(range(0, length(h) // 2, 512)) AS j FROM d)
), s AS (
  SELECT uid, doc_id, j + i AS i, md5(substr(piece, 2 * i + 1, 100)) AS w
  FROM (SELECT uid, doc_id, j, piece, unnest(range(0, least(512, length(piece) // 2 - 49))) AS i FROM p)
), f AS (
  SELECT w, min(coalesce(doc_id, 9223372036854775807)) AS low FROM s GROUP BY w HAVING count(*) > 1
), hit AS (
  SELECT uid, i FROM s JOIN f ON s.w = f.w WHERE coalesce(doc_id, 9223372036854775807) > low
), runs AS (
  SELECT uid, min(i) AS lo, max(i) + 50 AS hi FROM (
    SELECT uid, i, sum(fresh) OVER (PARTITION BY uid ORDER BY i) AS run FROM (
      SELECT uid, i, CASE WHEN i - lag(i) OVER (PARTITION BY uid ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit)
  ) GROUP BY uid, run
), spans AS (
  SELECT uid, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM runs GROUP BY uid
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN los IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(los) + 1), lambda k:
    substr(h, CASE WHEN k = 0 THEN 1 ELSE 2 * his[k] + 1 END, greatest(0, 2 * (CASE WHEN k = len(los) THEN length(h) // 2 ELSE los[k + 1] END
      - CASE WHEN k = 0 THEN 0 ELSE his[k] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN spans ON d.uid = spans.uid"""


@query("op11_repeat_tree", SQL_REPEATS)
def repeat_tree(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.repeated_bytes(table(spark, sf, "documents"))
