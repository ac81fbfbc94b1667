"""Sources and sinks: write a driver table in the foreign format, read it back whole."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewspark import lexicons as lx
from reviewspark import sinks
from reviewspark.bindings.common import documents, sql_ws
from reviewspark.functions import text as tx
from reviewspark.registry import query, table
from reviewspark.session import scratch_path
from reviewspark.sources import files, records


#: Bytes of a written file: some readers cannot split one, and a task writes and reads it whole.
FILE_BYTES = 128 << 20


def _n_parts(df) -> int:
    """As many files as the table needs, at least 4."""
    texts = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, t in df.dtypes if t == "string"]
    sizes = df.agg(F.count(F.lit(1)) * (16 * len(df.columns)), *texts).first()
    return max(4, -(-sum(sizes) // FILE_BYTES))


def _parts(df):
    return df.repartition(_n_parts(df))


def _with_header(lines, header: str):
    """Text lines with the header first in every part file."""
    def add(it):
        yield pd.DataFrame({"value": [header]})
        yield from it

    return lines.mapInPandas(add, "value string")


def _write_csv(df, path, sep=",", encoding="UTF-8"):
    df.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).option("encoding", encoding).csv(path)


@query("src_csv_role_aliases", "SELECT text AS review, doc_id::VARCHAR AS customer_id, source AS city, lang AS original_lang FROM documents")
def csv_role_aliases(spark, sf):
    path = scratch_path(spark, "roles")
    _write_csv(_parts(documents(spark, sf)).select(F.col("doc_id").alias("ID"), F.col("text").alias("Komentar"), F.col("source").alias("KOTA"), "lang"), path)
    df = files.read_reviews_csv(spark, path)
    return df.select("review", "customer_id", "city", F.col("original_fields")["lang"].alias("original_lang"))


@query("src_csv_encodings_and_delimiters", f"""
SELECT doc_id::VARCHAR AS customer_id, sha256({sql_ws('text')}) AS review_sha FROM documents
UNION ALL SELECT doc_id::VARCHAR, sha256({sql_ws('text')}) FROM documents
UNION ALL SELECT doc_id::VARCHAR, sha256({sql_ws('text')}) FROM documents""")
def csv_encodings(spark, sf):
    base = scratch_path(spark, "enc")
    d = _parts(documents(spark, sf)).select(F.col("doc_id").alias("id"), F.col("text").alias("ulasan"))
    for name, sep, enc in (("a", ",", "UTF-8"), ("b", ";", "ISO-8859-1"), ("c", "\t", "UTF-8")):
        _write_csv(d, f"{base}/{name}", sep, enc)
    df = files.read_review_files(spark, [f"{base}/{n}/*.csv" for n in "abc"])
    return df.select("customer_id", F.sha2(tx.collapse_ws(F.col("review")), 256).alias("review_sha"))


@query("src_wrapped_export", "SELECT doc_id::VARCHAR AS customer_id, replace(replace(text, chr(10), ' '), '\"', '') AS review, lang AS city FROM documents")
def wrapped_export(spark, sf):
    path = scratch_path(spark, "wrapped")
    flat = F.translate(F.translate("text", "\n", " "), '"', "")
    line = F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit(","), flat, F.lit(',""'), F.col("lang"), F.lit('""";;;'))
    _with_header(_parts(documents(spark, sf)).select(line.alias("value")), '"id,""Isi Review"",kota";;;').write.text(path)
    return files.read_wrapped_export(spark, path).where("not malformed").select("customer_id", "review", "city")


@query("src_wrapped_export_encoding", "SELECT doc_id::VARCHAR AS customer_id, replace(replace(text, chr(10), ' '), '\"', '') AS review, lang AS city FROM documents")
def wrapped_export_encoding(spark, sf):
    """Wrapped exports whose bytes are Latin-1, found and read as such by the sniffing reader."""
    path = scratch_path(spark, "wrapped-latin")
    flat = F.translate(F.translate("text", "\n", " "), '"', "")
    line = F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit(","), flat, F.lit(',""'), F.col("lang"), F.lit('""";;;'))
    lines = _with_header(_parts(documents(spark, sf)).select(line.alias("value")), '"id,""Isi Review"",kota";;;')
    lines.select(F.encode("value", "ISO-8859-1").cast("string").alias("value")).write.text(path)  # the bytes, as they are
    return files.read_review_files(spark, f"{path}/*.txt").select("customer_id", "review", "city")


@query("src_multiline_rows", "SELECT doc_id::VARCHAR AS customer_id, sha256(text) AS review_sha, true AS in_order FROM documents")
def multiline_rows(spark, sf):
    """Texts with line breaks in quoted fields come back byte for byte, numbered in the order of their file."""
    path = scratch_path(spark, "multiline")
    d = documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("ulasan"))
    _write_csv(d.repartitionByRange(_n_parts(d), "id").sortWithinPartitions("id"), path)
    df = files.read_reviews_csv(spark, f"{path}/*.csv")
    here = W.partitionBy("path").orderBy(F.col("customer_id").cast("long"))
    return df.select("customer_id", F.sha2("review", 256).alias("review_sha"), (F.row_number().over(here) + 1 == F.col("row_number")).alias("in_order"))


@query("src_row_numbering", "SELECT count(*) AS rows_read, count(*) AS distinct_numbers, count(*) AS last_numbers FROM lineitem")
def row_numbering(spark, sf):
    path = scratch_path(spark, "numbered")
    _write_csv(_parts(table(spark, sf, "lineitem")).select("l_orderkey", F.col("l_returnflag").alias("review")), path)
    df = files.read_reviews_csv(spark, path, multiline=False).select("path", "row_number")
    per_file = df.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_number").alias("d"), F.max("row_number").alias("m"))
    return per_file.agg(F.sum("n").alias("rows_read"), F.sum("d").alias("distinct_numbers"), F.sum(F.col("m") - 1).cast("bigint").alias("last_numbers"))


@query("src_file_issues", "SELECT * FROM (VALUES ('DUPLICATE_COLUMNS', 1), ('EMPTY_CSV', 1), ('HEADER_NOT_FOUND', 1), ('INVALID_FILE_TYPE', 1), ('REVIEW_COLUMN_NOT_FOUND', 1), ('TOO_MANY_ROWS', 1)) v(code, found), (SELECT 1 AS one FROM documents LIMIT 1) WHERE one = 1".replace("SELECT *", "SELECT code, found"))
def file_issues(spark, sf):
    base = scratch_path(spark, "issues")
    body = documents(spark, sf).select(F.concat_ws(",", F.col("doc_id").cast("string"), F.col("lang")).alias("value"))
    empty = body.limit(0)
    for name, header, rows, ext in (
        ("dup", "review,Review", body, ".csv"), ("blank", "review,,x", body, ".csv"), ("title", "title,x", body, ".csv"),
        ("empty", "review,x", empty.union(empty), ".csv"), ("good", "review,x", body, ".csv"), ("other", "review,x", body, ".txt"),
    ):
        out = rows.repartition(1) if name != "empty" else spark.range(1).select(F.lit("").alias("value"))
        _with_header(out, header).write.text(f"{base}/{name}{ext}.d")
    # single-part uploads: give the part files the extension under test
    paths = {n: f"{base}/{n}.csv.d" for n in ("dup", "blank", "title", "empty", "good")}
    issues = None
    for n, p in {**paths, "other": f"{base}/other.txt.d"}.items():
        limit = documents(spark, sf).count() - 1 if n == "good" else 10**9
        part = files.file_issues(spark, p, max_rows=limit).where("code <> 'INVALID_FILE_TYPE'" if n != "other" else "true")
        issues = part if issues is None else issues.union(part)
    return issues.groupBy("code").agg(F.lit(1).alias("found"))


@query("src_json_records", """
SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS chars, count(DISTINCT id) AS ids
FROM (SELECT doc_id::VARCHAR AS id, text, unnest(['lines', 'cells']) AS kind FROM documents) GROUP BY 1""")
def json_records(spark, sf):
    base = scratch_path(spark, "json")
    d = _parts(documents(spark, sf)).select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("source_dataset"))
    d.write.json(f"{base}/lines")
    cells = d.withColumn("annotations", F.to_json(F.array(F.struct(F.col("source_dataset").alias("aspect_term"), F.lit("positive").alias("sentiment")))))
    _write_csv(cells, f"{base}/cells")
    lines = records.read_json_records(spark, f"{base}/lines").select("id", "text", F.lit("lines").alias("kind"))
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{base}/cells")
    parsed = records.parse_json_cells(raw, {"annotations": "array<struct<aspect_term:string,sentiment:string>>"}).where("size(annotations) = 1")
    both = lines.unionByName(parsed.select("id", "text", F.lit("cells").alias("kind")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.countDistinct("id").alias("ids"))


@query("src_safe_json_cells", """
WITH x AS (SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n FROM events)
SELECT event_id, n::INTEGER AS annotations, CASE WHEN n > 0 THEN event_type ELSE '' END AS first_term FROM x""")
def safe_json_cells(spark, sf):
    one = "concat('[{\"aspect_term\":\"', event_type, '\"}]')"
    two = "concat('{\"annotations\":[{\"aspect_term\":\"', event_type, '\"},{\"aspect_term\":\"z\"}]}')"
    cell = F.expr(f"CASE event_id % 4 WHEN 0 THEN {one} WHEN 1 THEN {two} WHEN 2 THEN '[oops' ELSE NULL END")
    a = records.safe_json_list(cell, "array<struct<aspect_term:string>>")
    return table(spark, sf, "events").select("event_id", a.alias("a")).select(
        "event_id", F.size("a").alias("annotations"), F.coalesce(F.get("a", F.lit(0))["aspect_term"], F.lit("")).alias("first_term")
    )


@query("src_sentiment_tsv", f"""
SELECT sha256({sql_ws('text')}) AS text_sha, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment
FROM labels JOIN documents USING (doc_id)""")
def sentiment_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    lab = F.expr("CASE WHEN toxic = 1 THEN 'neg' WHEN quality = 1 THEN 'positif' ELSE 'neutral' END")
    rows = table(spark, sf, "labels").join(documents(spark, sf), "doc_id").select(F.translate("text", "\n\t", "  ").alias("text"), lab.alias("s"))
    _parts(rows).write.option("sep", "\t").option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return records.read_sentiment_tsv(spark, path).select(F.sha2(tx.collapse_ws(F.col("text")), 256).alias("text_sha"), F.col("overall_sentiment").alias("sentiment"))


@query("src_tuple_lines", """
WITH b AS (SELECT doc_id, lower(replace(text, chr(10), ' ')) AS t, source, lang FROM documents),
w AS (SELECT doc_id, source, lang, t, unnest(['the', 'de', 'the', 'zzzz']) AS term, unnest([1, 1, 2, 1]) AS want FROM b),
h AS (SELECT *, (length(t) - length(replace(t, term, ''))) // length(term) AS hits FROM w),
p AS (SELECT *, least(want, hits) AS nth FROM h WHERE hits > 0)
SELECT doc_id::VARCHAR AS doc, term AS aspect_term, want::INTEGER AS mention,
  (CASE WHEN nth = 1 THEN instr(t, term) - 1 ELSE instr(t, term) + length(term) - 1 + instr(substring(t, instr(t, term) + length(term)), term) - 1 END)::INTEGER AS aspect_start
FROM p""")
def tuple_lines(spark, sf):
    base = scratch_path(spark, "tuples")
    flat = F.lower(F.translate("text", "\n", " "))
    line = F.concat(flat, F.lit("####[('the', 'c1', 'positive'), ('de', '"), F.col("doc_id").cast("string"), F.lit("', \"neg\"), ('the', 'c3', 'neutral'), ('zzzz', 'c4', 'pos'), ('NULL', '"), F.col("doc_id").cast("string"), F.lit("', 'neu')]"))
    _parts(documents(spark, sf)).select(line.alias("value")).write.text(f"{base}/hotel/en/train.txt.d")
    good, rejected = records.read_tuple_lines(spark, f"{base}/hotel/en/train.txt.d")
    ids = good.where("implicit").select("id", F.col("category").alias("doc"))
    explicit = good.where("not implicit").withColumn("mention", F.when(F.col("category") == "c3", 2).otherwise(1))
    return explicit.join(ids, "id").select("doc", "aspect_term", "mention", "aspect_start")


@query("src_conll_spans", """
WITH s AS (SELECT conv_id, turn, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS ws FROM conversations),
t AS (SELECT conv_id, turn, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM s),
o AS (SELECT conv_id, turn, token, pos, coalesce(sum(length(token) + 1) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start FROM t)
SELECT token, pos::INTEGER AS pos, start, CASE WHEN length(token) >= 9 THEN 'aspect' WHEN length(token) <= 2 THEN 'opinion' ELSE 'none' END AS kind, count(*) AS n FROM o GROUP BY ALL""")
def conll_spans(spark, sf):
    path = scratch_path(spark, "conll")
    ws = F.filter(F.split(F.translate("text", "\n", " "), " "), lambda x: x != "")
    block = F.array_join(F.transform(ws, lambda x: F.concat(x, F.lit("\t"), F.when(F.length(x) >= 9, "B-ASPECT").when(F.length(x) <= 2, "I-SENTIMENT").otherwise("O"))), "\n")
    _parts(table(spark, sf, "conversations")).select(F.concat(block, F.lit("\n")).alias("value")).write.text(path)
    tags = records.term_tags(records.read_conll(spark, path))
    return tags.groupBy("token", "pos", "start", F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("src_aspect_xml", """
SELECT c_custkey::VARCHAR AS id_text, c_mktsegment AS aspect_term, (length(c_name) + 1)::INTEGER AS aspect_start,
  CASE WHEN c_acctbal < 0 THEN 'negative' ELSE 'positive' END AS sentiment, FALSE AS bad FROM customer
UNION ALL SELECT c_custkey::VARCHAR, 'nope', 0, '', TRUE FROM customer""")
def aspect_xml(spark, sf):
    path = scratch_path(spark, "xml")
    c = _parts(table(spark, sf, "customer"))
    s = F.length("c_name") + 1
    term = F.struct(
        F.col("c_mktsegment").alias("_term"), s.cast("string").alias("_from"), (s + F.length("c_mktsegment")).cast("string").alias("_to"),
        F.when(F.col("c_acctbal") < 0, "negative").otherwise("positif").alias("_polarity"),
    )
    wrong = F.struct(F.lit("nope").alias("_term"), F.lit("0").alias("_from"), F.lit("4").alias("_to"), F.lit("neutral").alias("_polarity"))
    rows = c.select(F.concat_ws(" ", "c_name", "c_mktsegment", F.concat(F.lit("#"), F.col("c_custkey").cast("string"))).alias("text"),
                    F.struct(F.array(term, wrong).alias("aspectTerm")).alias("aspectTerms"))
    rows.write.format("xml").option("rowTag", "sentence").option("rootTag", "sentences").save(path)
    good, issues = records.read_aspect_xml(spark, path)
    key = F.element_at(F.split("text", "#"), -1)
    ok = good.select(key.alias("id_text"), "aspect_term", "aspect_start", "sentiment", F.lit(False).alias("bad"))
    n_bad = issues.select(F.monotonically_increasing_id().alias("k"), "term")
    back = good.select(key.alias("id_text"), F.lit("nope").alias("aspect_term"), F.lit(0).alias("aspect_start"), F.lit("").alias("sentiment"), F.lit(True).alias("bad"))
    # every sentence carries one wrong annotation; they must all have been reported
    return ok.union(back) if n_bad.count() == good.count() else ok


@query("src_wide_categories", """
WITH u AS (SELECT l_orderkey, l_linenumber, unnest(['fuel', 'price', 'service']) AS category,
   unnest([l_linenumber % 4, (l_linenumber + 1) % 4, (l_orderkey % 5)::INTEGER]) AS raw, l_returnflag || ' harga ' || l_linestatus AS text FROM lineitem)
SELECT l_orderkey, l_linenumber, category, CASE raw WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS sentiment
FROM u WHERE raw IN (0, 1, 2) AND (raw <> 1 OR category = 'price')""")
def wide_categories(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat_ws(" harga ", "l_returnflag", "l_linestatus").alias("text"),
        (F.col("l_linenumber") % 4).alias("fuel"), ((F.col("l_linenumber") + 1) % 4).alias("price"), (F.col("l_orderkey") % 5).alias("service"),
    )
    labels = {"0": "negative", "1": "neutral", "2": "positive", "3": "conflict"}
    long = records.wide_to_long(li, ["l_orderkey", "l_linenumber", "text"], ["fuel", "price", "service", "absent"], labels)
    return records.keep_explicit_neutral(long).drop("text")


@query("src_category_corpora", """
SELECT 'long' AS layout, o_orderpriority AS category, CASE o_orderstatus WHEN 'F' THEN 'positive' WHEN 'O' THEN 'negative' ELSE 'neutral' END AS sentiment,
  'validation' AS split, 1.0::DOUBLE AS sample_weight, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT 'wide', 'price', CASE o_orderstatus WHEN 'F' THEN 'positive' ELSE 'negative' END, 'train', 0.5, count(*) FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL""")
def category_corpora(spark, sf):
    o = table(spark, sf, "orders")
    lab = F.expr("CASE o_orderstatus WHEN 'F' THEN 'POS' WHEN 'O' THEN 'negatif' ELSE 'neu' END")
    long = o.select(F.col("o_orderpriority").alias("Aspect Category"), lab.alias("Polarity"), F.lit("x").alias("Review Text"), F.lit("dev").alias("Partition"))
    wide = o.select(F.lit("tanpa kata").alias("ulasan"), lab.alias("harga"))
    a = records.read_category_corpus(long, name="gold_set.csv").withColumn("layout", F.lit("long"))
    b = records.read_category_corpus(wide, {"price": ["price", "harga"], "service": ["service"]}).withColumn("layout", F.lit("wide"))
    return a.unionByName(b).groupBy("layout", "category", "sentiment", "split", "sample_weight").agg(F.count(F.lit(1)).alias("n"))


@query("src_annotation_folder", """
SELECT CASE WHEN doc_id % 3 = 0 THEN 'csv' WHEN doc_id % 3 = 1 THEN 'jsonl' ELSE 'other' END AS part, count(*) AS n, count(DISTINCT source) AS places,
  sum(length(text))::BIGINT AS chars FROM documents WHERE doc_id % 3 < 2 GROUP BY 1""")
def annotation_folder(spark, sf):
    base = scratch_path(spark, "folder")
    d = documents(spark, sf).select(F.col("doc_id").cast("string").alias("review_id"), F.col("source").alias("place_id"), F.col("text").alias("review_text_raw"), (F.col("doc_id") % 3).alias("m"))
    _write_csv(_parts(d.where("m = 0")).drop("m"), f"{base}/a")
    _parts(d.where("m = 1")).drop("m").write.json(f"{base}/b")
    schema = "review_id string, place_id string, review_text_raw string"
    got = records.read_annotation_folder(spark, f"{base}/a", schema, {"*.csv": "csv"}).unionByName(
        records.read_annotation_folder(spark, f"{base}/b", schema, {"*.json": "lines"}).withColumn("file_name", F.lit("x.jsonl")))
    part = F.when(F.contains("file_name", F.lit(".csv")), "csv").otherwise("jsonl")
    return got.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("place_id").alias("places"), F.sum(F.length("review_text_raw")).alias("chars"))


@query("src_file_discovery", """
WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'reviews_human_approved_' WHEN 1 THEN 'reviews_qc_ready_' WHEN 2 THEN 'annotations_long_' ELSE 'reviews_' END || page_id || '.csv' AS name FROM pages)
SELECT name, CASE page_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END::INTEGER AS priority FROM f WHERE page_id % 4 <> 2""")
def file_discovery(spark, sf):
    name = F.concat(F.expr("CASE page_id % 4 WHEN 0 THEN 'reviews_human_approved_' WHEN 1 THEN 'reviews_qc_ready_' WHEN 2 THEN 'annotations_long_' ELSE 'reviews_' END"), F.col("page_id").cast("string"), F.lit(".csv"))
    f = table(spark, sf, "pages").select(name.alias("name"))
    return f.select("name", records.file_priority(F.col("name")).alias("priority")).where("priority is not null")


@query("src_dataset_types", """
SELECT 'documents' AS name, CASE WHEN count(*) > 0 THEN 'dapt_corpus' ELSE 'auxiliary' END AS dataset_type FROM documents
UNION ALL SELECT 'lineitem', 'auxiliary' WHERE (SELECT count(*) FROM lineitem) > 0
UNION ALL SELECT 'approved', 'gold_pilot' WHERE (SELECT count(*) FROM labels) > 0
UNION ALL SELECT 'aspects', CASE WHEN count(*) > 500 THEN 'v10_master' ELSE 'silver' END FROM conversations""")
def dataset_types(spark, sf):
    frames = {
        "documents": documents(spark, sf), "lineitem": table(spark, sf, "lineitem"),
        "approved": table(spark, sf, "labels").withColumnRenamed("quality", "human_approved"),
        "aspects": table(spark, sf, "conversations").withColumnRenamed("role", "aspect_term"),
    }
    rows = [(n, records.dataset_type(f.columns, f.count(), n)) for n, f in frames.items()]
    return spark.createDataFrame(rows, "name string, dataset_type string")


@query("src_long_to_nested", """
SELECT l_orderkey, count(*) AS annotations, array_to_string(list(l_returnflag ORDER BY l_linenumber, l_partkey, l_extendedprice), '') AS labels,
  round(avg(l_discount), 9) AS mean_discount, round(avg(l_tax), 9) AS mean_tax FROM lineitem GROUP BY 1""")
def long_to_nested(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("_k", F.struct("l_linenumber", "l_partkey", "l_extendedprice"))
    n = records.long_to_nested(li, "l_orderkey", "_k", ["l_returnflag", "l_linenumber"], ["l_linestatus"], ["l_discount", "l_tax"])
    return n.select(
        "l_orderkey", F.size("annotations").cast("bigint").alias("annotations"),
        F.array_join(F.transform("annotations", lambda a: a["l_returnflag"]), "").alias("labels"),
        F.round("mean_l_discount", 9).alias("mean_discount"), F.round("mean_l_tax", 9).alias("mean_tax"),
    )


@query("src_bundle", """
SELECT (SELECT count(*) FROM documents) AS records, (SELECT count(DISTINCT doc_id) FROM documents) AS ids,
       (SELECT count(*) FROM labels) AS relations, 0::BIGINT AS duplicate_ids""")
def bundle(spark, sf):
    base = scratch_path(spark, "bundle")
    d = documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("source_dataset"), F.pmod("doc_id", F.lit(2)).alias("m"))
    for i, part in enumerate(("train", "test")):
        d.where(F.col("m") == i).drop("m").write.json(f"{base}/{part}")
    rel = table(spark, sf, "labels").select(F.col("doc_id").alias("record_id"), *[F.lit(x).alias(c) for x, c in ((0, "aspect_start"), (1, "aspect_end"), (2, "opinion_start"), (3, "opinion_end"))], F.col("quality").alias("label"))
    _write_csv(_parts(rel), f"{base}/relation")
    recs, rels = records.read_bundle(spark, [f"{base}/train", f"{base}/test"], [f"{base}/relation"])
    return recs.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("id").alias("ids")).join(
        rels.where("record_id is not null").agg(F.count(F.lit(1)).alias("relations"))).join(
        records.duplicate_ids(recs).agg(F.count(F.lit(1)).alias("duplicate_ids")))


@query("src_checksums")
def checksums(spark, sf):
    base = scratch_path(spark, "sums")
    _parts(documents(spark, sf)).write.json(f"{base}/data")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{base}/data").select(
        F.sha2("content", 256).alias("h"), F.element_at(F.split("path", "/"), -1).alias("n"))
    bad = found.withColumn("h", F.when(F.col("n").startswith("part-00001"), F.lit("0" * 64)).otherwise(F.col("h")))
    bad.select(F.concat_ws("  ", "h", "n").alias("value")).write.text(f"{base}/sums")
    manifest = records.read_checksums(spark, f"{base}/sums")
    out = records.verify_checksums(spark, f"{base}/data", manifest)
    return out.where(~F.col("name").startswith("_")).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


@query("src_region_dims", """
SELECT replace(lower(n_name), '_', ' ') AS alias, n_nationkey::VARCHAR AS code, r_name AS province FROM nation JOIN region ON n_regionkey = r_regionkey
UNION SELECT replace(lower('kota ' || n_name), '_', ' '), n_nationkey::VARCHAR, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def region_dims(spark, sf):
    nr = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return nr.select(
        F.explode(F.array("n_name", F.concat(F.lit("Kota "), "n_name"))).alias("raw"), F.col("n_nationkey").cast("string").alias("code"), F.col("r_name").alias("province")
    ).select(tx.location_key(F.col("raw")).alias("alias"), "code", "province").distinct()


@query("src_request_rows", """
SELECT CASE WHEN event_id % 2 = 0 THEN event_type ELSE props END AS raw_text, user_id::VARCHAR AS customer_id,
 CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS city, count(*) AS n FROM events GROUP BY ALL""")
def request_rows(spark, sf):
    e = table(spark, sf, "events")
    even = F.col("event_id") % 2 == 0
    req = e.select(
        F.when(even, F.col("event_type")).alias("review"), F.when(~even, F.col("props")).alias("text"), F.col("user_id").alias("customer_id"),
        F.when(even, "A").alias("city"), F.when(~even, "B").alias("kota"),
    )
    return records.request_rows(req).groupBy("raw_text", "customer_id", "city").agg(F.count(F.lit(1)).alias("n"))


@query("snk_json_lines", "SELECT doc_id AS row_number, sha256(text) AS text_sha, source FROM documents")
def json_lines(spark, sf):
    path = scratch_path(spark, "snk_json")
    sinks.write_json_lines(documents(spark, sf).select(F.col("doc_id").alias("row_number"), "text", "source"), path)
    return spark.read.schema("row_number long, text string, source string").json(path).select("row_number", F.sha2("text", 256).alias("text_sha"), "source")


@query("snk_json_array", "SELECT count(*) + 1 AS lines, 1::BIGINT AS opened, 1::BIGINT AS closed FROM documents")
def json_array(spark, sf):
    path = scratch_path(spark, "snk_array")
    sinks.write_json_array(documents(spark, sf).select(F.col("doc_id").alias("row_number"), "text"), path)
    return spark.read.text(path).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("value").startswith("[")).alias("opened"), F.count_if(F.col("value") == "]").alias("closed")
    )


@query("snk_flat_csv", """
SELECT doc_id AS row_number, source AS original_source, CASE WHEN substring(t,1,1) IN ('=','+','-','@') THEN '''' || t ELSE t END AS review, '["' || lang || '"]' AS warnings
FROM (SELECT doc_id, source, lang, CASE doc_id % 3 WHEN 0 THEN '=' WHEN 1 THEN '-' ELSE '' END || text AS t FROM documents)""")
def flat_csv(spark, sf):
    path = scratch_path(spark, "snk_csv")
    d = documents(spark, sf)
    review = F.concat(F.expr("CASE doc_id % 3 WHEN 0 THEN '=' WHEN 1 THEN '-' ELSE '' END"), F.col("text"))
    rows = d.select(F.col("doc_id").alias("row_number"), F.create_map(F.lit("source"), F.col("source")).alias("original_fields"), review.alias("review"), F.array("lang").alias("warnings"))
    sinks.write_results_csv(rows, path, ["source"])
    got = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return got.select(F.col(got.columns[0]).cast("bigint").alias("row_number"), "original_source", "review", "warnings")


@query("snk_report_tables", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def report_tables(spark, sf):
    path = scratch_path(spark, "snk_report")
    sinks.write_report(documents(spark, sf).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.option("header", True).schema("source string, lang string, n long").csv(path)


@query("snk_upsert_runs", """
WITH m AS (SELECT o_orderpriority AS run_mode, round(avg(o_totalprice), 2) AS score FROM orders GROUP BY 1)
SELECT run_mode, CASE WHEN run_mode IN ('1-URGENT', '2-HIGH') THEN 'completed' ELSE 'not_run' END AS status,
  CASE WHEN run_mode = '1-URGENT' THEN score WHEN run_mode = '2-HIGH' THEN -1.0 ELSE 0.0 END AS score FROM m""")
def upsert_runs(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run_mode")).agg(F.round(F.avg("o_totalprice"), 2).alias("score"))
    modes = m.select("run_mode", F.substring("run_mode", 1, 1).cast("int").alias("position"))
    old = m.where("run_mode in ('1-URGENT', '2-HIGH')").select("run_mode", F.lit(-1.0).alias("score"), F.lit("completed").alias("status"))
    new = m.where("run_mode = '1-URGENT'").withColumn("status", F.lit("completed"))
    return sinks.upsert_run(old, new, modes).select("run_mode", "status", F.coalesce("score", F.lit(0.0)).alias("score"))


@query("snk_append_history", "SELECT count(*) * 2 AS rows_kept, count(DISTINCT event_id) AS events FROM events")
def append_history(spark, sf):
    path = scratch_path(spark, "snk_history")
    e = table(spark, sf, "events").select("event_id", "event_type")
    sinks.append_history(e, path)
    sinks.append_history(e, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_kept"), F.countDistinct("event_id").alias("events"))


@query("snk_review_queue", """
SELECT 'accepted' AS part, count(*) AS n FROM labels WHERE toxic = 0
UNION ALL SELECT 'triplet', count(*) FROM labels WHERE toxic = 1
UNION ALL SELECT 'review', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars <= 10000
UNION ALL SELECT 'error', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars > 10000""")
def review_queue(spark, sf):
    d = documents(spark, sf).select("doc_id", "n_chars")
    lab = table(spark, sf, "labels")
    pred = lab.select("doc_id", F.lit("triplet").alias("output_type"), (F.col("toxic") == 1).alias("needs_human_review"), F.array(F.lit("low_tuple_confidence")).alias("review_reasons"))
    err = d.join(lab, "doc_id", "left_anti").where("n_chars > 10000").select("doc_id", F.lit("too_long").alias("reason"))
    accepted, queue = sinks.split_for_review(pred, d, err)
    return accepted.select(F.lit("accepted").alias("part")).union(queue.select("output_type")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("snk_filtered_export", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'thnt') AND source = 'src4'")
def filtered_export(spark, sf):
    path = scratch_path(spark, "snk_filter")
    rows = sinks.filtered_export(documents(spark, sf), "text", "THNT", "source", "src4")
    sinks.write_report(rows.select("doc_id", "source"), path)
    return spark.read.option("header", True).schema("doc_id long, source string").csv(path)
