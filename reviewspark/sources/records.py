"""JSON, TSV, tuple-line, CoNLL, XML, wide-table and folder sources of annotated reviews."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark import lexicons as lx
from reviewspark.functions import text as tx
from reviewspark.functions.spans import find_spans
from reviewspark.schemas import ANNOTATIONS, ANNOTATIONS_DDL, RAW_RECORD
from reviewspark.sources.files import number_rows

SPLIT_OF_NAME = [("test", "test"), ("valid", "validation"), ("val", "validation"), ("dev", "validation"), ("train", "train")]


def split_from_name(name: Column) -> Column:
    out = None
    for needle, split in SPLIT_OF_NAME:
        cond = F.contains(F.lower(name), F.lit(needle))
        out = F.when(cond, split) if out is None else out.when(cond, split)
    return out


def safe_json_list(cell: Column, element: str | None = None) -> Column:
    """A JSON cell to a list: a list, an object with ``annotations``, or empty for anything else."""
    schema = element or ANNOTATIONS_DDL
    as_list = F.when(F.ltrim(cell).startswith("["), F.from_json(cell, schema))
    as_object = F.when(F.ltrim(cell).startswith("{"), F.from_json(cell, f"struct<annotations:{schema}>")["annotations"])
    return F.coalesce(as_list, as_object, F.from_json(F.lit("[]"), schema))


def read_json_records(spark: SparkSession, path, schema=None, kind: str = "lines") -> DataFrame:
    """JSON lines, a JSON list, or an object holding ``records`` / ``reviews``."""
    schema = schema or RAW_RECORD
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    if kind == "lines":
        return spark.read.schema(schema).json(path)
    if kind == "list":
        return spark.read.schema(schema).option("multiLine", True).json(path)
    inner = ddl if ddl.startswith("struct<") else f"struct<{ddl}>"
    wrapped = spark.read.schema(f"records array<{inner}>, reviews array<{inner}>").option("multiLine", True).json(path)
    return wrapped.select(F.explode(F.coalesce("records", "reviews")).alias("r")).select("r.*")


JSON_CELLS = ["annotations", "phenomena", "provenance", "tasks", "mentions", "buckets"]


def parse_json_cells(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """CSV columns that hold JSON, parsed with the given schemas."""
    return df.withColumns({c: F.from_json(c, s) for c, s in schemas.items() if c in df.columns and c in JSON_CELLS})


def read_sentiment_tsv(spark: SparkSession, path, source: str = "document_sentiment") -> DataFrame:
    """Two columns, text and label; rows without a three-class label are left out."""
    raw = number_rows(
        spark.read.schema("text string, sentiment string").option("sep", "\t").option("quote", "").csv(path)
    )
    sentiment = tx.canonical_sentiment(F.col("sentiment"))
    name = F.element_at(F.split("_path", "/"), -1)
    return raw.select(
        "text", sentiment.alias("overall_sentiment"), split_from_name(name).alias("split"),
        F.concat_ws(":", name, F.col("row_number").cast("string")).alias("source_record_id"),
        tx.content_id(F.lit(source), name, (F.col("row_number") - 1).cast("string"), F.col("text")).alias("id"),
    ).where(F.col("overall_sentiment").isin(lx.SENTIMENTS))


TUPLE_ITEM = r"""[(\[]\s*(None|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")\s*,\s*('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")\s*,\s*('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""


def _literal(x: Column) -> Column:
    body = F.substring(x, F.lit(2), F.length(x) - 2)
    return F.when(x != "None", F.regexp_replace(body, r"\\(['\"\\])", "$1"))


def assign_offsets(df: DataFrame, text: str, term: str, record: str, position: str) -> DataFrame:
    """The n-th mention of a term takes its n-th occurrence in the text, capped at the last one.

    Adds start, end and the matched surface; null where the term does not occur.
    Repeats are counted per (record, term), so groups stay as small as a review.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(record, F.lower(F.col(term))).orderBy(position)
    low_text, low_term = F.lower(F.col(text)), F.lower(F.col(term))
    hits = F.size(F.split(low_text, F.concat(F.lit("\\Q"), low_term, F.lit("\\E")), -1)) - 1
    nth = F.least(F.row_number().over(w), hits)
    ranked = df.withColumn("_hits", F.when(F.trim(F.col(term)) != "", hits).otherwise(F.lit(0))).withColumn("_nth", nth)
    head = F.expr(f"substring_index(lower(`{text}`), lower(`{term}`), _nth)")
    start = F.when(F.col("_hits") > 0, F.length(head))
    ranked = ranked.withColumn("start", start).withColumn("end", F.col("start") + F.length(F.col(term)))
    return ranked.withColumn("surface", F.expr(f"substring(`{text}`, start + 1, end - start)")).drop("_hits", "_nth")


def read_tuple_lines(spark: SparkSession, path, source: str = "parallel_tuples") -> tuple[DataFrame, DataFrame]:
    """``text####[(term, category, sentiment), ...]`` lines to (annotations, rejected).

    The layout ``<domain>/<language>/<split>.txt`` gives domain, language and
    split; line number and file name give a family id shared by translations.
    """
    lines = number_rows(spark.read.text(path)).where(F.trim("value") != "")
    parts = F.split("_path", "/")
    base = lines.select(
        F.col("row_number").alias("line"), F.element_at(parts, -3).alias("domain"), F.element_at(parts, -2).alias("language"),
        F.element_at(parts, -1).alias("file"), F.split("value", "####", 2).alias("p"),
    ).select("line", "domain", "language", "file", F.get("p", F.lit(0)).alias("text"), F.get("p", F.lit(1)).alias("raw"))
    base = base.withColumn("family_id", tx.content_id(F.lit(source), F.col("domain"), F.col("file"), F.col("line").cast("string")))
    base = base.withColumn("id", tx.content_id(F.lit(source), F.col("domain"), F.col("language"), F.col("file"), F.col("line").cast("string"), F.col("text")))
    base = base.withColumn("split", split_from_name(F.col("file")))
    items = F.regexp_extract_all("raw", F.lit(TUPLE_ITEM), F.lit(0))
    rows = base.select("id", "family_id", "domain", "language", "split", "file", "line", "text", F.posexplode(items).alias("pos", "item"))
    fields = [F.regexp_extract("item", TUPLE_ITEM, i) for i in (1, 2, 3)]
    rows = rows.select(
        "id", "family_id", "domain", "language", "split", "file", "line", "text", "pos",
        _literal(fields[0]).alias("term"), _literal(fields[1]).alias("category"), tx.canonical_sentiment(_literal(fields[2])).alias("sentiment"),
    )
    implicit = F.col("term").isNull() | F.upper("term").isin("NULL", "NONE")
    placed = assign_offsets(rows, "text", "term", "id", "pos").withColumn("implicit", implicit)
    good = placed.where(F.col("implicit") | F.col("start").isNotNull()).select(
        "id", "family_id", "domain", "language", "split", "file", "line", "text", "pos", "category", "sentiment", "implicit",
        F.when(~F.col("implicit"), F.col("surface")).alias("aspect_term"),
        F.when(~F.col("implicit"), F.col("start")).alias("aspect_start"), F.when(~F.col("implicit"), F.col("end")).alias("aspect_end"),
    )
    unreadable = base.where(F.col("raw").isNull() | ((F.size(items) == 0) & ~F.col("raw").rlike(r"^\s*\[\s*\]\s*$")))
    rejected = placed.where(~F.col("implicit") & F.col("start").isNull()).select(
        "file", "line", F.lit("aspect_offset_not_found").alias("reason"), "term"
    ).unionByName(unreadable.select("file", "line", F.lit("unreadable_tuples").alias("reason"), F.lit(None).cast("string").alias("term")))
    return good, rejected


def line_count_mismatches(lines: DataFrame) -> DataFrame:
    """Parallel files of one (domain, file) whose line counts differ between languages."""
    counts = lines.groupBy("domain", "file", "language").agg(F.max("line").alias("lines"))
    return counts.groupBy("domain", "file").agg(F.min("lines").alias("least"), F.max("lines").alias("most")).where("least <> most")


def read_conll(spark: SparkSession, path) -> DataFrame:
    """Token/tag files, blank-line delimited, to (path, sentence, pos, token, tag, start, end).

    The blank line is the record separator of the text reader, so a big file is
    still split between tasks. A line of white space ends a sentence too, also
    with CRLF line ends; such a file is read by one task.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path)
    sentences = blocks.select(F.explode(F.split("value", r"\n[^\S\n]*\n")).alias("value"), F.col("_metadata"))
    numbered = number_rows(sentences.where(F.col("value").rlike(r"\S")), out="sentence")
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x).rlike(r"\S\s+\S"))
    pairs = F.transform(lines, lambda x: F.struct(
        F.regexp_extract(F.trim(x), r"^(.*\S)\s+(\S+)$", 1).alias("token"), F.regexp_extract(F.trim(x), r"^(.*\S)\s+(\S+)$", 2).alias("tag")))
    rows = numbered.select(F.col("_path").alias("path"), "sentence", pairs.alias("pairs"))
    texted = rows.withColumn("text", F.array_join(F.transform("pairs", lambda p: p["token"]), " "))
    ex = texted.select("path", "sentence", "text", "pairs", F.posexplode("pairs").alias("pos", "p"))
    start = F.aggregate(F.slice("pairs", F.lit(1), F.col("pos")), F.lit(0), lambda acc, p: acc + F.length(p["token"]) + 1)
    return ex.select("path", "sentence", "text", "pos", F.col("p.token").alias("token"), F.col("p.tag").alias("tag"), start.alias("start")).withColumn(
        "end", F.col("start") + F.length("token")
    )


def term_tags(df: DataFrame, tag: str = "tag") -> DataFrame:
    """CoNLL tags like ``B-ASPECT`` / ``I-SENTIMENT`` to kind (aspect, opinion) and B/I/O."""
    up = F.upper(F.col(tag))
    bio = F.when(up.rlike(r"^[BI]-"), F.substring(up, 1, 1)).otherwise("O")
    body = F.regexp_replace(up, r"^[BI]-", "")
    kind = F.when(F.contains(body, F.lit("ASP")), "aspect").when(body.rlike("OPN|SEN"), "opinion")
    return df.withColumn("kind", F.when(bio != "O", kind)).withColumn("bio", F.when(F.col("kind").isNull(), "O").otherwise(bio))


XML_SENTENCE = (
    "text string, aspectTerms struct<aspectTerm:array<struct<_term:string,_from:string,_to:string,_polarity:string>>>"
)


def read_aspect_xml(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """``<sentence><text/><aspectTerms>`` files to (annotations, issues)."""
    rows = spark.read.format("xml").option("rowTag", "sentence").schema(XML_SENTENCE).load(path)
    rows = rows.withColumn("_file", F.input_file_name())
    ex = rows.select(
        F.element_at(F.split("_file", "/"), -1).alias("file"), F.coalesce("text", F.lit("")).alias("text"),
        F.posexplode("aspectTerms.aspectTerm").alias("pos", "t"),
    ).select(
        "file", "text", "pos", F.col("t._term").alias("aspect_term"), F.expr("try_cast(t._from as int)").alias("aspect_start"),
        F.expr("try_cast(t._to as int)").alias("aspect_end"), tx.canonical_sentiment(F.col("t._polarity")).alias("sentiment"),
    ).withColumn("split", split_from_name(F.col("file"))).withColumn("id", tx.content_id(F.lit("xml"), F.col("file"), F.col("text")))
    s, e, n = F.col("aspect_start"), F.col("aspect_end"), F.length("text")
    reason = F.when(s.isNull() | e.isNull(), "invalid_offset").when(
        ~((s >= 0) & (s < e) & (e <= n)) | (F.substring(F.col("text"), s + 1, e - s) != F.col("aspect_term")), "offset_term_mismatch"
    )
    checked = ex.withColumn("reason", reason)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null").select("file", "reason", F.col("aspect_term").alias("term"))


def wide_to_long(df: DataFrame, ids: list[str], categories: list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """One column per category to rows (ids, category, sentiment); other labels are left out."""
    present = [c for c in categories if c in df.columns]
    strung = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in present])
    long = strung.unpivot(ids, present, "category", "raw")
    low = F.lower(F.trim("raw"))
    named = F.coalesce(F.try_element_at(lx.literal_map(labels), low), tx.canonical_sentiment(low)) if labels else tx.canonical_sentiment(low)
    return long.withColumn("sentiment", named).drop("raw").where(F.col("sentiment").isin(lx.SENTIMENTS))


def category_is_explicit(sentence: Column, category: Column, keywords=None) -> Column:
    """Does the sentence mention the category by one of its keywords?"""
    table = keywords or lx.CATEGORY_KEYWORDS
    low, cat = F.lower(sentence), F.lower(category)
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(w.lower()) for w in v]))])
    words = F.coalesce(F.try_element_at(known, cat), F.array(F.translate(cat, "_", " ")))
    return F.exists(words, lambda w: F.contains(low, w))


def keep_explicit_neutral(df: DataFrame, sentence: str = "text", keywords=None) -> DataFrame:
    """In wide tables neutral often means "not mentioned": keep it only if it is mentioned."""
    return df.where((F.col("sentiment") != "neutral") | category_is_explicit(F.col(sentence), F.col("category"), keywords))


def find_column(columns: list[str], candidates: list[str]) -> str | None:
    """Header lookup: normalised equality first, then containment."""
    norm = {re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_"): c for c in columns}
    for cand in candidates:
        if cand in norm:
            return norm[cand]
    return next((c for n, c in norm.items() if any(cand in n for cand in candidates)), None)


TEXT_HEADERS = ["review_text", "review", "text", "ulasan", "comment"]
ASPECT_HEADERS = ["aspect", "aspect_category", "aspek", "category"]
LABEL_HEADERS = ["sentiment", "sentimen", "polarity", "label"]
SPLIT_HEADERS = ["split", "set", "partition"]


def read_category_corpus(df: DataFrame, wide: dict[str, list[str]] | None = None, name: str | None = None) -> DataFrame:
    """Long or wide category tables with loosely named headers to (text, category, sentiment, trust, weight, split)."""
    cols = df.columns
    text = find_column(cols, TEXT_HEADERS)
    aspect, label, split = (find_column(cols, c) for c in (ASPECT_HEADERS, LABEL_HEADERS, SPLIT_HEADERS))
    low = (name or "").lower()
    gold = "gold" in low
    if aspect and label:
        out = df.select(
            F.col(text).alias("text"), F.col(aspect).cast("string").alias("category"), tx.canonical_sentiment(F.col(label)).alias("sentiment"),
            (F.lower(F.col(split)) if split else F.lit(None).cast("string")).alias("split"),
        ).where(F.col("sentiment").isin(lx.SENTIMENTS))
    else:
        renamed = {c: next((x for x in cols if x.lower() in al), None) for c, al in (wide or {}).items()}
        chosen = df.select(F.col(text).alias("text"), *[F.col(v).alias(k) for k, v in renamed.items() if v])
        out = keep_explicit_neutral(wide_to_long(chosen, ["text"], list(renamed))).withColumn("split", F.lit(None).cast("string"))
    fallback = next((s for n, s in SPLIT_OF_NAME if n in low), "train")
    return out.withColumns({
        "split": F.coalesce(F.try_element_at(lx.literal_map(lx.SPLIT_ALIASES), F.col("split")), F.col("split"), F.lit(fallback)),
        "trust": F.lit("public_gold_category" if gold else "public_silver_category"),
        "sample_weight": F.lit(1.0 if gold else 0.5),
    })


FOLDER_KINDS = {"*.csv": "csv", "*.jsonl": "lines", "*.json": "list"}


def read_annotation_folder(spark: SparkSession, folder: str, schema=None, kinds: dict[str, str] | None = None) -> DataFrame:
    """A staged folder of CSV, JSON-lines and JSON-list exports as one frame."""
    schema = schema or "review_id string, place_id string, domain string, review_text_raw string, annotations_json string, human_status string, suggested_split string, duplicate_status string"
    out = None
    for pattern, kind in (kinds or FOLDER_KINDS).items():
        reader = spark.read.schema(schema).option("pathGlobFilter", pattern)
        if kind == "csv":
            part = reader.option("header", True).option("escape", '"').option("multiLine", True).csv(folder)
        else:
            part = reader.option("multiLine", kind == "list").json(folder)
        part = part.withColumn("file_name", F.col("_metadata.file_name"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


SKIP_EXPORTS = ["annotations_long", "annotation_audit", "human_review"]


def file_priority(name: Column) -> Column:
    """0 human approved, 1 QC ready, 2 other; null for long and audit exports."""
    low = F.lower(name)
    return F.when(
        ~tx.any_contains(low, SKIP_EXPORTS),
        F.when(F.contains(low, F.lit("human_approved")), 0).when(F.contains(low, F.lit("qc_ready")), 1).otherwise(2),
    )


def dataset_type(columns: list[str], rows: int, name: str = "") -> str:
    """Kind of dataset judged from its columns, size and name."""
    cols = {c.lower() for c in columns}
    low = name.lower()
    if cols & {"human_status", "human_approved"}:
        return "gold_pilot"
    if any("synthetic" in c for c in cols) or "template_id" in cols or "v11" in low:
        return "v11_synthetic"
    has_aspect = bool(cols & {"aspect_term", "aspect", "taxonomy"})
    has_text = bool(cols & {"text", "review_text", "review", "content"})
    if any(k in low for k in ("gmaps_reviews", "v10", "all_datasets")) or (has_aspect and has_text and rows > 500):
        return "v10_master"
    if has_aspect:
        return "silver"
    return "dapt_corpus" if has_text and rows else "auxiliary"


def long_to_nested(df: DataFrame, key: str, order: str, annotation_cols: list[str], meta_cols: list[str], means: list[str] = ()) -> DataFrame:
    """Long annotation rows to one record per id: annotations in order, review-level means."""
    packed = F.struct(F.col(order).alias("_o"), F.struct(*annotation_cols).alias("a"))
    return df.groupBy(key).agg(
        *[F.min_by(c, order).alias(c) for c in meta_cols],
        F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["a"]).alias("annotations"),
        *[F.avg(c).alias(f"mean_{c}") for c in means],
    )


def read_bundle(spark: SparkSession, record_paths: list[str], relation_paths: list[str] = (), schema=None) -> tuple[DataFrame, DataFrame | None]:
    """All record and relation files of a bundle in one scan each."""
    records = spark.read.schema(schema or RAW_RECORD).json(record_paths)
    relations = None
    if relation_paths:
        relations = spark.read.option("header", True).schema(
            "record_id string, aspect_start int, aspect_end int, opinion_start int, opinion_end int, label string, source string, sample_weight double"
        ).csv(list(relation_paths))
    return records, relations


def duplicate_ids(records: DataFrame, key: str = "id") -> DataFrame:
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``<sha256>  <path>`` lines."""
    return spark.read.text(path).where(F.trim("value") != "").select(
        F.lower(F.regexp_extract("value", r"^([0-9a-fA-F]{64})\s+", 1)).alias("expected"),
        F.regexp_replace(F.regexp_extract("value", r"^\S+\s+(.*)$", 1), r"^[* ]+", "").alias("name"),
    )


def verify_checksums(spark: SparkSession, base: str, manifest: DataFrame) -> DataFrame:
    """name, expected, actual, bytes and status for every manifest row and every extra file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    actual = files.select(
        F.regexp_replace(F.element_at(F.split("path", F.lit(base.rstrip("/") + "/")), -1), r"^/+", "").alias("name"),
        F.sha2("content", 256).alias("actual"), F.col("length").alias("bytes"),
    )
    joined = manifest.join(actual, "name", "full_outer")
    status = (
        F.when(F.col("actual").isNull(), "missing_file").when(F.col("expected").isNull(), "not_listed")
        .when(F.col("expected") == "", "invalid_row").when(F.col("expected") != F.col("actual"), "mismatch").otherwise("ok")
    )
    return joined.withColumn("status", status)


def request_rows(df: DataFrame) -> DataFrame:
    """Request objects with alternative key names to uniform rows."""
    def pick(*names):
        have = [F.col(n) for n in names if n in df.columns]
        return tx.first_nonempty(*have) if have else F.lit(None).cast("string")

    return df.select(
        F.coalesce(pick("review", "text", "value"), F.lit("")).alias("raw_text"), pick("customer_id").alias("customer_id"),
        pick("city", "kota").alias("city"), pick("province", "provinsi").alias("province"),
    )
