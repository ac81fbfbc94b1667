"""Views shared by the bound queries, and the SQL fragments that mirror them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.functions import text as tx
from reviewspark.registry import table
from reviewspark.scale import computed, spread

# Lexicons of words that occur in the driver corpus (the corpus is invented prose).
ASPECT_WORDS = ["this", "from", "sich", "dans", "los", "than", "mit", "par"]
OPINION_WORDS = ["was", "with", "that", "und", "que", "pour"]
ASPECT_RE = r"(?Ui)\b(?:" + "|".join(ASPECT_WORDS) + r")\b"
OPINION_RE = r"(?Ui)\b(?:" + "|".join(OPINION_WORDS) + r")\b"


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# collapse whitespace, as the engine's key functions do
def sql_ws(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def sql_fold(expr: str) -> str:
    return f"replace(lower({expr}), 'ß', 'ss')"


WORD = "[\\p{L}\\p{N}_]"
SQL_LEAK = "trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def sql_hash01(expr: str, digits: int, div: str, fn: str = "sha1") -> str:
    return f"(CAST(('0x' || substr({fn}({expr}), 1, {digits})) AS UBIGINT)::DOUBLE / {div})"


def sql_place_split(expr: str) -> str:
    u = sql_hash01(expr, 8, "4294967295.0")
    return f"CASE WHEN {u} < 0.7 THEN 'train' WHEN {u} < 0.7 + 0.15 THEN 'validation' ELSE 'test' END"


# every word of every document with its offsets
SQL_TOKENS = """
pieces AS (
  SELECT doc_id, text,
         regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS words,
         string_split_regex(text, '[\\p{L}\\p{N}_]+') AS gaps
  FROM documents
), tok0 AS (
  SELECT doc_id, unnest(words) AS term, unnest(gaps[:len(words)]) AS gap,
         unnest(range(len(words))) AS i
  FROM pieces WHERE len(words) > 0
), tok AS (
  SELECT doc_id, term, i,
         (sum(length(gap)) OVER w + sum(length(term)) OVER w - length(term))::INTEGER AS s,
         (sum(length(gap)) OVER w + sum(length(term)) OVER w)::INTEGER AS e
  FROM tok0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)
)"""
SQL_SPANS = SQL_TOKENS + f""",
asp AS (SELECT doc_id, s, e, term FROM tok WHERE lower(term) IN ({sql_list(ASPECT_WORDS)})),
opn AS (SELECT doc_id, s, e, term FROM tok WHERE lower(term) IN ({sql_list(OPINION_WORDS)}))"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Documents seen as review records: the split is derived from a stable hash of the id."""
    d = documents(spark, sf)
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        "doc_id", "text",
        F.col("lang").alias("language"),
        F.col("source").alias("domain"),
        F.col("source").alias("place_id"),
        tx.place_split(F.col("doc_id").cast("string")).alias("split"),
    )


SQL_REVIEWS = f"""
reviews AS (
  SELECT doc_id::VARCHAR AS id, doc_id, text, lang AS language, source AS domain, source AS place_id,
         {sql_place_split('doc_id::VARCHAR')} AS split
  FROM documents
)"""


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews with one annotation per aspect word; labels and confidences follow from the offset."""
    from reviewspark.functions.spans import find_spans
    from reviewspark.schemas import ANNOTATION

    def build(a):
        s = a["start"]
        values = {
            "aspect_term": a["term"], "aspect_start": s, "aspect_end": a["end"],
            "sentiment": F.when(s % 3 == 0, "positif").when(s % 3 == 1, "neg").otherwise("neutral"),
            "aspect_category": F.lower(a["term"]), "implicit": F.lit(False), "relation": F.lit(True),
            "annotation_confidence": F.round(F.lit(0.8) + (s % 20) / 100, 2), "sample_weight": F.lit(1.0),
        }
        return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ANNOTATION.fields])

    found = computed(reviews(spark, sf), {"annotations": F.transform(find_spans(F.col("text"), ASPECT_RE), build)})
    return found.withColumns({
        "raw_text": F.col("text"),
        "source_dataset": F.col("domain"), "source_record_id": F.col("id"),
        "annotation_status": F.lit("dataset_release"), "family_id": F.lit(None).cast("string"),
    })


SQL_ANNOTATED = SQL_SPANS + f""",
ann AS (
  SELECT a.doc_id::VARCHAR AS id, a.doc_id, a.s, a.e, a.term, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.s) - 1 AS idx,
    CASE a.s % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS sentiment,
    round(0.8::DOUBLE + (a.s % 20) / 100.0::DOUBLE, 2) AS conf
  FROM asp a
),{SQL_REVIEWS}"""
