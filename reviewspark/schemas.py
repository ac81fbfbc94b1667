"""Explicit schemas of the review data model."""

from pyspark.sql import types as T

ANNOTATION = T.StructType([
    T.StructField("aspect_term", T.StringType()),
    T.StructField("aspect_start", T.IntegerType()),
    T.StructField("aspect_end", T.IntegerType()),
    T.StructField("opinion_term", T.StringType()),
    T.StructField("opinion_start", T.IntegerType()),
    T.StructField("opinion_end", T.IntegerType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("aspect_category", T.StringType()),
    T.StructField("entity_category", T.StringType()),
    T.StructField("implicit", T.BooleanType()),
    T.StructField("relation", T.BooleanType()),
    T.StructField("mention_type", T.StringType()),
    T.StructField("annotation_confidence", T.DoubleType()),
    T.StructField("sample_weight", T.DoubleType()),
])
ANNOTATIONS = T.ArrayType(ANNOTATION)
ANNOTATION_DDL = ANNOTATION.simpleString()
ANNOTATIONS_DDL = ANNOTATIONS.simpleString()

PROVENANCE = T.ArrayType(T.StructType([
    T.StructField("source_bundle", T.StringType()),
    T.StructField("source_dataset", T.StringType()),
    T.StructField("source_record_id", T.StringType()),
]))

RAW_RECORD = T.StructType([
    *[T.StructField(n, T.StringType()) for n in (
        "id", "text", "split", "source_dataset", "source_bundle", "source_record_id", "annotation_status",
        "human_status", "human_approved", "is_synthetic", "annotation_complete", "family_id", "place_id",
        "language", "domain", "sample_weight",
    )],
    T.StructField("annotations", ANNOTATIONS),
])

RELATION = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("aspect_start", T.IntegerType()),
    T.StructField("aspect_end", T.IntegerType()),
    T.StructField("opinion_start", T.IntegerType()),
    T.StructField("opinion_end", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("sample_weight", T.DoubleType()),
])

SILVER_LONG = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("review_id", "place_id", "domain", "review_text_raw", "split", "annotation_id", "aspect_term")],
    T.StructField("aspect_start", T.IntegerType()),
    T.StructField("aspect_end", T.IntegerType()),
    T.StructField("opinion_term", T.StringType()),
    T.StructField("opinion_start", T.IntegerType()),
    T.StructField("opinion_end", T.IntegerType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("taxonomy", T.StringType()),
    T.StructField("annotation_confidence", T.DoubleType()),
    T.StructField("silver_loss_weight", T.DoubleType()),
])
