"""Projected times and reads of the third review: each input is read once."""

import random

from pyspark.sql import functions as F

from reviewspark.bindings import evaluations as be
from reviewspark.bindings import io_roundtrip as io
from reviewspark.bindings import spans_pairs as spp
from reviewspark.operators import contract as ct
from reviewspark.operators import evaluation as ev
from reviewspark.operators import learning as ml
from reviewspark.operators import spans as sp
from reviewspark.plans import tuples
from reviewspark.schemas import ANNOTATIONS_DDL


def _leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_exact_evaluation_reads_each_side_once(spark):
    schema = "id string, aspect_start int, aspect_end int, opinion_start int, opinion_end int, sentiment string"
    g = spark.createDataFrame([("a", 0, 3, 4, 8, "positive"), ("a", 9, 12, None, None, "negative"), ("b", 0, 3, 4, 8, "mixed"), ("c", 0, 3, 4, 8, "negative")], schema).withColumn("relation", F.lit(None).cast("boolean"))
    p = spark.createDataFrame([("a", 0, 3, 4, 8, "positive", False), ("a", 0, 3, 4, 8, "positive", False), ("b", 0, 3, 4, 8, "mixed", None), ("c", 0, 3, 4, 9, "negative", True)],
                              schema + ", needs_human_review boolean")
    out = ev.exact_evaluation(g, p)
    assert _leaves(out) == 2
    got = {r["kind"]: (r["tp"], r["fp"], r["fn"], r["prediction_coverage"]) for r in out.collect()}
    assert got == {"aspect": (3, 0, 1, None), "opinion": (2, 1, 1, None), "pair": (1, 2, 1, None), "triplet": (1, 2, 1, None), "negative_triplet": (0, 1, 1, None), "auto_accepted": (1, 0, 1, 1 / 3)}


def test_gold_and_predictions_read_the_texts_once(spark, tmp_path):
    rows = [(i, "this was good, from that und " * (i % 4) + "sich", f"src{i % 4}", "en", 10) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    g, p = be.gold_and_pred(spark, str(tmp_path))
    for df in (g, p):
        assert "find" not in df._jdf.queryExecution().optimizedPlan().toString() and "parquet" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert g.count() == sum(2 * (i % 4) + 1 for i in range(40)) and p.where("taxonomy = 'spurious' and needs_human_review").count() > 0


def test_contract_works_the_annotations_out_once(spark):
    raw = spark.range(50).select(
        F.col("id").cast("string").alias("id"), F.lit("this was").alias("text"), F.lit("dev").alias("split"), F.lit("s").alias("source_dataset"),
        *[F.lit(None).cast("string").alias(c) for c in ("source_bundle", "source_record_id", "annotation_status", "human_status", "human_approved", "is_synthetic",
                                                       "annotation_complete", "family_id", "place_id", "language", "domain", "sample_weight")],
        F.from_json(F.lit('[{"aspect_term":"this","aspect_start":0,"aspect_end":4,"sentiment":"pos"},{"aspect_term":"this","aspect_start":0,"aspect_end":4,"sentiment":"pos"},'
                          '{"aspect_term":"wa","aspect_start":5,"aspect_end":7,"sentiment":"neg"},{"sentiment":"neg"},{"sentiment":"neg"}]'), ANNOTATIONS_DDL).alias("a"))
    raw = raw.withColumn("annotations", F.filter("a", lambda a: F.length("id") > 0)).drop("a")
    good, issues = ct.canonical_records(raw)
    for df in (good, issues):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("(length(id") <= 1
    assert good.count() == 50 and issues.count() == 0
    assert [(a["aspect_start"], a["aspect_term"]) for a in good.first()["annotations"]] == [(0, "this"), (5, "wa"), (None, None)]


def test_written_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    rows = [(i, "x" * 100, "s", "en", 100) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sums = io.checksums(spark, str(tmp_path)).collect()
    assert {r["status"]: r["files"] for r in sums} == {"ok": 3, "mismatch": 1}
    monkeypatch.setattr(io, "FILE_BYTES", 4000)
    assert {r["status"]: r["files"] for r in io.checksums(spark, str(tmp_path)).collect()} == {"ok": 9, "mismatch": 1}
    assert {(r["kind"], r["n"], r["chars"], r["ids"]) for r in io.json_records(spark, str(tmp_path)).collect()} == {("lines", 200, 20000, 200), ("cells", 200, 20000, 200)}


def test_tuples_decode_their_pairs_once(spark):
    """Decoded pairs are read for the triplets and for the aspects left over, and no diagnostics are looked up without a budget."""
    df = spark.createDataFrame([(1, "kopi enak dan murah, tempat nyaman"), (2, "kopi"), (3, "  ")], "doc_id long, text string")
    out = tuples.review_tuples(df, aspect_patterns=[("drink", r"\bkopi\b"), ("place", r"\btempat\b")], heads=[], opinion_patterns=[("positive", r"\b(?:enak|nyaman)\b")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "window" not in plan.lower() and "row_number" not in plan.lower()
    got = {(r["doc_id"], r["output_type"], r["aspect_term"], r["opinion_term"]) for r in out.collect()}
    assert got == {(1, "triplet", "kopi", "enak"), (1, "triplet", "tempat", "nyaman"), (2, "aspect_only", "kopi", None)}
    limited = tuples.review_tuples(df, budget=1, aspect_patterns=[("drink", r"\bkopi\b"), ("place", r"\btempat\b")], heads=[], opinion_patterns=[("positive", r"\b(?:enak|nyaman)\b")])
    assert any("incomplete_candidate_processing" in r["review_reasons"] for r in limited.where("doc_id = 1").collect())


def test_classifiers_hash_the_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        read.add(1)
        return t

    words = {"en": "the good house", "fr": "la bonne maison"}
    df = spark.createDataFrame([(words[k] + f" x{i}", k) for i in range(20) for k in words], "t string, label string").withColumn("w", F.lit(1.0))
    df.cache().count()
    models = ml.fit_text_classifiers(df.withColumn("t", seen("t")), "t", "label", "w", ["en", "fr"], 64, (0.3, 0.01), 5)
    assert read.value == 40 and len(models) == 2
    for m in models:
        assert ml.classify(m, df).where("label = predicted").count() == 40
    assert ml.select_category_model(models, df, "label", ["en", "fr"])[1] == 1.0


def _random_reviews(rng):
    out = []
    for doc in range(30):
        at, toks = 0, []
        for _ in range(rng.choice([0, 1, 5, 40, 100])):
            at += rng.randint(0, 4)
            end = at + rng.randint(1, 9)
            toks.append((at, end, rng.choice("BIIO"), rng.randint(0, 9) / 10))
            at = end
        spans = [(s, s + rng.randint(1, 40)) for s in (rng.randint(0, 300) for _ in range(rng.randint(0, 12)))]
        out.append((doc, toks, spans + spans[:1]))
    return out


def test_tags_and_spans_in_the_row_equal_those_of_the_tables(spark):
    df = spark.createDataFrame(_random_reviews(random.Random(3)), "doc_id long, t array<struct<start:int,end:int,tag:string,prob:double>>, s array<struct<start:int,end:int>>").cache()
    rows = df.select("doc_id", F.posexplode("t").alias("pos", "t")).select("doc_id", "pos", "t.*")
    want = {tuple(r) for r in sp.spans_to_bio(rows.drop("tag", "prob"), df.select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.*")).select("doc_id", "pos", "tag").collect()}
    got = [tuple(r) for r in df.select("doc_id", F.posexplode(sp.bio_tags(F.col("t"), F.col("s")))).collect()]
    assert len(got) == len(want) and set(got) == want and {t for _, _, t in want} == {"B", "I", "O"}
    found = df.select("doc_id", F.explode(sp.bio_spans(F.col("t"))).alias("z")).select("doc_id", "z.*")
    for stray, score, column in (("open", "mean", "mean"), ("drop", "min", "low")):
        want = sorted((r["doc_id"], r["start"], r["end"], round(r["score"], 9)) for r in sp.decode_bio(rows, ["doc_id"], stray, score).collect())
        kept = found if stray == "open" else found.where("first = 'B'")
        assert want and sorted((r["doc_id"], r["start"], r["end"], round(r[column], 9)) for r in kept.collect()) == want


def test_token_queries_do_not_shuffle_tokens(spark, tmp_path):
    rows = [(i, "this wonderful afternoon, from somebody", "s", "en", 10) for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for run in (spp.decode_bio, spp.spans_to_bio):
        plan = run(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan and "Join" not in plan
