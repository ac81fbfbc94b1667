"""Golden tables: customers, locations, formats, rules, categories, normalizer, contract."""

import pytest
from pyspark.sql import functions as F

from reviewspark import lexicons as lx
from reviewspark.functions import spans as fs
from reviewspark.functions import text as tx
from reviewspark.operators import contract as ct
from reviewspark.operators import enrich as en
from reviewspark.operators import normalize as nz
from reviewspark.operators import sentiment as se
from reviewspark.operators import spans as sp
from reviewspark.operators import taxonomy as ta
from reviewspark.plans import batch, tuples
from reviewspark.schemas import ANNOTATIONS_DDL
from reviewspark.sources import files, records


@pytest.fixture(scope="module")
def gazetteer(spark):
    return en.Gazetteer(*lx.region_dims(spark))


@pytest.mark.parametrize("text,field,cid,cls,warnings", [
    ("no213", None, "213", "SILVER", []), ("No 213", None, "213", "SILVER", []), ("NO:213", None, "213", "SILVER", []), ("id-213", None, "213", "SILVER", []),
    ("customer 213", None, "213", "SILVER", []), ("customer_id: 213", None, "213", "SILVER", []), ("harga 213 ribu", None, None, "UNKNOWN", []),
    ("no00123", None, "00123", "UNKNOWN", ["unsupported_customer_prefix"]), ("no9123", None, "9123", "UNKNOWN", ["unsupported_customer_prefix"]),
    ("no312 aplikasi bagus", "145", "145", "VIP", ["customer_id_conflict"]),
])
def test_customer(spark, text, field, cid, cls, warnings):
    r = spark.createDataFrame([(text, field)], "t string, f string").select(en.resolve_customer(F.col("t"), F.col("f")).alias("r")).first()["r"]
    assert (r["customer_id"], r["customer_class"], r["warnings"]) == (cid, cls, warnings)


def test_locations(spark, gazetteer):
    cases = [
        ("Surabaya no213 pengirimannya lambat", "resolved", "Kota Surabaya", "Jawa Timur"), ("no312 model ini sangat malang", "not_found", None, None),
        ("no145 saya tinggal di Kota Batu", "resolved", "Kota Batu", "Jawa Timur"), ("no245 produk ini keras seperti batu", "not_found", None, None),
        ("no345 cabang Solo pelayanannya lambat", "resolved", "Kota Surakarta", "Jawa Tengah"), ("no145 saya bekerja solo", "not_found", None, None),
        ("no345 aplikasi sering menyerang pengguna", "not_found", None, None), ("Bandung no123 aplikasi bagus", "ambiguous", None, "Jawa Barat"),
        ("no245 pengiriman ke Serang terlambat", "ambiguous", None, "Banten"),
    ]
    df = spark.createDataFrame([(i, c[0], None, None) for i, c in enumerate(cases)], "i int, raw_text string, city string, province string").withColumn("customer_id", F.lit(None).cast("string"))
    got = {r["i"]: r for r in en.enrich(df, gazetteer).collect()}
    for i, (_, status, city, province) in enumerate(cases):
        loc = got[i]["location"]
        assert (loc["status"], loc["city_or_regency"], loc["province"]) == (status, city, province), cases[i]
    assert set(got[7]["location"]["candidates"]) == {"Kota Bandung", "Kabupaten Bandung"}
    assert set(got[8]["location"]["candidates"]) == {"Kota Serang", "Kabupaten Serang"}


def test_enriched_row_and_fuzzy(spark, gazetteer):
    df = spark.createDataFrame([("no312 aplikasi sangat bagus", "213", "Bandung", "Jawa Barat"), ("paket dikirim ke Surabayaa cepat", None, None, None)], "raw_text string, customer_id string, city string, province string")
    a, b = en.enrich(df, gazetteer).collect()
    assert a["clean_review"] == "aplikasi sangat bagus" and a["customer"]["customer_class"] == "SILVER"
    assert a["location"]["city_or_regency"] == "Kota Bandung" and "customer_id_conflict" in a["warnings"]
    assert b["location"]["city_or_regency"] == "Kota Surabaya" and "fuzzy_location_match" in b["warnings"]


def test_batch_csv(spark, gazetteer, tmp_path):
    (tmp_path / "r.csv").write_text("customer,komentar\n213,kopinya enak\n145,=HYPERLINK(bad)\n312,\n", encoding="utf-8-sig")
    rows = files.read_review_files(spark, str(tmp_path / "r.csv"))
    out = batch.score_rows(rows, gazetteer, failed=F.contains("review", F.lit("HYPERLINK"))).orderBy("row_number").collect()
    assert [r["row_number"] for r in out] == [2, 3, 4]
    assert [r["processing_status"] for r in out] == ["success", "model_error", "empty_review"]
    assert out[0]["aspects"][0]["category"] == "Beverage Quality" and out[0]["original_fields"]["komentar"] == "kopinya enak"


def test_wrapped_export(spark, tmp_path):
    (tmp_path / "w.csv").write_text('"Review ID,Waktu Review,Isi Review";;;\n"1,kini,""Pelayanannya ramah, cepat dan baik.""";;;\n"2,kini,satu, dua, tiga";;;\n')
    rows = files.read_review_files(spark, str(tmp_path)).orderBy("row_number").collect()
    assert [r["review"] for r in rows] == ["Pelayanannya ramah, cepat dan baik.", "satu, dua, tiga"]


def test_missing_review_column(spark, tmp_path):
    (tmp_path / "t.csv").write_text("title\nx\n")
    assert "REVIEW_COLUMN_NOT_FOUND" in {r["code"] for r in files.file_issues(spark, str(tmp_path / "t.csv")).collect()}


def test_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("ulasan;kota\nkafé “enak”;Solo\n".encode("cp1252"))
    r = files.read_review_files(spark, str(tmp_path)).first()
    assert r["review"] == "kafé “enak”" and r["city"] == "Solo"


def test_row_numbers_follow_the_file(spark, tmp_path):
    (tmp_path / "n.csv").write_text("review\n" + "\n".join(f"r{i}" for i in range(1000)) + "\n")
    rows = files.read_reviews_csv(spark, str(tmp_path / "n.csv"), multiline=False).collect()
    assert sorted((r["row_number"], r["review"]) for r in rows) == [(i + 2, f"r{i}") for i in range(1000)]


def test_rule_engine(spark):
    df = spark.createDataFrame([(1, "Dokternya ramah tetapi antreannya lama."), (2, "zzz"), (3, "kopinya tidak enak")], "id int, text string")
    got = se.analyze_reviews(df, ["id"]).collect()
    assert {r["sentiment"] for r in got if r["id"] == 1} == {"positive", "negative"}
    assert [(r["aspect"], r["opinion"], r["category"]) for r in got if r["id"] == 2] == [("zzz", "bagus", "Overall Experience")]
    assert {r["sentiment"] for r in got if r["id"] == 3 and r["aspect"] == "kopinya"} == {"negative"}


def test_category_probes(spark):
    probes = [("parkiran", "parkiran luas, banyak pohon dan outdoor adem", "food_beverage", "generic.parking"), ("harga", "harga masih oke walaupun menu pricey", "food_beverage", "generic.price_value"),
              ("kopinya", "kopinya enak tapi pasta asin", "food_beverage", "fnb.beverage_quality"), ("dokternya", "dokternya ramah tapi antreannya lama", "healthcare", "healthcare.doctor")]
    df = spark.createDataFrame(probes, "a string, c string, d string, want string")
    for r in df.select("want", ta.map_category(F.col("a"), F.col("c"), F.col("d"))["taxonomy_id"].alias("got")).collect():
        assert r["got"] == r["want"]


def test_whole_taxonomy(spark):
    ids = [r[0] for r in lx.ALL_TAXONOMY_RULES]
    assert len(ids) == len(set(ids)) == 92
    # equal scores go to the rule that comes first in the table
    probes = [("kamarnya", "kamarnya luas", "hotel", "hotel.room"), ("guru", "guru sabar", None, "education.teacher"), ("HTM", "HTM mahal", None, "tourism.ticket_price"),
              ("dokternya", "dokternya ramah", "healthcare", "healthcare.medical_service"), ("zzz", "zzz", None, "generic.other")]
    df = spark.createDataFrame(probes, "a string, c string, d string, want string")
    for r in df.select("want", ta.map_category(F.col("a"), F.col("c"), F.col("d"), lx.ALL_TAXONOMY_RULES)["taxonomy_id"].alias("got")).collect():
        assert r["got"] == r["want"]


def test_normalizer(spark):
    samples = ["Servicenya lamaaa 😡 tapi food-nya enakkk 👍", "Ｋｏｐｉ\t enakkk", "Dr Anindhita ramah; ID AB12CD34 aman", "not bad, gr8 service", "[ASP] kopi [/ASP] [OPN] enak [/OPN]"]
    df = spark.createDataFrame([(i, s, "id-en") for i, s in enumerate(samples)], "i int, text string, lang string")
    out = {r["i"]: r for r in nz.normalize(df, "text", language="lang").collect()}
    assert out[0]["normalized_text"] == "Servicenya lamaa [EMOJI_NEG] tapi food-nya enakk [EMOJI_POS]" or out[0]["normalized_text"].startswith("pelayanannya lamaa [EMOJI_NEG]")
    assert out[1]["normalized_text"] == "Kopi enakk" and [p["rs"] for p in out[1]["alignment"]] == [0, 4, 6]
    assert "AB12CD34" in out[2]["normalized_text"] and "Anindhita" in out[2]["normalized_text"]
    assert out[4]["normalized_text"] == samples[4]
    checks = nz.quality_checks(df.select("i", "text")).collect()
    for r in checks:
        assert r["alignment_length"] and r["markers_preserved"] and r["roundtrip_word_spans"] and r["negation_preserved"] and r["idempotent"], r["i"]


def test_spans_count_code_points_and_overlap(spark):
    df = spark.createDataFrame([("a😡b kopi 👍kopi",)], "t string")
    assert [(s["start"], s["end"]) for s in df.select(fs.find_spans(F.col("t"), "kopi").alias("s")).first()["s"]] == [(4, 8), (10, 14)]
    ov = spark.range(1).select(fs.overlaps(F.lit(0), F.lit(8), F.lit(4), F.lit(12)), fs.overlaps(F.lit(0), F.lit(8), F.lit(8), F.lit(12))).first()
    assert list(ov) == [True, False]


def test_long_arrays_are_placed_right(spark):
    text = " ".join(f"w{i}" for i in range(500))
    got = spark.createDataFrame([(text,)], "t string").select(fs.find_spans(F.col("t"), r"w\d+").alias("s")).first()["s"]
    assert len(got) == 500 and all(text[s["start"]:s["end"]] == s["term"] for s in got)


def test_tuple_plan(spark):
    df = spark.createDataFrame([(1, "Kopi dan makanan enak. Pelayanan lambat!"), (2, ""), (3, "tanpa kata kunci")], "doc_id int, text string")
    got = tuples.review_tuples(df).collect()
    trip = {(r["aspect_term"], r["opinion_term"]) for r in got if r["output_type"] == "triplet"}
    assert ("Pelayanan", "lambat") in trip and ("makanan", "enak") in trip and ("Kopi", "enak") in trip
    assert all(r["needs_human_review"] for r in got) and {r["doc_id"] for r in got} == {1}


def test_contract_edges(spark):
    ann = '[{"aspect_term":"kopi","aspect_start":0,"aspect_end":4,"sentiment":"pos"},{"aspect_term":"kopi","aspect_start":0,"aspect_end":4,"sentiment":"positive"}]'
    clash = ann.replace('"positive"', '"negative"')
    rows = [("1", "kopi enak", ann), ("2", "kopi enak", clash), ("3", "teh enak", ann), (None, "x", "[]")]
    df = spark.createDataFrame(rows, "id string, text string, j string").withColumn("annotations", F.from_json("j", ANNOTATIONS_DDL)).drop("j")
    for c in ("source_bundle", "source_record_id", "annotation_status", "human_status", "human_approved", "is_synthetic", "annotation_complete", "family_id", "place_id", "language", "domain", "sample_weight"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    good, issues = ct.canonical_records(df.withColumn("split", F.lit("dev")).withColumn("source_dataset", F.lit("s")))
    kept = good.collect()
    assert [r["id"] for r in kept] == ["1"] and len(kept[0]["annotations"]) == 1 and kept[0]["split"] == "validation"
    assert {(r["id"], r["issue"]) for r in issues.collect()} == {("2", "contradictory_sentiment"), ("3", "aspect_offset_mismatch"), (None, "missing_id")}


def test_json_list_and_wrapper(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":"1","text":"x"},{"id":"2","text":"y"}]')
    (tmp_path / "b.json").write_text('{"records":[{"id":"3","text":"z"}]}')
    assert records.read_json_records(spark, str(tmp_path / "a.json"), "id string, text string", "list").count() == 2
    assert records.read_json_records(spark, str(tmp_path / "b.json"), "id string, text string", "wrapped").first()["id"] == "3"


def test_labels(spark):
    r = spark.createDataFrame([("negatif",)], "s string").select(tx.api_sentiment(F.col("s"))).first()
    assert r[0] == "negative"


def _greedy(spans, clash):
    kept = []
    for s in sorted(spans, key=lambda x: (-x[2], -(x[1] - x[0]), x[0])):
        if not any(clash(s, k) for k in kept):
            kept.append(s)
    return sorted((a, b) for a, b, _ in kept)


def test_merge_spans_against_brute_force(spark):
    import random

    rng = random.Random(7)
    for _ in range(5):
        spans = [(a, a + rng.randint(1, 15), round(rng.random(), 3)) for a in (rng.randint(0, 60) for _ in range(25))]

        def clash(s, k):
            common = min(s[1], k[1]) - max(s[0], k[0])
            return common > 0 and common / max(1, min(s[1] - s[0], k[1] - k[0])) >= 0.8

        df = spark.createDataFrame([([(a, b, s, "v", False, None) for a, b, s in spans],)], f"s {sp.SPANS}")
        got = [(x["start"], x["end"]) for x in df.select(sp.merge_spans(F.col("s")).alias("m")).first()["m"]]
        assert got == _greedy(spans, clash)


def test_whole_slang_table(spark):
    """Forms that the everyday part of the table did not hold."""
    golden = [("dah kl jdi gua sya orng", "sudah kalau jadi saya saya orang"), ("engga blom mksh", "tidak belum terima kasih"), ("topmarkotop plis", "sangat bagus tolong")]
    df = spark.createDataFrame([(a, b, "id") for a, b in golden], "text string, want string, lang string")
    assert all(r["normalized_text"] == r["want"] for r in nz.normalize(df, "text", language="lang").collect())
    assert all(r["normalized_text"] == r["want"] for r in nz.normalize_profile(df, "text").collect())
    assert df.select(nz.token_language(F.lit("engga"), F.lit("en")).alias("l")).first()["l"] == "id"
    assert len(lx.ID_SLANG) == 473
