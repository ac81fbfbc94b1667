"""Findings of the third review."""

from pyspark.sql import functions as F

from pyspark.sql import functions as F

import __spark_entry__ as entry
from reviewspark.functions.spans import starts_of
from reviewspark.operators import pairing
from reviewspark.operators.normalize import _fold

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def write_documents(spark, folder, texts, langs=("en", "de", "fr", "es")):
    rows = [(i, t, langs[i % len(langs)], f"src{i % 5}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_planted_offsets_leave_long_texts(spark, tmp_path):
    # an aspect at 0, whose end was moved by 100,000 characters only
    sf = write_documents(spark, tmp_path, ["This " + "filler " * 20_000])
    q = entry.queries()
    assert [r["problem"] for r in q["flt_offset_audit"](spark, sf).collect()] == ["bounds"]
    assert [r["outcome"] for r in q["flt_review_row_validation"](spark, sf).collect()] == ["invalid_aspect_offset"]
    issues = {r["issue"] for r in q["flt_schema_validator"](spark, sf).collect()}
    assert "invalid_aspect_offset" in issues and "aspect_term_offset_mismatch" not in issues


def test_costly_columns_are_not_worked_out_again_by_filters(spark, tmp_path):
    sf = write_documents(spark, tmp_path, ["This was good, from here with love.", "nothing", ""])
    for name in ("pr_candidates", "pr_top_opinions", "pr_decode", "pr_aspect_only", "spn_decode_bio", "flt_canonical_contract"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        filters = [line for line in plan.split("\n") if "Filter" in line.split("(")[0] or "FileScan" in line]
        assert filters and not any("regexp_extract_all" in line for line in filters), name


def test_starts_of_long_arrays(spark):
    for n in (0, 1, 31, 32, 33, 1024, 1025, 5000):
        lengths = [i % 7 for i in range(n)]
        got = spark.createDataFrame([(lengths,)], "v array<int>").select(starts_of(F.col("v")).alias("s")).first()["s"]
        assert got == [sum(lengths[:i]) for i in range(n)] if n < 2000 else got[-1] == sum(lengths[:-1])


def test_compatibility_view_keeps_raw_offsets():
    assert _fold(None) == (None, None) and _fold("\u00e9t\u00e9") == ("\u00e9t\u00e9", None)
    text, index = _fold("a\ufb01\u2026\U0001f600x")
    assert text == "afi...\U0001f600x" and list(index) == [0, 1, 1, 2, 2, 2, 3, 4]


def test_controlled_sample_returns_every_member(spark, tmp_path):
    sf = write_documents(spark, tmp_path, ["This is from here, with this and this. " * (i % 4) for i in range(60)])
    got = entry.queries()["smp_controlled_sample"](spark, sf).collect()
    assert len({r["example_id"] for r in got}) == len(got) > 0
    by_class = {r["sentiment"]: r["distinct_rows"] for r in got}
    assert by_class == {c: sum(r["sentiment"] == c for r in got) for c in by_class}


def test_crossed_pairs_equal_brute_force(spark):
    pos = [(1, 3, 4, 6), (1, 3, 8, 9), (10, 12, 4, 6), (20, 21, 30, 31)]
    df = spark.createDataFrame([(pos,), ([],)], "v array<struct<as:int,ae:int,os:int,oe:int>>")
    want = {(a[0], a[1], o[2], o[3]) for a in pos for o in pos} - set(pos)
    got = [[tuple(p) for p in r["c"]] for r in df.select(pairing._crossed(F.col("v")).alias("c")).collect()]
    assert sorted(map(len, got)) == [0, len(want)] and set(max(got, key=len)) == want
