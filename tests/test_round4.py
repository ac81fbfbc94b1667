"""Open findings of the third review, taken up again."""

import re
import unicodedata

from pyspark.sql import functions as F

from reviewspark import lexicons as lx
from reviewspark.functions import text as tx
from reviewspark.operators import enrich as en
from reviewspark.streaming import arrivals


def test_keys_of_western_texts_need_no_python(spark, monkeypatch):
    texts = ["Café ÉTÉ Straße ÜBER mañana ¿qué? – “gut” 5 €", "plain", "", None]
    for name in ("_nfkc", "_nfkc_casefold", "_casefold"):
        monkeypatch.setattr(tx, name, lambda c: F.when(c.isNotNull(), F.raise_error(F.lit("went to Python"))).cast("string"))
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = df.select("t", tx.nfkc(t), tx.nfkc_casefold(t), tx.casefold(t)).collect()
    assert [tuple(r)[1:] for r in got] == [(x and unicodedata.normalize("NFKC", x), x and unicodedata.normalize("NFKC", x).casefold(), x and x.casefold()) if x else (x,) * 3 for x in texts]


def test_keys_of_other_texts_are_normalised(spark):
    texts = ["été", "ﬁnµª", "ẞoß", "İstanbul", "² ½ x", "\U0001f600 naïve Ａ"]
    t = F.col("t")
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(tx.nfkc(t), tx.nfkc_casefold(t), tx.casefold(t)).collect()
    assert [tuple(r) for r in got] == [(unicodedata.normalize("NFKC", x), unicodedata.normalize("NFKC", x).casefold(), x.casefold()) for x in texts]


def test_location_hits_have_the_right_offsets(spark):
    t = "The café in Sich  Land, sich and ünder-sich; DANS\nles SICH"
    regions = [("1", "Kota Sich", "city", "P1", ["sich"]), ("2", "Sich Land", "city", "P2", ["sich land", "dans les sich"])]
    g = en.Gazetteer(*lx.region_dims(spark, [("1", "P1", [])], regions))
    got = spark.createDataFrame([(t,), ("",)], "t string").select(en.location_hits(F.col("t"), g, not_places=[]).alias("h")).collect()
    want = ["Sich  Land", "sich", "sich", "DANS\nles SICH"]
    assert [h["raw"] for h in got[0]["h"]] == want and got[1]["h"] == []
    assert all(t[h["start"]:h["end"]] == h["raw"] for h in got[0]["h"])
    assert [sorted(r["code"] for r in h["regions"]) for h in got[0]["h"]] == [["2"], ["1"], ["1"], ["2"]]


def test_location_hits_give_offsets_to_alias_words_only(spark):
    g = en.Gazetteer(*lx.region_dims(spark, [("1", "P1", [])], [("1", "Kota Sich", "city", "P1", ["sich"])]))
    plan = spark.createDataFrame([("a",)], "t string").select(en.location_hits(F.col("t"), g, not_places=[]).alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert r"(?U)[\w]+" not in plan and plan.count("lower(t") <= 1


def test_pattern_of_any_words():
    words = ["a", "ab", "abc", "b.c", "bd"]
    assert [w for w in [*words, "bxc", "abcd", ""] if re.fullmatch(en.any_of(words), w)] == words
    assert not re.search(en.any_of([]), "a")


def test_rows_of_one_file_are_scored_by_all_cores(spark, tmp_path):
    spark.createDataFrame([(f"sich {i}", str(i)) for i in range(200)], "review string, id string").coalesce(1).write.option("header", True).csv(f"{tmp_path}/in")
    g = en.Gazetteer(*lx.region_dims(spark, [("1", "P1", [])], [("1", "Kota Sich", "city", "P1", ["sich"])]))
    rows = arrivals.arriving_reviews(spark, f"{tmp_path}/in", "review string, id string")
    arrivals.score_arrivals(rows, g, f"{tmp_path}/out", f"{tmp_path}/check", fuzzy=False).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 200 and out.select(F.input_file_name()).distinct().count() == spark.sparkContext.defaultParallelism


def test_near_keys_of_frequent_grams_in_blocks(spark, monkeypatch):
    """Texts that share only frequent grams, few known weights and small blocks: the pairs of the plain comparison."""
    import math
    import random
    from collections import Counter

    from reviewspark.operators import similarity as si
    rng = random.Random(3)
    words = ["kopi", "enak", "lama", "harga", "mahal", "tempat", "nyaman", "parkir", "sempit", "ramah", "é\U0001F600", "a"]
    base = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(60)]
    texts = sorted(set(base + [b.replace("kopi", "kopik", 1) for b in base[:30]] + [b.replace("enak", "lama", 1) for b in base[20:50]]))
    for t in texts:
        plain = si._grams(t)
        hashes, counts = si.gram_hashes(t)
        assert len(hashes) == len(plain) and sorted(counts.tolist()) == sorted(plain.values())
    for name, value in (("KNOWN_GRAMS", 20), ("BLOCK_TEXTS", 7), ("VECTOR_TEXTS", 5)):
        monkeypatch.setattr(si, name, value)
    df = spark.createDataFrame([(f"k{i:03d}", t, i % 3 > 0, i % 3 < 2) for i, t in enumerate(texts)], "key_id string, key string, in_train boolean, in_protected boolean")
    got = {(r["left"], r["right"]): r["similarity"] for r in si.near_keys(df, 0.97).collect()}
    grams = [si._grams(t) for t in texts]
    n = Counter(g for c in grams for g in c)
    vectors = [{g: k * (math.log((1 + len(texts)) / (1 + n[g])) + 1) for g, k in c.items()} for c in grams]
    norms = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    want = {}
    for i, v in enumerate(vectors):
        for j, u in enumerate(vectors):
            s = sum(x * u.get(g, 0.0) for g, x in v.items()) / norms[i] / norms[j]
            if i != j and i % 3 > 0 and j % 3 < 2 and s >= 0.97:
                want[f"k{i:03d}", f"k{j:03d}"] = s
    assert set(got) == set(want) and len(want) > 10
    assert all(abs(got[p] - s) < 1e-9 for p, s in want.items())


def test_relation_head_reads_its_pairs_again_from_a_table(spark, monkeypatch):
    """Fitting passes over its rows many times; none of them finds spans and pairs again."""
    import __spark_entry__ as entry
    from reviewspark.bindings import learned
    plans = []

    def seen(train, tune):
        plans.extend(df._jdf.queryExecution().optimizedPlan().toString() for df in (train, tune))
        return None, 0.5, "seen"
    monkeypatch.setattr(learned.ml, "fit_relation", seen)
    row = entry.queries()["ml_relation_head"](spark, "/root/testdata/sf0.001").first()
    assert row["status"] == "seen" and len(plans) == 2
    assert not any("Generate" in p or "Relation [" in p or "parquet" in p for p in plans)
