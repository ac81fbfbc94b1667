"""Findings of the fourth review: blank and missing texts as the twins of the queries count them, bounded disk."""

import math
import os
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reviewspark.llm import ngram_join
from reviewspark.llm.common import stored
from reviewspark.operators import partition_audit
from reviewspark.operators import similarity as si
from reviewspark.session import checkpoint_root

NBSP = "\u00a0"
#: Texts by doc_id; blank ones where the queries mark rows by their id, and where they do not.
ODD = {1: "", 2: None, 4: "   ", 6: "\n", 7: "\t", 9: "\tthis was good", 11: "", 12: NBSP + "this", 13: "\t \t", 17: "", 19: " ", 20: "", 21: "x" * 10_001, 22: "x" * 10_000 + NBSP,
       23: "", 27: None, 29: "", 31: "", 32: "  ", 37: "", 41: None, 58: "", 62: ""}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, ODD.get(i, f"this was good, from {i % 7} sich und that place {i % 5}"), "en", f"src{i % 4}", 10) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def both(spark, folder, name):
    """Rows of a query and of its twin, each sorted."""
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    got = entry.queries()[name](spark, folder).select(*columns).collect()
    return sorted(tuple(r) for r in got), sorted(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["flt_row_status", "flt_canonical_contract", "flt_schema_validator", "enr_batch", "str_arriving_files", "str_progress_table", "agg_dataset_audit"])
def test_blank_texts_as_in_sql(spark, odd, name):
    got, want = both(spark, odd, name)
    assert got == want


def test_near_keys_moves_texts_not_vectors(spark, monkeypatch):
    """Blocks are broadcast, likely pairs meet by family, and what was written on the way is given back."""
    words = [f"word{i:02d}" for i in range(60)]
    keys = []
    for family in range(6):
        base = [words[(family * 7 + 3 * k) % 60] for k in range(40)]
        keys += [(f"{family}-{c}", " ".join(base[:c] + ["other"] + base[c + 1:]), c % 3 != 0, c % 2 == 0, "ab"[family % 2]) for c in range(8)]
    df = spark.createDataFrame(keys, "key_id string, key string, in_train boolean, in_protected boolean, lang string")
    for name, value in (("FEW_TEXTS", 2), ("BLOCK_TEXTS", 5), ("VECTOR_TEXTS", 3)):
        monkeypatch.setattr(si, name, value)
    scratch = os.path.join(checkpoint_root(spark), "reviewspark-scratch")
    there = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    for by in (None, "lang"):
        got = {(r["left"], r["right"]): r["similarity"] for r in si.near_keys(df, 0.9, by=by).collect()}
        want = {}
        for group in ([keys] if by is None else [[k for k in keys if k[4] == v] for v in "ab"]):
            counts = [si._grams(k[1]) for k in group]
            df_of = Counter(g for c in counts for g in c)
            vectors = [{g: n * (math.log((1 + len(group)) / (1 + df_of[g])) + 1) for g, n in c.items()} for c in counts]
            norms = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
            for i, a in enumerate(group):
                for j, b in enumerate(group):
                    s = sum(x * vectors[j].get(g, 0) for g, x in vectors[i].items()) / norms[i] / norms[j]
                    if i != j and a[2] and b[3] and s >= 0.9:
                        want[a[0], b[0]] = s
        assert want and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert not [f for f in set(os.listdir(scratch)) - there if f.startswith(("likely", "heads"))]


def test_quarantine_rounds_give_their_keys_back(spark):
    scratch = os.path.join(checkpoint_root(spark), "reviewspark-scratch")
    there = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    rows = [(str(i), " ".join(f"w{(i // 2 * 7 + k) % 50}" for k in range(60)) + (" x" if i % 2 else ""), "train" if i % 2 else "test", "en") for i in range(12)]
    out = partition_audit.quarantine_near_copies(spark.createDataFrame(rows, "id string, text string, split string, language string"), 0.9)
    assert {r["id"] for r in out.collect()} == {str(i) for i in range(1, 12, 2)}
    assert not set(os.listdir(scratch)) - there


def test_folded_vectors_bound_from_above():
    rng = np.random.default_rng(3)
    grams = np.sort(rng.integers(-2**62, 2**62, 400))
    frequent = np.sort(rng.choice(grams, 100, replace=False))
    for _ in range(20):
        u, v = (rng.random(400) * (rng.random(400) < 0.5) for _ in range(2))
        u, v = u / np.sqrt(u @ u), v / np.sqrt(v @ v)
        a, b = (si.folded(grams, x, np.full(400, 9), frequent) for x in (u, v))
        assert a.dtype == np.float16
        a, b = a.astype(np.float64), b.astype(np.float64)
        coarse = a[:si.COARSE_PLACES] @ b[:si.COARSE_PLACES]
        fine = si._fine_dots(a[None], b[None], np.array([0]), np.array([0]))[0]
        assert coarse >= u @ v - 1e-12 and fine >= u @ v - 1e-6 and fine <= coarse + 1e-3


def test_stored_tables_leave_no_shuffle_files_behind(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}

    there = shuffles()
    out = stored(spark.range(100_000).groupBy(F.col("id") % 1000).count(), "test-shuffles")
    # a table's shuffles go with the next table at the latest
    stored(spark.range(3), "test-next")
    for _ in range(50):
        if not shuffles() - there:
            break
        time.sleep(0.2)
    assert not shuffles() - there and out.count() == 1000


def test_tied_signatures_are_all_that_several_sets_have(spark):
    rng = np.random.default_rng(5)
    sigs = rng.integers(-2**63, 2**63, 3000)
    rows = [(i, [int(s) for s in rng.choice(sigs, i % 40, replace=False)], int(rng.integers(0, i % 40 + 1))) for i in range(100)]
    df = spark.createDataFrame(rows, "uid long, sigs array<long>, rare int").repartition(5)
    got = {(r["sig"], r["node"], r["alone"]) for r in ngram_join.tied_signatures(df).collect()}
    nodes = Counter(s for _, x, _ in rows for s in x)
    every = {(s, uid, i < rare) for uid, x, rare in rows for i, s in enumerate(x)}
    assert got <= every and {t for t in every if nodes[t[0]] > 1} <= got and len(got) < len(every)
