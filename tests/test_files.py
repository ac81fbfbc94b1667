"""Folders of differing files: nothing is lost and no column is read under another's name."""

import pytest

from reviewspark.operators.dedup import connected_components
from reviewspark.sources.files import read_review_files


def test_mixed_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("review,city\nenak,Solo\n")
    (tmp_path / "b.csv").write_text("city,review\nBali,jelek\n")
    (tmp_path / "c.csv").write_bytes("review;city\ncafé;Paris\n".encode("cp1252"))
    rows = {(r["review"], r["original_fields"]["city"]) for r in read_review_files(spark, str(tmp_path / "*.csv")).collect()}
    assert rows == {("enak", "Solo"), ("jelek", "Bali"), ("café", "Paris")}


def test_large_file(spark, tmp_path):
    line = "x" * 1000
    (tmp_path / "big.csv").write_text("review,city\n" + "".join(f"{line}{i},Solo\n" for i in range(110_000)))
    (tmp_path / "small.csv").write_text("review,city\nenak,Solo\n")
    assert read_review_files(spark, str(tmp_path / "*.csv")).count() == 110_001


def test_unfinished_components_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(edges, max_rounds=1)
    assert connected_components(edges).select("root").distinct().count() == 1


def test_token_file_line_ends(spark, tmp_path):
    from reviewspark.sources.records import read_conll
    (tmp_path / "a.txt").write_bytes(b"good\tO\r\nfood\tB-ASP\r\n\r\nbad\tO\r\n \t\r\nlast\tO\r\n\r\n")
    (tmp_path / "b.txt").write_bytes(b"x\tO\n\ny\tO\nz\tI-ASP\n  \n\nend\tO")
    got = read_conll(spark, str(tmp_path)).collect()
    assert sorted((r["path"][-5:], r["sentence"], r["pos"], r["token"], r["tag"]) for r in got) == [
        ("a.txt", 1, 0, "good", "O"), ("a.txt", 1, 1, "food", "B-ASP"), ("a.txt", 2, 0, "bad", "O"), ("a.txt", 3, 0, "last", "O"),
        ("b.txt", 1, 0, "x", "O"), ("b.txt", 2, 0, "y", "O"), ("b.txt", 2, 1, "z", "I-ASP"), ("b.txt", 3, 0, "end", "O")]


def test_late_encodings(spark, tmp_path):
    """The first byte that tells the encoding may stand on any line: behind 200 short lines, behind 64 KiB, at the end."""
    from reviewspark.sources.files import sniff
    head, short = b"review,city\n", b"enak sekali,Solo\n" * 298
    (tmp_path / "line300.csv").write_bytes(head + short + b"caf\xe9 \x80,Paris\n" + short)
    (tmp_path / "after64k.csv").write_bytes(head + short * 20 + b"caf\xe9 \x80,Paris\n")
    (tmp_path / "latin.csv").write_bytes(head + short + b"caf\xe9,Paris\n" + short + b"\x81,Bali\n")
    (tmp_path / "utf.csv").write_bytes(head + short * 20 + "café €,Paris\n".encode())
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbf" + head + short + "café €,Paris\n".encode())
    (tmp_path / "overlong.csv").write_bytes(head + short + b"\xc0\xaf,Paris\n")
    path = str(tmp_path / "*.csv")
    assert {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in sniff(spark, path).collect()} == {
        "line300.csv": "cp1252", "after64k.csv": "cp1252", "latin.csv": "latin-1", "utf.csv": "utf-8", "bom.csv": "utf-8", "overlong.csv": "cp1252"}
    rows = read_review_files(spark, path)
    assert rows.count() == 1 + 298 * 2 + 298 * 20 + 1 + 298 * 2 + 2 + 298 * 20 + 1 + 298 + 1 + 298 + 1
    assert rows.where("review = 'café €'").count() == 4 and rows.where("contains(review, '\ufffd')").count() == 0


def test_wrapped_export_in_its_encoding(spark, tmp_path):
    """A wrapped export is read in the encoding that was found for it, whatever stands beside it."""
    line = '"{},""{}"",Paris";;;\n'
    (tmp_path / "cp.csv").write_bytes(('"id,""Isi Review"",kota";;;\n' + line.format(1, "café enak €") + line.format(2, "plain")).encode("cp1252"))
    (tmp_path / "latin.csv").write_bytes('"id,""Isi Review"",kota";;;\n'.encode() + b'"3,""caf\xe9 \x81"",Paris";;;\n')
    (tmp_path / "utf.csv").write_bytes(('"id,""Isi Review"",kota";;;\n' + line.format(4, "café €")).encode())
    rows = {r["customer_id"]: r["review"] for r in read_review_files(spark, str(tmp_path / "*.csv")).collect()}
    assert rows == {"1": "café enak €", "2": "plain", "3": "café \x81", "4": "café €"}


@pytest.fixture
def tiny_splits(spark):
    """Files are cut into splits of some dozen bytes, so that records and quotes cross many of them."""
    names = {"spark.sql.files.maxPartitionBytes": "37", "spark.sql.files.openCostInBytes": "1"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def test_line_breaks_in_quotes(spark, tmp_path, tiny_splits):
    """Every record, with its number, as one reader of the whole file gives them; a file of many splits is read by many tasks."""
    import csv
    import io
    import random

    from reviewspark.sources.files import read_csv_records, read_reviews_csv
    rng = random.Random(3)
    pieces = ["", "a", "enak\nsekali", 'say "x"', "a,b", "\r\n", '""', "é€", "x" * 90, '"\n"', ",\n,", "plain words", "5\" pipe"]
    for n, end in enumerate(("\n", "\r\n")):
        rows = [["review", "city", "note"]] + [["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 4))) or "r" for _ in range(3)] for _ in range(60)]
        text = io.StringIO()
        csv.writer(text, lineterminator=end).writerows(rows)
        body = text.getvalue().replace(f"{end}plain words,", f"{end}{end}plain words,")
        body += f'a 5" pipe,b "quoted" c,d{end}'  # quotes inside unquoted fields
        path = tmp_path / f"{n}.csv"
        path.write_bytes(body.encode())
        want = [r for r in csv.reader(io.StringIO(body, newline="")) if r]
        records = read_csv_records(spark, str(path)).orderBy("number").collect()
        assert [r["number"] for r in records] == list(range(1, len(want) + 1))
        assert [next(csv.reader(io.StringIO(bytes(r["record"]).decode(), newline=""))) for r in records] == want
        assert read_csv_records(spark, str(path)).rdd.getNumPartitions() > 20
        got = read_reviews_csv(spark, str(path)).orderBy("row_number").collect()
        assert [(r["row_number"], r["review"], r["original_fields"]["note"]) for r in got] == [(i, r[0], r[2]) for i, r in enumerate(want[1:], 2)]


def test_row_numbers_stay_in_place(spark, tmp_path, tiny_splits):
    """Numbers in file order over many splits, without an exchange of the rows."""
    from reviewspark.sources.files import number_rows
    for name, n in (("a", 300), ("b", 1), ("c", 57)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(1, n + 1)))
    numbered = number_rows(spark.read.text(str(tmp_path)))
    assert all(r["value"] == f"{r['_path'][-5]}{r['row_number']}" for r in numbered.collect()) and numbered.count() == 358
    plan = numbered._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(_path") == 2
