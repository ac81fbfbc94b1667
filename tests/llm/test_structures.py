"""Repeated passages, spelling variants and Merkle manifests against brute-force versions on hard cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from reviewspark.llm import merkle, repeats, spelling

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, rank long, tree string, word string, n long, a string, c string, digest string"
EXTRA = (7, "clash", "clash", 5, "clash", "clash", "clash")


def passage(rng, n):
    return "".join(rng.choice("abcdefghij ") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and very long texts, repeated rows, shared passages of 49 to 300 bytes, non-ASCII bytes, runs of one letter."""
    rng = random.Random(11)
    shared = [passage(rng, n) for n in (49, 50, 51, 60, 75, 100, 300)]
    texts = [None, "", "x", "a" * 49, "a" * 50, "a" * 400, "ab" * 200, "a" * 40_000]
    for _ in range(60):
        parts = [passage(rng, rng.randrange(0, 90))]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            lo = rng.randrange(0, 10)
            parts += [s[lo:len(s) - rng.randrange(0, 10)], passage(rng, rng.randrange(0, 60))]
        texts.append("".join(parts))
    texts += ["é" * 30 + shared[3] + "ß" * 20, "ü" + "é" * 29 + shared[3] + "ß" * 30, texts[20], texts[20], texts[21] + "!", passage(rng, 70_000) + shared[5]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    langs = [None, "en", "de", "ü", "z"]
    out = [(order[i], t, rng.choice([None, "s1", "é"]), langs[min(4, i % 7)], rng.choice([None, 0, 12, 2**63 - 1]), *EXTRA) for i, t in enumerate(texts)]
    return [*out, out[9], out[9], out[30], (None, texts[12], None, None, None, *EXTRA), (None, None, None, None, None, *EXTRA),
            (out[14][0], texts[15], "s1", "en", 3, *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_removed(rows):
    last = 2**63
    first = defaultdict(lambda: last)
    for r in rows:
        b = (r[1] or "").encode()
        for i in range(len(b) - 49):
            w = b[i:i + 50]
            first[w] = min(first[w], last if r[0] is None else r[0])
    out = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i:i + 50]] < (last if r[0] is None else r[0]):
                gone[i:i + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[r[0], len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("heavy, group", [(2, 2), (3, 4096), (64, 4096), (64, 1)])
def test_repeated_bytes(docs, rows, empty, heavy, group):
    """With nearly every class heavy, with every anchor split into strings, and as it is."""
    got = repeats.repeated_bytes(docs, heavy=heavy, group=group).collect()
    assert Counter(tuple(r) for r in got) == plain_removed(rows)
    if heavy == 2:
        assert repeats.repeated_bytes(empty).count() == 0


def test_every_string_holds_the_same_anchor():
    """Wherever a string of 50 bytes stands, it selects the same anchor; pieces of a long text select as the whole does."""
    rng = random.Random(1)
    text = passage(rng, 1000).encode() + b"a" * 200 + passage(rng, 3 * repeats.PIECE).encode()
    of, place, a, c = repeats.anchors([text])
    assert len(set(place.tolist())) == len(place) and 0.05 < len(place) / len(text) < 0.1
    at = dict(zip(place.tolist(), zip(a.tolist(), c.tolist())))
    for lo in [rng.randrange(len(text) - 50) for _ in range(300)]:
        _, alone, b, _ = repeats.anchors([text[lo:lo + 50]])
        assert len(alone) and all(at[lo + p][0] == x for p, x in zip(alone.tolist(), b.tolist()))
    assert [len(x) for x in repeats.anchors([b"", b"a" * 49])] == [0] * 4


def test_interval_tree():
    """Every set of suffixes with a common prefix is an interval, with all its members."""
    rng = random.Random(3)
    for _ in range(200):
        texts = sorted("".join(rng.choice("ab") for _ in range(8)) for _ in range(rng.randrange(1, 12)))
        common = [next((i for i in range(8) if x[i] != y[i]), 8) for x, y in zip(texts, texts[1:])]
        depth, parent, leaf = repeats.interval_tree(np.array(common, np.int64))
        got = defaultdict(set)
        for i, at in enumerate(leaf):
            while at:
                got[at].add(i)
                assert depth[parent[at]] < depth[at]
                at = parent[at]
        want = set()
        for i in range(len(texts)):
            for n in range(1, 9):
                members = frozenset(k for k, t in enumerate(texts) if t[:n] == texts[i][:n])
                if len(members) > 1:
                    want.add(members)
        assert {frozenset(m) for m in got.values()} == want and len(got) == len(want)


@pytest.mark.parametrize("group", [4096, 2])
def test_maximal_repeats(spark, group):
    """All occurrences, also of copies; one byte more on a side loses one of them. Split anchors give strings of 50 bytes."""
    rng = random.Random(8)
    base, other = passage(rng, 60), passage(rng, 55)
    texts = [f"{x}{s}{y}" for s in (base, other) for x, y in (("P", "Q"), ("R", "Q"), ("P", "S"))] + [base[2:58]] * 2 + ["Q" + base[5:] + "Q", passage(rng, 90)]
    got = repeats.maximal_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), group=group).collect()
    found = defaultdict(set)
    for r in got:
        found[bytes(r["repeat"]).decode()].add(r["rank"])
        assert r["length"] == len(r["repeat"]) >= 50
    for s, ids in found.items():
        assert {i for i, t in enumerate(texts) if s in t} == ids and len(ids) > 1
    if group == 2:
        assert {len(s) for s in found} >= {50}
        return
    for s in (base, other, base[2:58], "P" + base, base + "Q", "P" + other, other + "Q", base[5:], base[5:58]):
        assert s in found
    for s, ids in found.items():  # a repeat that ends before its context does is maximal in all texts
        if len(s) < 55:
            assert all({i for i in ids if x + s in texts[i]} != ids for x in set("".join(texts)))


def plain_words(rows):
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = re.sub("[A-Z]", lambda m: m.group(0).lower(), run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if plain_near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]]))
    return out


@pytest.fixture(scope="module")
def spelled(spark):
    rng = random.Random(5)
    stems = ["abababa", "straße", "ÀÉÎabcdefg", "aaaaaaa", "x" * 900, "Wonderful", "×÷abcdef", "question"]
    words = []
    for s in stems:
        words += [s] * 400
        for _ in range(25):
            i, c = rng.randrange(len(s) + 1), rng.choice("abeéÀz")
            v = rng.choice([s[:i] + c + s[i:], s[:i] + c + s[i + 1:], s[:i] + s[i + 1:]])
            words += [v] * rng.choice([2, 3, 30])
            words += [v[:3] + c + v[3:]] * 2
    words += ["".join(rng.choice("ab") for _ in range(rng.randrange(7, 10))) for _ in range(1500)]
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 40:(i + 1) * 40]), None, None, None, *EXTRA) for i in range(len(words) // 40 + 1)]
    rows += [(None, "Wonderful wonderful, WONDERFULL", None, None, None, *EXTRA), (3, None, None, None, None, *EXTRA), rows[0], (4, "", None, None, None, *EXTRA)]
    return rows


@pytest.mark.parametrize("symbols, bucket", [(spelling.SYMBOLS, spelling.BUCKET), ((2, 5, None), 2), ((1, None), 3)])
def test_spelling_variants(spark, spelled, empty, symbols, bucket):
    """As it is, and with so few symbols that words go on to the next alphabet."""
    docs = spark.createDataFrame(spelled, SCHEMA).repartition(3)
    got = spelling.spelling_variants(docs, symbols, bucket).collect()
    want = plain_variants(plain_words(spelled))
    assert len(got) == len(want) and {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    assert any(r[1] is not None and r[2] != r[1] for r in want)
    if bucket == 3:
        assert spelling.spelling_variants(empty).count() == 0


def test_neighbourhoods():
    """Every word one edit away is made exactly once, whatever its length."""
    symbols = np.array([1, 2, 3])
    for word in ([1], [1, 1, 1], [1, 2, 2, 3], [3, 3, 1, 1, 2, 2, 2]):
        codes = np.array([word], np.int64)
        got = np.concatenate([x for _, x in spelling.neighbourhood(codes, symbols)])
        edits = {tuple(word[:i] + word[i + 1:]) for i in range(len(word))}
        edits |= {tuple(word[:i] + [s] + word[i + 1:]) for i in range(len(word)) for s in (1, 2, 3)}
        edits |= {tuple(word[:i] + [s] + word[i:]) for i in range(len(word) + 1) for s in (1, 2, 3)}
        edits.discard(tuple(word))
        want = [spelling.ids_of(np.array([e], np.int64).reshape(1, len(e)))[0] for e in edits]
        assert sorted(got.tolist()) == sorted(want) and len(set(want)) == len(want)
    long = np.random.default_rng(0).integers(1, 4, (1, 300_000))
    whole = spelling.ids_of(np.delete(long, 250_000, axis=1))[0]
    assert any(whole in x for _, x in spelling.neighbourhood(long, symbols))


def plain_tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        run = [levels[-1][i:i + arity] for i in range(0, len(levels[-1]), arity)]
        levels.append([hashlib.sha256("".join(r).encode()).hexdigest() for r in run])
    return levels


def plain_path(levels, i, arity):
    out = []
    for level in levels[:-1]:
        lo = i // arity * arity
        out.append(("".join(level[lo:i]), "".join(level[i + 1:lo + arity])))
        i //= arity
    return out


def plain_manifest(rows, arity):
    def leaf(r, more=0):
        chars = None if r[4] is None else r[4] + more
        return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[2], r[3], chars, r[1])).encode()).hexdigest()
    trees = defaultdict(list)
    for r in rows:
        other = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
        trees[(r[3] is not None, (r[3] or "").encode())].append((-1 if r[0] is None else r[0], leaf(r), other, r[0]))
    names = sorted(trees)
    made = {n: plain_tree([x[1] for x in sorted(trees[n])], arity) for n in names}
    top = plain_tree([made[n][-1][0] for n in names], arity)
    out = Counter()
    for t, n in enumerate(names):
        for i, (_, own, other, doc) in enumerate(sorted(trees[n])):
            path = plain_path(made[n], i, arity) + plain_path(top, t, arity)
            folded = other
            for left, right in path:
                folded = hashlib.sha256((left + folded + right).encode()).hexdigest()
            proof = hashlib.sha256("".join(s for p in path for s in p).encode()).hexdigest()
            out[doc, own, made[n][-1][0], top[-1][0], proof, folded, folded == top[-1][0]] += 1
    return out


def test_merkle_manifest(docs, rows, empty):
    got = merkle.document_manifest(docs).collect()
    want = plain_manifest(rows, 2)
    assert Counter(tuple(r) for r in got) == want
    assert 0 < sum(not r["verified"] for r in got) < len(rows)
    assert merkle.document_manifest(empty).count() == 0


@pytest.mark.parametrize("arity, height, trees", [(2, 1, 3), (3, 2, 1), (2, 3, 40), (5, 1, 2)])
def test_trees_of_many_rounds(spark, arity, height, trees):
    """Blocks of a few nodes, so that both sweeps take several rounds, also over the roots of the trees."""
    leaves = [(f"{t:03}" if t else None, i, hashlib.sha256(f"{t} {i}".encode()).hexdigest()) for t in range(trees) for i in range(1 + 97 // (t + 1))]
    df = spark.createDataFrame([(*x, x[2], 0) for x in leaves], "lang string, doc_id long, digest string, start string, tree int")
    got = {(r["lang"], r["doc_id"]): r for r in merkle.manifest(df, "lang", ["doc_id"], ["lang", "doc_id", "digest"], arity, height).collect()}
    made = {t: plain_tree([d for name, _, d in leaves if name == t], arity) for t in dict.fromkeys(x[0] for x in leaves)}
    top = plain_tree([x[-1][0] for x in made.values()], arity)
    assert len(got) == len(leaves)
    for t, (name, levels) in enumerate(made.items()):
        for i in range(len(levels[0])):
            path = plain_path(levels, i, arity) + plain_path(top, t, arity)
            r = got[name, i]
            assert r["proof_sha256"] == hashlib.sha256("".join(s for p in path for s in p).encode()).hexdigest()
            assert r["folded_root"] == r["root"] == top[-1][0] and r["subroot"] == levels[-1][0]
