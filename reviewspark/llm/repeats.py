"""Repeated passages: the common-prefix interval tree of an enhanced suffix array.

Any two equal strings of ``LEAST`` bytes hold the same anchor at the same place: the 24-byte string of the
smallest hash among those in it. The bytes around an anchor that such a string can cover are its context.
Suffixes are dealt by the anchor they hold, so that all occurrences of a passage meet and nothing else does:
equal contexts are a class and stand for all their members, and the classes of one anchor are sorted as an
enhanced suffix array (suffixes of their contexts, with the common prefix of neighbours). A stack scan turns
the common prefixes into the tree of their intervals; an interval whose occurrences are preceded by different
bytes is a maximal repeat. ``maximal_repeats`` lists all occurrences of all of them, ``repeated_bytes`` takes
from the same tree, for every occurrence, the longest repeat that an earlier document also holds.

Bounds: a task holds the packed anchors of one block of hashes, or some thousand contexts. Anchors that many
documents of one task share are sent once per task, not once per document ("heavy" classes, looked up by the
documents themselves from a list of bounded size). Anchors with more than ``GROUP`` different contexts are split into
their strings of ``LEAST`` bytes, which an aggregate and a join settle. Contexts are told apart by 64 bits of
hash beside those of their anchor.

Defined results: null is the empty text; a null id comes after every other; rows of one id do not count
against each other, so repeated rows keep what they share only with one another; ties need no order; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.llm.common import SMALL_KEYS, mapped, stored
from reviewspark.scale import lookup_by_key, small

LEAST = 50
ANCHOR = 24
#: Anchors in a string of ``LEAST`` bytes, and the bytes of a context before and from its anchor.
REACH = LEAST - ANCHOR
#: Bytes of text hashed at once (arrays that stay in the cache), of the margin around a piece, and of texts taken from a batch at once.
PIECE, MARGIN, GATHER = 1 << 15, 80, 1 << 22
#: Anchors that a task collects before it sends them on; a block of hashes holds about ``BLOCK`` of them.
FLUSH, BLOCK = 2_000_000, 400_000
#: A class of at least so many documents of one flush is sent without their list.
HEAVY = 64
#: Contexts of one anchor that are sorted in one task.
GROUP = 4096
CHUNK = 2000
LAST = 2**63 - 1

_RNG = np.random.default_rng(50)
#: A random number per byte, and one for the margin, which no text holds.
BYTES = _RNG.integers(1, 2**63, 257, dtype=np.uint64)
ODD = [np.uint64(x) for x in _RNG.integers(1, 2**62, 8, dtype=np.uint64) * 2 + 1]


def _joined(x: np.ndarray, y: np.ndarray, odd: np.uint64) -> np.ndarray:
    out = y * odd
    out += x
    out ^= out >> np.uint64(29)
    out *= odd
    out ^= out >> np.uint64(32)
    return out


def _slide(x: np.ndarray, width: int, fn) -> np.ndarray:
    """``fn`` over every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x, have = fn(x[:-have], x[have:]), have * 2
    rest = width - have
    return fn(x[:len(x) - rest], x[rest:]) if rest else x


def _scan(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, anchors, contexts) in a buffer of byte codes; 256 is the margin."""
    h1 = BYTES[codes]
    h2 = _joined(h1[:-1], h1[1:], ODD[0])
    h4 = _joined(h2[:-2], h2[2:], ODD[1])
    h8 = _joined(h4[:-4], h4[4:], ODD[2])
    h16 = _joined(h8[:-8], h8[8:], ODD[3])
    h = _joined(h16[:-8], h8[16:], ODD[4])  # 24 bytes
    low = _slide(h, REACH + 1, np.minimum)
    outside = np.cumsum(codes == 256, dtype=np.int32)
    outside = np.r_[np.int32(0), outside]
    low[(outside[LEAST:] - outside[:-LEAST])[:len(low)] > 0] = 0
    best = _slide(low, REACH + 1, np.maximum)
    at = np.flatnonzero((best == h[REACH:REACH + len(best)]) & (best > 0)) + REACH
    c = h16[at - REACH]
    for i, to in enumerate((-10, 6, 22, 34)):
        c = _joined(c, h16[at + to], ODD[i])
    return at, h[at], c


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, anchor, context) of all anchors of whole texts; long texts go piece by piece."""
    found, held, size = [], [], 0

    def done():
        codes = np.full(sum(len(b) for _, _, b, _, _ in held) + 2 * MARGIN * len(held), 256, np.uint16)
        starts, at = [], 0
        for _, _, body, left, right in held:
            starts.append(at + MARGIN)
            codes[at + MARGIN - len(left):at + MARGIN + len(body) + len(right)] = np.frombuffer(left + body + right, np.uint8)
            at += len(body) + 2 * MARGIN
        place, a, c = _scan(codes)
        piece = np.searchsorted(np.array(starts), place, side="right") - 1
        inside = piece >= 0
        starts_, lengths = np.array(starts), np.array([len(b) for _, _, b, _, _ in held])
        inside &= place < (starts_ + lengths)[piece]
        piece, place = piece[inside], place[inside]
        of, first = np.array([x[0] for x in held]), np.array([x[1] for x in held])
        found.append((of[piece], place - starts_[piece] + first[piece], a[inside], c[inside]))

    for i, t in enumerate(texts):
        if len(t) < LEAST:
            continue
        for lo in range(0, len(t), PIECE):
            held.append((i, lo, t[lo:lo + PIECE], t[max(0, lo - MARGIN):lo], t[lo + PIECE:lo + PIECE + MARGIN]))
            size += len(held[-1][2])
            if size >= PIECE:
                done()
                held, size = [], 0
    if held:
        done()
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _bytes(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _groups(texts: list[bytes]) -> Iterator[list[int]]:
    """Places of texts, a few megabytes at a time."""
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(i)
        size += len(t)
        if size >= GATHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _starts(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def packed_anchors(rows: DataFrame, bits: int, heavy: int = HEAVY) -> DataFrame:
    """Anchors by block (leading bits), packed: anchor, context, document; heavy classes once with their first document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            a, c, d = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(c)
            first = _starts(c[order])
            sizes = np.diff(np.r_[first, len(c)])
            much = sizes >= heavy
            lead = order[first[much]]
            low = np.minimum.reduceat(d[order], first)[much] if len(first) else d[:0]
            light = order[np.repeat(~much, sizes)]
            parts = []
            for x, y, z in ((a[light], c[light], d[light]), (a[lead], c[lead], low)):
                block = (x >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
                by = np.argsort(block, kind="stable")
                cut = np.searchsorted(block[by], np.arange(1, 1 << bits))
                short = ((x[by] << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                parts.append([np.split(v, cut) for v in (short, y[by], z[by])])
            out: list[list] = [[] for _ in range(8)]
            for i in range(1 << bits):
                x, y, z = (v[i] for v in parts[0])
                hx, hy, hz = (v[i] for v in parts[1])
                if not len(x) and not len(hx):
                    continue
                base = int(z.min()) if len(z) else 0
                # documents by their distance from the first where that takes four bytes
                narrow = not len(z) or int(z.max()) - base < 2**32
                values = (z - base).astype(np.uint32) if narrow else z
                for column, v in zip(out, (i, x.tobytes(), y.tobytes(), values.tobytes(), base if narrow else None, hx.tobytes(), hy.tobytes(), hz.tobytes())):
                    column.append(v)
            types = [pa.int32(), *[pa.binary()] * 3, pa.int64(), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], ["block", "a", "c", "d", "base", "ha", "hc", "hd"])

        for b in batches:
            texts, rank = _bytes(b.column("text")), b.column("rank").to_numpy(zero_copy_only=False)
            for some in _groups(texts):
                of, _, a, c = anchors([texts[i] for i in some])
                held.append((a, c, rank[np.array(some)][of]))
                n += len(a)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return mapped(rows.select("rank", "text"), run, "block int, a binary, c binary, d binary, base long, ha binary, hc binary, hd binary")


def judged(packed: DataFrame, with_shared: bool = False) -> DataFrame:
    """What a block knows of its classes.

    kind 0: document ``d`` holds the contexts ``cs``, which an earlier document also holds; kind 1: class ``c`` of
    anchor ``a``, first in document ``d``, has to be compared with other classes of its anchor, or is ``shared`` by
    several documents and asked for as such; kind 2: heavy class ``c`` is first in document ``d``.
    """
    def run(key: tuple, table: pa.Table) -> pa.Table:
        take = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
        bases = table.column("base").to_pylist()
        d = [np.frombuffer(x, np.uint32).astype(np.int64) + b if b is not None else np.frombuffer(x, np.int64)
             for x, b in zip(table.column("d").to_pylist(), bases)]
        ha, hc, hd = (np.concatenate(take(n, k)) for n, k in (("ha", np.uint32), ("hc", np.uint64), ("hd", np.int64)))
        a, c, d = np.concatenate([*take("a", np.uint32), ha]), np.concatenate([*take("c", np.uint64), hc]), np.concatenate([*d, hd])
        much = np.zeros(len(a), bool)
        much[len(a) - len(ha):] = True
        order = np.lexsort((d, c, a))
        a, c, d, much = a[order], c[order], d[order], much[order]
        first = _starts(a, c)
        sizes = np.diff(np.r_[first, len(a)])
        low, of_heavy = d[first], np.logical_or.reduceat(much, first) if len(first) else much
        # every member of a class that is not in its first document
        later = (d > np.repeat(low, sizes)) & ~much
        by = np.lexsort((c[later], d[later]))
        ld, lc = d[later][by], c[later][by]
        cut = _starts(ld)
        lists = [x.tobytes() for x in np.split(lc, cut[1:])] if len(ld) else []
        # classes that share an anchor with a class of another first document
        top = _starts(a[first])
        n = np.diff(np.r_[top, len(first)])
        if len(top):
            wanted = np.repeat((n > 1) & (np.minimum.reduceat(low, top) < np.maximum.reduceat(low, top)), n)
        else:
            wanted = np.zeros(0, bool)
        shared = (np.maximum.reduceat(d, first) > low) | of_heavy if len(first) else wanted
        if with_shared:
            wanted = wanted | shared
        number = (np.int64(key[0].as_py()) << 32) | a[first].astype(np.int64)
        kinds = np.repeat(np.array([0, 1, 2], np.int8), [len(lists), wanted.sum(), of_heavy.sum()])
        none = np.zeros(len(lists), np.int64)
        return pa.table({
            "kind": pa.array(kinds), "d": pa.array(np.concatenate([ld[cut] if len(ld) else ld, low[wanted], low[of_heavy]])),
            "a": pa.array(np.concatenate([none, number[wanted], number[of_heavy]])),
            "c": pa.array(np.concatenate([none, c[first][wanted].astype(np.int64), c[first][of_heavy].astype(np.int64)])),
            "cs": pa.array([*lists, *[None] * int(wanted.sum() + of_heavy.sum())], pa.binary()),
            "shared": pa.array(np.concatenate([np.zeros(len(lists), bool), shared[wanted], of_heavy[of_heavy]]))})

    return packed.groupBy("block").applyInArrow(run, "kind byte, d long, a long, c long, cs binary, shared boolean")


def contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, c, d, o, context, shared): the bytes of the wanted classes, from their first documents; the anchor starts at ``o``."""
    lists = wanted.groupBy(F.col("d").alias("rank")).agg(F.collect_list(F.struct("a", "c", "shared")).alias("wanted"))
    held = rows.join(small(wanted.select(F.col("d").alias("rank")).distinct(), SMALL_KEYS), "rank", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _bytes(b.column("text"))
            for some in _groups(texts):
                of, place, _, c = anchors([texts[i] for i in some])
                out: list[list] = [[] for _ in range(6)]
                cuts = np.searchsorted(of, np.arange(len(some) + 1))
                for k, i in enumerate(some):
                    lists = b.column("wanted")[i].values
                    names, of_a, shared = (lists.field(f).to_numpy(zero_copy_only=False) for f in ("c", "a", "shared"))
                    mine, first = np.unique(c[cuts[k]:cuts[k + 1]].view(np.int64), return_index=True)
                    hit, x, y = np.intersect1d(mine, names, return_indices=True)
                    where = place[cuts[k]:cuts[k + 1]][first[x]]
                    for v, g, p, n in zip(hit.tolist(), of_a[y].tolist(), where.tolist(), shared[y].tolist()):
                        lo = max(0, p - REACH)
                        for column, value in zip(out, (g, v, b.column("rank")[i].as_py(), p - lo, texts[i][lo:p + LEAST], n)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (
                    pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()))], ["a", "c", "d", "o", "context", "shared"])

    made = mapped(held.join(lists, "rank").select("rank", "text", "wanted"), run, "a long, c long, d long, o int, context binary, shared boolean")
    return made.dropDuplicates(["a", "c"])


def interval_tree(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common prefix, parent) of every interval, and the deepest interval of every suffix; 0 is the root.

    ``lcp[i]`` is the common prefix of suffixes i and i + 1, 0 where it does not count.
    """
    depth, parent, leaf = [0], [0], np.zeros(len(lcp) + 1, np.int64)
    stack = [0]
    for i, n in enumerate([*lcp.tolist(), 0]):
        if n > depth[stack[-1]]:
            depth.append(n)
            parent.append(stack[-1])
            stack.append(len(depth) - 1)
            leaf[i] = stack[-1]
            continue
        leaf[i] = stack[-1]
        while depth[stack[-1]] > n:
            closed = stack.pop()
            if depth[stack[-1]] < n:
                depth.append(n)
                parent.append(stack[-1])
                stack.append(len(depth) - 1)
            parent[closed] = stack[-1]
    return np.array(depth), np.array(parent), leaf


def enhanced_suffixes(group: np.ndarray, texts: list[bytes], offsets: np.ndarray, docs: np.ndarray):
    """Interval tree of the contexts of some anchors: (suffix's context, its start, tree, first document and diversity by interval).

    None where no string of ``LEAST`` bytes repeats.
    """
    width = REACH + LEAST
    sizes = np.array([len(t) for t in texts])
    table = np.zeros((len(texts), width + REACH + 1), np.uint8)
    filled = np.arange(width)[None, :] < sizes[:, None]
    table[:, :width][filled] = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.arange(REACH + 1)
    owner, start = np.nonzero((starts[None, :] <= offsets[:, None]) & (sizes[:, None] - starts[None, :] >= LEAST))
    # the group leads, so that suffixes of different anchors never share a prefix
    rows = np.empty((len(owner), 4 + width), np.uint8)
    rows[:, :4] = group.astype(">u4").view(np.uint8).reshape(-1, 4)[owner]
    rows[:, 4:] = table[owner[:, None], start[:, None] + np.arange(width)[None, :]]
    order = np.argsort(rows.view(f"S{4 + width}").ravel(), kind="stable")
    rows, owner, start = rows[order], owner[order], start[order]
    same = rows[1:] == rows[:-1]
    lcp = np.where(same.all(axis=1), 4 + width, same.argmin(axis=1)) - 4
    length = sizes[owner] - start
    lcp = np.minimum(lcp, np.minimum(length[1:], length[:-1]))
    lcp[lcp < LEAST] = 0
    if not lcp.any():
        return None
    keep = np.r_[lcp > 0, False] | np.r_[False, lcp > 0]
    owner, start = owner[keep], start[keep]
    # a suffix dropped between two kept ones shared no prefix with either
    lcp = lcp[keep[:-1] & keep[1:]] if keep.all() else _kept_prefixes(lcp, keep)
    depth, parent, leaf = interval_tree(lcp)
    low = np.full(len(depth), LAST)
    np.minimum.at(low, leaf, docs[owner])
    known = start > np.maximum(0, offsets[owner] - REACH)
    before = table[owner, np.maximum(start - 1, 0)].astype(np.int64)
    least, most = np.full(len(depth), 256), np.full(len(depth), -1)
    np.minimum.at(least, leaf, np.where(known, before, -1))
    np.maximum.at(most, leaf, np.where(known, before, 256))
    for n in range(int(depth.max()), 0, -1):
        at = np.flatnonzero(depth == n)
        np.minimum.at(low, parent[at], low[at])
        np.minimum.at(least, parent[at], least[at])
        np.maximum.at(most, parent[at], most[at])
    return owner, start, depth, parent, leaf, low, least != most


def _kept_prefixes(lcp: np.ndarray, keep: np.ndarray) -> np.ndarray:
    places = np.flatnonzero(keep)
    return np.where(np.diff(places) == 1, lcp[places[:-1]], 0)


def _of_groups(found: DataFrame, process, schema: str, names: list[str]) -> DataFrame:
    """``process`` over whole anchors, some thousand contexts at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows):
            _, group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
            made = process(rows, group)
            return pa.RecordBatch.from_arrays(made, names) if made is not None else None

        for b in batches:
            held.extend(zip(*[b.column(n).to_pylist() for n in ("a", "c", "d", "o", "context", "shared")]))
            if len(held) >= CHUNK:
                last = held[-1][0]
                end = len(held)
                while end and held[end - 1][0] == last:
                    end -= 1
                cut = 0
                while end - cut > 0:
                    stop = min(end, cut + CHUNK)
                    while stop < end and held[stop][0] == held[stop - 1][0]:
                        stop += 1
                    out = done(held[cut:stop])
                    if out is not None:
                        yield out
                    cut = stop
                held = held[end:]
        if held:
            out = done(held)
            if out is not None:
                yield out

    dealt = found.select("a", "c", "d", "o", "context", "shared").repartition("a").sortWithinPartitions("a", "c")
    return mapped(dealt, run, schema)


def earlier_repeats(found: DataFrame) -> DataFrame:
    """(d, c, lo, hi): around the anchor of class c, the bytes of document d that an earlier document repeats."""
    def process(rows, group):
        c, docs, offsets = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        tree = enhanced_suffixes(group, [r[4] for r in rows], offsets, docs)
        if tree is None:
            return None
        owner, start, depth, parent, leaf, low, diverse = tree
        at = leaf.copy()
        while True:  # up to the deepest interval that an earlier document is in
            up = (at > 0) & (low[at] >= docs[owner])
            if not up.any():
                break
            at[up] = parent[at[up]]
        hit = (at > 0) & diverse[at]
        owner, lo = owner[hit], (start - offsets[owner])[hit]
        return [pa.array(docs[owner]), pa.array(c[owner]), pa.array(lo.astype(np.int32)), pa.array((lo + depth[at[hit]]).astype(np.int32))]

    return _of_groups(found, process, "d long, c long, lo int, hi int", ["d", "c", "lo", "hi"])


def _strings(found: DataFrame) -> DataFrame:
    """Every string of ``LEAST`` bytes of the contexts, with its start counted from the anchor."""
    size = F.octet_length("context")
    starts = F.sequence(F.lit(0), F.least(F.col("o"), size - LEAST))
    each = found.where(size >= LEAST).select("a", "c", "d", "o", "shared", "context", F.explode(starts).alias("x"))
    return each.select("a", "c", "d", "shared", (F.col("x") - F.col("o")).alias("lo"), F.substring("context", F.col("x") + 1, F.lit(LEAST)).alias("string"))


def split_groups(found: DataFrame) -> DataFrame:
    """As ``earlier_repeats`` for anchors with very many contexts, string by string."""
    each = _strings(found)
    first = each.groupBy("string").agg(F.min("d").alias("low"), F.count(F.lit(1)).alias("n"))
    met = lookup_by_key(each, first, "string", "n", "inner").where("d > low")
    return met.select("d", "c", "lo", (F.col("lo") + LEAST).alias("hi"))


def _ranked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(LAST)).alias("rank"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def _classes(rows: DataFrame, heavy: int, with_shared: bool = False) -> DataFrame:
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, int(np.ceil(np.log2(max(1, total * 2 / (REACH + 2) / BLOCK)))))
    while True:
        made = stored(judged(packed_anchors(rows, bits, heavy), with_shared), "repeats-classes")
        # the list of heavy classes is broadcast; where there are too many, only heavier ones are
        if made.where("kind = 2").limit(SMALL_KEYS + 1).count() <= SMALL_KEYS:
            return made
        heavy *= 8


def _compared(rows: DataFrame, classes: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """Contexts of anchors with up to ``group`` classes, and of the others."""
    wanted = classes.where("kind = 1").select("a", "c", "d", "shared")
    found = stored(contexts(rows, wanted), "repeats-contexts")
    many = small(found.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("a"))
    return found.join(many, "a", "left_anti"), found.join(many, "a", "left_semi")


def class_members(classes: DataFrame) -> DataFrame:
    """(c, d): the documents of every class, the first one too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.frombuffer(x, np.int64) for x in b.column("cs").to_pylist()]
            d = b.column("d").to_numpy(zero_copy_only=False)
            if lists:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(np.repeat(d, [len(x) for x in lists]))], ["c", "d"])

    later = mapped(classes.where("kind = 0").select("d", "cs"), run, "c long, d long")
    return classes.where("kind = 1").select("c", "d").union(later).distinct()


def maximal_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """All occurrences of every maximal repeat around an anchor: a, repeat, length, c, lo, rank.

    A longer string loses an occurrence. ``c`` is the class of contexts that the occurrence is in, ``lo`` where the
    repeat starts, counted from the anchor, ``rank`` the document (its id, the largest number for null). Of
    anchors with more than ``group`` classes the repeats are the strings of ``LEAST`` bytes.
    """
    rows = _ranked(docs, doc_id, text)
    # no class is heavy here: all members are listed
    classes = _classes(rows, LAST, with_shared=True)
    few, many = _compared(rows, classes, group)

    def process(rows, numbers):
        # a class of several documents stands twice, so that what its members share is an interval
        twice = [k for k, r in enumerate(rows) for _ in range(1 + r[5])]
        rows, numbers = [rows[k] for k in twice], numbers[twice]
        texts = [r[4] for r in rows]
        a, c, d, o = (np.array([r[k] for r in rows]) for k in range(4))
        tree = enhanced_suffixes(numbers, texts, o, d)
        if tree is None:
            return None
        owner, start, depth, parent, leaf, _, diverse = tree
        out: list[list] = [[] for _ in range(5)]
        at = leaf.copy()
        while (at > 0).any():  # every interval above a suffix, a bounded number
            for i in np.flatnonzero((at > 0) & diverse[at]):
                k, n = owner[i], int(depth[at[i]])
                for column, v in zip(out, (a[k], texts[k][start[i]:start[i] + n], n, c[k], start[i] - o[k])):
                    column.append(v)
            at = np.where(at > 0, parent[at], 0)
        return [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32()))]

    found = _of_groups(few, process, "a long, repeat binary, length int, c long, lo int", ["a", "repeat", "length", "c", "lo"]).distinct()
    # a string may hold several anchors, each with classes of its own
    each = _strings(many).select("a", "c", "lo", F.struct("a", "string").alias("key"), "shared")
    held = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("shared").alias("any")).where("n > 1 OR any")
    split = lookup_by_key(each, held, "key", "n", "inner").select("a", F.col("key.string").alias("repeat"), F.lit(LEAST).alias("length"), "c", "lo")
    return found.union(split).join(class_members(classes).withColumnRenamed("d", "rank"), "c")


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Bytes covered by a string of ``LEAST`` bytes that also starts in a document with a smaller id go.
    """
    rows = _ranked(docs, doc_id, text)
    classes = _classes(rows, heavy)
    few, many = _compared(rows, classes, group)
    parts = earlier_repeats(few).union(split_groups(many))
    whole = classes.where("kind = 0").groupBy("d").agg(F.collect_list("cs").alias("cs"))
    parts = parts.groupBy("d").agg(F.collect_list(F.struct("c", "lo", "hi")).alias("parts"))
    verdicts = stored(whole.join(parts, "d", "full").withColumnRenamed("d", "rank"), "repeats-verdicts")
    listed = classes.where("kind = 2").select("c", "d").toArrow()  # at most SMALL_KEYS rows
    order = np.argsort(listed.column("c").to_numpy())
    heavies = docs.sparkSession.sparkContext.broadcast((listed.column("c").to_numpy()[order], listed.column("d").to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hc, hd = heavies.value
        for b in batches:
            texts, ranks = _bytes(b.column("text")), b.column("rank").to_numpy(zero_copy_only=False)
            for some in _groups(texts):
                of, place, _, c = anchors([texts[i] for i in some])
                c = c.view(np.int64)
                cuts = np.searchsorted(of, np.arange(len(some) + 1))
                out: list[list] = [[] for _ in range(5)]
                for k, i in enumerate(some):
                    mine, at, t = c[cuts[k]:cuts[k + 1]], place[cuts[k]:cuts[k + 1]], texts[i]
                    step = np.zeros(len(t) + 1, np.int64)
                    lists, own = b.column("cs")[i], b.column("parts")[i]
                    gone = np.zeros(len(mine), bool)
                    if lists.is_valid:
                        gone |= np.isin(mine, np.frombuffer(b"".join(lists.as_py()), np.int64))
                    if len(hc) and len(mine):
                        found = np.minimum(np.searchsorted(hc, mine), len(hc) - 1)
                        gone |= (hc[found] == mine) & (hd[found] < ranks[i])
                    np.add.at(step, np.maximum(at[gone] - REACH, 0), 1)
                    np.add.at(step, np.minimum(at[gone] + LEAST, len(t)), -1)
                    if own.is_valid:
                        pc, lo, hi = (own.values.field(f).to_numpy(zero_copy_only=False) for f in ("c", "lo", "hi"))
                        by = np.argsort(mine, kind="stable")
                        left, right = np.searchsorted(mine[by], pc, "left"), np.searchsorted(mine[by], pc, "right")
                        n = right - left
                        which = by[np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                        np.add.at(step, at[which] + np.repeat(lo, n), 1)
                        np.add.at(step, at[which] + np.repeat(hi, n), -1)
                    removed = np.cumsum(step[:-1]) > 0
                    kept = np.frombuffer(t, np.uint8)[~removed].tobytes()
                    spans = int(np.count_nonzero(np.diff(np.r_[False, removed].astype(np.int8)) == 1))
                    for column, v in zip(out, (ranks[i], len(t), int(removed.sum()), spans, hashlib.sha256(kept).hexdigest())):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (
                    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["rank", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "rank long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    # texts without a verdict stay where they are
    keys = small(verdicts.select("rank"), SMALL_KEYS)
    touched = rows.join(keys, "rank", "left_semi").join(verdicts, "rank").select("rank", "text", "cs", "parts")
    others = rows.join(keys, "rank", "left_anti")
    if len(order):
        alone = others.select("rank", "text", *[F.lit(None).cast(verdicts.schema[c].dataType).alias(c) for c in ("cs", "parts")])
        out = mapped(touched, run, schema).union(mapped(alone, run, schema))
    else:
        out = mapped(touched, run, schema).union(others.select(
            "rank", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
            F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")))
    return out.select(F.when(F.col("rank") != LAST, F.col("rank")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
