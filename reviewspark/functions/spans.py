"""Half-open code-point spans as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewspark.scale import let

SPAN = "struct<start:int,end:int,term:string>"


CHUNK = 32


def starts_of(lengths: Column, levels: int = 2) -> Column:
    """Where each item begins, from the lengths of the items: running sums, the first one 0.

    An aggregate copies what it has gathered at every step, so sums are gathered in chunks, only as numbers, and
    the sums of the chunks are gathered in the same way.
    """
    def gathered(values):
        return F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def shifted(parts):
        return F.flatten(F.zip_with(
            parts, starts_of(F.transform(parts, lambda c: F.element_at(c, -1)), levels - 1),
            lambda c, off: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x: x + off)))

    def chunked(values):
        at = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(CHUNK))
        return let(F.transform(at, lambda i: gathered(F.slice(values, i + 1, F.lit(CHUNK)))), shifted)

    # bound once: every chunk slices the same evaluated array
    return let(lengths, lambda v: F.slice(gathered(v), F.lit(1), F.size(v)) if levels == 0 else chunked(v))


def place(items: Column, length, build) -> Column:
    """Running offsets over an array: ``build(item, start)`` for every item."""
    return let(items, lambda v: F.zip_with(v, starts_of(F.transform(v, lambda x: length(x).cast("int"))), build))


def first_span(text: Column, pattern: str) -> Column:
    """The first match as struct(start, end, term), or null."""
    head = F.get(F.split(text, pattern, 2), F.lit(0))
    term = F.regexp_extract(text, pattern, 0)
    return F.when(text.rlike(pattern), F.struct(F.length(head).alias("start"), (F.length(head) + F.length(term)).alias("end"), term.alias("term")))


def find_spans(text: Column, pattern: str) -> Column:
    """All non-overlapping matches as ``array<struct<start,end,term>>``.

    Offsets come from running lengths of the pieces between matches, so they are
    code points even after emoji, and the text never leaves the JVM.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def spans_of(hits):
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        pieces = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("term")))
        return place(
            pieces, lambda p: p["gap"] + F.length(p["term"]),
            lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + F.length(p["term"])).alias("end"), p["term"].alias("term")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, spans_of(hits)).otherwise(none))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def overlaps(a_s: Column, a_e: Column, b_s: Column, b_e: Column) -> Column:
    return F.greatest(a_s, b_s) < F.least(a_e, b_e)


def span_iou(a_s: Column, a_e: Column, b_s: Column, b_e: Column) -> Column:
    inter = F.greatest(F.lit(0), F.least(a_e, b_e) - F.greatest(a_s, b_s))
    union = F.greatest(a_e, b_e) - F.least(a_s, b_s)
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def gap_text(text: Column, a_s: Column, a_e: Column, b_s: Column, b_e: Column) -> Column:
    """Text between two spans, whatever their order (empty if they touch or overlap)."""
    left = F.least(a_e, b_e)
    right = F.greatest(a_s, b_s)
    return F.substring(text, left + 1, F.greatest(F.lit(0), right - left))


def expand_to_word(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end) widened over adjoining letters, digits, ``_`` and ``-``."""
    left = F.length(F.regexp_extract(F.substring(text, F.lit(1), start), r"([\p{L}\p{N}_-]*)\z", 1))
    right = F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^([\p{L}\p{N}_-]*)", 1))
    return F.struct((start - left).alias("start"), (end + right).alias("end"))


def offset_ok(text: Column, start: Column, end: Column, term: Column | None = None) -> Column:
    """In bounds and, if a term is given, an exact match of the raw text."""
    ok = (start >= 0) & (start < end) & (end <= F.length(text))
    if term is not None:
        ok = ok & (term.isNull() | (F.substring(text, start + 1, end - start) == term))
    return ok


def to_raw(alignment: Column, ns: Column, ne: Column) -> Column:
    """Normalized span to raw span over alignment pieces; null outside the text."""
    hit = F.filter(alignment, lambda p: (p["ns"] < ne) & (p["ne"] > ns))
    length = F.array_max(F.transform(alignment, lambda p: p["ne"]))
    inside = (ns >= 0) & (ne > ns) & (ne <= length)
    return F.when(
        inside,
        F.struct(
            F.array_min(F.transform(hit, lambda p: p["rs"])).alias("start"),
            F.array_max(F.transform(hit, lambda p: p["re"])).alias("end"),
        ),
    )


def to_normalized(alignment: Column, raw_length: Column, rs: Column, re_: Column) -> Column:
    """Raw span to normalized span: from the first to the last piece touching it."""
    hit = F.filter(alignment, lambda p: F.greatest(p["rs"], rs) < F.least(p["re"], re_))
    inside = (rs >= 0) & (re_ > rs) & (re_ <= raw_length) & (F.size(hit) > 0)
    return F.when(
        inside,
        F.struct(
            F.array_min(F.transform(hit, lambda p: p["ns"])).alias("start"),
            F.array_max(F.transform(hit, lambda p: p["ne"])).alias("end"),
        ),
    )
