"""Text keys, label canonicalisation and string scalars as Column expressions.

All of them stay inside the JVM.  The only Python in this module normalises
Unicode, and it is handed nothing but the rows that hold characters it may change.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reviewspark import lexicons as lx
from reviewspark.scale import let

# Texts of characters that compatibility normalisation leaves alone wherever they stand: none combines with a neighbour.
# Of them only the sharp s case-folds to anything but its lower case. A match of the whole text is ten times as fast as
# a search for one character of the complement.
STABLE = r"^[\x00-\x7F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u00FF\u2013\u2014\u2018-\u201F\u2022\u20AC]*+$"


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda t: None if t is None else t.casefold())


def _only_unstable(text: Column, udf, stable_value: Column) -> Column:
    plain = text.rlike(STABLE)
    return F.coalesce(F.when(plain, stable_value), udf(F.when(~plain, text)))


def _lower_folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def nfkc(text: Column) -> Column:
    return _only_unstable(text, _nfkc, text)


def nfkc_casefold(text: Column) -> Column:
    return _only_unstable(text, _nfkc_casefold, _lower_folded(text))


def casefold(text: Column) -> Column:
    return _only_unstable(text, _casefold, _lower_folded(text))


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def raw_exact_key(text: Column) -> Column:
    """Hard identity: compatibility form and single spaces; case and punctuation kept."""
    return collapse_ws(nfkc(text))


def lower_key(text: Column, unicode: bool = True) -> Column:
    """Lower-cased key; ``unicode=False`` is the audit variant without compatibility mapping."""
    return collapse_ws(F.lower(nfkc(text) if unicode else text))


def leakage_key(text: Column) -> Column:
    """Case-folded key without punctuation."""
    return collapse_ws(F.regexp_replace(nfkc_casefold(text), r"(?U)[^\w\s]", " "))


def squeeze_letters(text: Column, keep: int = 2, letters: str = "A-Za-z") -> Column:
    """Cut runs of three or more equal letters down to ``keep``."""
    return F.regexp_replace(text, rf"([{letters}])\1{{2,}}", "$1" * keep)


def soft_key(text: Column, words: Mapping[str, str] | None = None) -> Column:
    """Language-aware soft key for audits; never the identity of a record."""
    table = lx.literal_map(words or lx.SOFT_KEY_WORDS)
    base = collapse_ws(F.regexp_replace(nfkc_casefold(text), r"(?U)[^\w\s-]", " "))
    mapped = F.array_join(F.transform(F.split(base, " "), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")
    joined = F.regexp_replace(mapped, r"(?U)\b([\w-]+)\s+(nya|ku|mu)\b", "$1$2")
    return squeeze_letters(joined, 2, "a-z")


def location_key(value: Column) -> Column:
    """Gazetteer key: case-folded, ``kab.`` spelled out, punctuation and underscores to spaces."""
    low = F.replace(F.lower(F.coalesce(value.cast("string"), F.lit(""))), F.lit("kab."), F.lit("kabupaten "))
    bare = F.translate(F.regexp_replace(low, r"(?U)[^\w\s-]", " "), "_", " ")
    return compact_spaces(bare)


def compact_spaces(value: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), r"\s+([,.;!?])", "$1")


def canonical_sentiment(value: Column) -> Column:
    low = F.translate(F.lower(F.trim(value.cast("string"))), "-", "_")
    return F.coalesce(F.try_element_at(lx.literal_map(lx.SENTIMENT_ALIASES), low), low)


def api_sentiment(value: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("neutral"))))
    return F.coalesce(F.try_element_at(lx.literal_map(lx.API_SENTIMENT_ALIASES), low), low)


def replace_emoji(text: Column, tokens: Mapping[str, str] | None = None) -> Column:
    """Emoji to polarity tokens, longest first."""
    out = text
    table = lx.EMOJI_TOKENS if tokens is None else tokens
    for emoji in sorted(table, key=len, reverse=True):
        out = F.replace(out, F.lit(emoji), F.lit(table[emoji]))
    return F.regexp_replace(out, lx.EMOJI_PATTERN, "[EMOJI]")


NUMBER_UNIT = r"(?i)^(\d+(?:[.,]\d+)?)(mnt|menit|jam|dtk|detik|km|meter|rb|ribu|k)$"


def split_number_unit(token: Column) -> Column:
    """``25mnt`` becomes ``25 menit``; anything else is returned unchanged."""
    unit = F.lower(F.regexp_extract(token, NUMBER_UNIT, 2))
    number = F.regexp_extract(token, NUMBER_UNIT, 1)
    return F.when(token.rlike(NUMBER_UNIT), F.concat(number, F.lit(" "), F.try_element_at(lx.literal_map(lx.UNITS), unit))).otherwise(token)


def token_class(token: Column, index: Column) -> Column:
    """Why a token must not be rewritten, or null if it may be."""
    # plain lower-case words, the bulk of any text, need none of the patterns below
    return (
        F.when(token.rlike(r"^\p{Ll}+$"), F.lit(None).cast("string"))
        .when(token.isin(lx.PROTECTED_MARKERS), "annotation_marker")
        .when(token.rlike(r"(?i)^(?:https?://\S+|www\.\S+)$"), "url")
        .when(token.rlike(r"(?U)^[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}$"), "email")
        .when(token.startswith("#"), "hashtag")
        .when(token.rlike(r"(?U)^\+?\d[\d() .-]{7,}\d$"), "phone")
        .when((F.length(token) >= 6) & token.rlike("[A-Za-z]") & token.rlike(r"(?U)\d"), "transaction_or_product_id")
        .when((F.length(token) > 1) & token.rlike(r"\p{Lu}") & ~token.rlike(r"\p{Ll}"), "acronym_or_brand")
        .when((index > 0) & token.rlike(r"^\p{Lu}"), "proper_name_candidate")
    )


def mask_private(text: Column) -> Column:
    """URLs, mail addresses, phone numbers and id-like tokens to placeholders."""
    out = F.regexp_replace(text, r"(?i)https?://\S+|www\.\S+", "[URL]")
    out = F.regexp_replace(out, r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    out = F.regexp_replace(out, r"\+?\d[\d() .-]{7,}\d", "[PHONE]")
    return F.regexp_replace(out, r"(?U)\b(?=\w*[A-Za-z])(?=\w*\d)\w{6,}\b", "[ID]")


def first_nonempty(*cols: Column) -> Column:
    """First alias that is neither null nor empty."""
    return F.coalesce(*[F.when(c.cast("string") != "", c.cast("string")) for c in cols])


def strict_bool(value: Column) -> Column:
    """true/false/0/1 only; anything else is null, which the contract reports."""
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin("true", "1"), F.lit(True)).when(low.isin("false", "0"), F.lit(False))


def tolerant_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def int_or_null(value: Column) -> Column:
    """Whole numbers (also ``"3.0"``) as int; blanks and fractions as null."""
    number = F.expr("try_cast(null as double)") if value is None else value.cast("string").try_cast("double")
    return F.when(number == F.floor(number), number.cast("int"))


def content_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("::", *parts), 256)


def hash01(salted: Column, digest: str = "sha1") -> Column:
    """Uniform value in [0, 1] from the first 12 hex digits of a salted hash."""
    hexed = F.sha1(salted) if digest == "sha1" else F.sha2(salted, 256)
    return F.conv(F.substring(hexed, 1, 12), 16, 10).cast("double") / F.lit(float(16**12 - 1))


def internal_role(root: Column, seed: int = 42, tune: float = 0.10, calibration: float = 0.10) -> Column:
    """Deterministic role of a training component from its root id."""
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), root), 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    return F.when(u < tune, "inner_tune").when(u < tune + calibration, "calibration").otherwise("fit")


def place_split(place: Column, train: float = lx.PLACE_SPLIT_RATIOS[0], validation: float = lx.PLACE_SPLIT_RATIOS[1]) -> Column:
    """Stable place-disjoint split from the first 8 hex digits of a hash."""
    u = F.conv(F.substring(F.sha1(place.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")


def template_mask(text: Column, slots: str = lx.TEMPLATE_SLOTS, chars: int = 60) -> Column:
    """Slot words blanked out, first characters kept: a template signature of a review."""
    return F.substring(F.regexp_replace(lower_key(text, unicode=False), "(?U)" + slots, "[SLOT]"), 1, chars)


def csv_safe(value: Column) -> Column:
    """Defuse spreadsheet formulas in exported cells."""
    return F.when(F.substring(value, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), value)).otherwise(value)


def mark_pair(text: Column, a_s: Column, a_e: Column, o_s: Column | None = None, o_e: Column | None = None) -> Column:
    """Insert aspect and opinion markers; null where the offsets cannot be marked.

    Null covers spans out of bounds, overlapping spans and texts that already
    carry a reserved marker.
    """
    def piece(s, e):
        return F.substring(text, s + 1, e - s)

    def asp(s, e):
        return F.concat(F.lit("[ASP] "), piece(s, e), F.lit(" [/ASP]"))

    def opn(s, e):
        return F.concat(F.lit("[OPN] "), piece(s, e), F.lit(" [/OPN]"))

    n = F.length(text)
    reserved = F.lit(False)
    for marker in lx.MARKERS:
        reserved = reserved | F.contains(text, F.lit(marker))
    ok = (a_s >= 0) & (a_s < a_e) & (a_e <= n) & ~reserved
    only = F.concat(piece(F.lit(0), a_s), asp(a_s, a_e), piece(a_e, n))
    if o_s is None:
        return F.when(ok, only)
    pair_ok = ok & (o_s >= 0) & (o_s < o_e) & (o_e <= n) & (F.greatest(a_s, o_s) >= F.least(a_e, o_e))
    before = F.concat(piece(F.lit(0), a_s), asp(a_s, a_e), piece(a_e, o_s), opn(o_s, o_e), piece(o_e, n))
    after = F.concat(piece(F.lit(0), o_s), opn(o_s, o_e), piece(o_e, a_s), asp(a_s, a_e), piece(a_e, n))
    return F.when(o_s.isNull(), F.when(ok, only)).when(pair_ok, F.when(a_s < o_s, before).otherwise(after))


def count_before(text: Column, position: Column, pattern: str) -> Column:
    """How many matches lie in the text before ``position``: a sentence or clause index."""
    return F.regexp_count(F.substring(text, F.lit(1), position), F.lit(pattern))


def sentence_index(text: Column, position: Column) -> Column:
    return count_before(text, position, lx.FEATURE_SENTENCE)


def clause_index(text: Column, position: Column) -> Column:
    return count_before(text, position, lx.FEATURE_CLAUSE)


def _one_stop(text: Column) -> Column:
    return F.translate(text, "!?;\n", "....")


def sentence_left(text: Column, start: Column) -> Column:
    """Offset just after the last sentence end before ``start``."""
    return start - F.length(F.substring_index(_one_stop(F.substring(text, F.lit(1), start)), ".", -1))


def sentence_right(text: Column, end: Column) -> Column:
    """Offset just after the first sentence end at or after ``end`` (text end if none)."""
    tail = F.substring(text, end + 1, F.length(text))
    head = F.length(F.substring_index(_one_stop(tail), ".", 1))
    return end + F.least(head + 1, F.length(tail))


def negation_scope(text: Column, start: Column, end: Column, boundary: str = lx.NEGATION_BOUNDARY, words: str = lx.NEGATION_WORDS) -> Column:
    """Opinion-local negation: struct(negated, scope_start, scope_end, terms)."""
    lo = F.greatest(F.lit(0), start - 32)
    kept = F.length(F.element_at(F.split(F.substring(text, lo + 1, start - lo), "(?Ui)" + boundary, -1), -1))

    def of(from_):
        terms = F.regexp_extract_all(F.substring(text, from_ + 1, end - from_), F.lit("(?Ui)" + words), F.lit(0))
        return let(terms, lambda t: F.struct(
            (F.size(t) > 0).alias("negated"), F.when(F.size(t) > 0, from_).alias("scope_start"), F.when(F.size(t) > 0, end).alias("scope_end"), t.alias("terms")))

    # each step is evaluated once, also inside a lambda
    return let(start - kept, of)


def any_contains(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def semantic_domain(text: Column, rules=None) -> Column:
    out = None
    for domain, pattern in rules or lx.SEMANTIC_DOMAINS:
        cond = F.lower(text).rlike("(?U)" + pattern)
        out = F.when(cond, domain) if out is None else out.when(cond, domain)
    return out.otherwise("generic")


def domain_alias(value: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(F.when(value != "", value), F.lit("other"))))
    return F.coalesce(F.try_element_at(lx.literal_map(lx.DOMAIN_ALIASES), low), low)


def resolve_domain(text: Column, explicit: Column | None = None, hints: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Domain with the most hint terms; the earlier declared one wins a tie; null if none hit."""
    table = lx.DOMAIN_HINTS if hints is None else hints

    def scores(low):
        return F.array(*[
            F.struct(
                sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0)).alias("score"),
                F.lit(-i).alias("priority"),
                F.lit(d).alias("domain"),
            )
            for i, (d, terms) in enumerate(table.items())
        ])

    found = let(let(F.lower(text), lambda low: F.array_max(scores(low))), lambda best: F.when(best["score"] > 0, best["domain"]))
    if explicit is None:
        return found
    return F.when(explicit.isin(list(lx.DOMAIN_TERMS)), explicit).otherwise(found)


WORD_TOKENS = r"(?U)\b[\w'-]+\b"


def language_metadata(text: Column, declared: Column | None = None, id_words=None, en_words=None) -> Column:
    """struct(language, confidence, is_code_switched, id_hits, en_hits) from marker words."""
    told = F.lower(F.coalesce(declared, F.lit(""))) if declared is not None else F.lit("")
    told_ok = told.isin(lx.DECLARED_LANGUAGES)

    def counted(words):
        return F.struct(
            F.size(F.filter(words, lambda w: w.isin(id_words or lx.ID_MARKERS))).alias("ids"),
            F.size(F.filter(words, lambda w: w.isin(en_words or lx.EN_MARKERS))).alias("ens"),
            text.rlike(r"(?Ui)\b[A-Za-z]+-(?:nya|ku|mu)\b").alias("suffix"))

    def of(v):
        ids, ens, suffix = v["ids"], v["ens"], v["suffix"]
        mixed = ((ids > 0) & (ens > 0)) | suffix
        label = (
            F.when(mixed, "id-en").when(told_ok, told).when(ids > ens, "id").when(ens > ids, "en").otherwise("unknown")
        )
        confidence = (
            F.when(mixed, F.least(F.lit(0.95), F.lit(0.65) + F.lit(0.04) * F.least(ids, ens) + F.when(suffix, 0.1).otherwise(0.0)))
            .when(told_ok, F.lit(1.0))
            .when(ids > ens, F.least(F.lit(0.95), F.lit(0.55) + F.lit(0.06) * ids))
            .when(ens > ids, F.least(F.lit(0.95), F.lit(0.55) + F.lit(0.06) * ens))
            .otherwise(F.lit(0.3))
        )
        return F.struct(
            label.alias("language"), F.round(confidence, 4).alias("confidence"), mixed.alias("is_code_switched"),
            ids.alias("id_hits"), ens.alias("en_hits"),
        )

    # words are found and counted once
    return let(let(F.regexp_extract_all(F.lower(text), F.lit(WORD_TOKENS), F.lit(0)), counted), of)
