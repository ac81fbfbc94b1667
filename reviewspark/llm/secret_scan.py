"""Secret scan over a trigram inverted index.

Each rule is a regular expression. A Boolean query over trigrams is derived from its syntax tree
(``trigram_query``); the index lists for every trigram that some query asks for the rows that hold it, the
postings of a query are intersected, and only candidates are verified with the regular expression. A rule
without a mandatory trigram has no query and scans every text.

Defined results: a null text counts as empty; rows without a match have an empty span list; repeated
rows give repeated results; spans are code points, end exclusive, ordered by start, then by the order
of the rules; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.functions.spans import place
from reviewspark.llm.common import stored
from reviewspark.llm.trigram_query import trigram_query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: group and its least length, in characters; shorter matches are dropped
    group: int = 0
    least: int = 1


# The base kinds, and two kinds that this scan adds.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + ADDED_RULES


def rule_query(rule: Rule) -> list[list[str]]:
    """Alternatives of trigrams that must all occur; empty if nothing must (scan fully)."""
    return trigram_query(rule.pattern)


def query_trigrams(rules) -> list[str]:
    return sorted({t for r in rules for alternative in rule_query(r) for t in alternative})


def row_key(doc_id: Column, text: Column) -> Column:
    """What names a row: its id and a hash of its text. Repeated rows share it, and their postings."""
    return F.struct(F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n")).alias("id"), F.xxhash64(text).alias("h"))


def trigram_index(docs: DataFrame, doc_id: Column, text: Column, wanted: list[str]) -> DataFrame:
    """Postings: (trigram, key), for the trigrams that some rule asks for.

    One pass over the text finds which of them it holds; a trigram is listed once per row. Folding all
    letters rather than A-Z alone can only add candidates.
    """
    folded = F.lower(text)
    hits = F.array_compact(F.array(*[F.when(F.contains(F.col("folded"), F.lit(t)), F.lit(t)) for t in wanted]))
    rows = docs.select(row_key(doc_id, text).alias("key"), folded.alias("folded"))
    return rows.select("key", F.explode(hits).alias("trigram")).select("trigram", "key")


def candidates(index: DataFrame, rules) -> DataFrame:
    """(key, kinds): rows whose postings satisfy the query of at least one rule."""
    held = index.groupBy("key").agg(F.collect_set("trigram").alias("held"))
    kinds = []
    for r in rules:
        query = rule_query(r)
        if query:
            fits = None
            for alternative in query:
                every = F.size(F.array_intersect(F.col("held"), F.array(*map(F.lit, alternative)))) == len(alternative)
                fits = every if fits is None else fits | every
            kinds.append(F.when(fits, F.lit(r.kind)))
    return held.select("key", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


def rule_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start,end,kind>> of one rule; offsets are running lengths of gaps and matches."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    pieces = F.zip_with(F.zip_with(gaps, whole, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("len"))), parts, lambda a, p: F.struct(
        a["gap"].alias("gap"), a["len"].alias("len"), F.length(p).alias("part")))
    pieces = F.filter(pieces, lambda x: x["len"].isNotNull())
    spans = place(pieces, lambda x: x["gap"] + x["len"], lambda x, at: F.struct(
        (at + x["gap"]).alias("start"), (at + x["gap"] + x["len"]).alias("end"), x["part"].alias("part")))
    kept = F.filter(spans, lambda s: s["part"] >= rule.least)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


NO_SPANS = "array<struct<start:int,end:int>>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """(doc_id, one column per rule): the spans of each rule in every row, none where there is no match."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    key = docs[doc_id]
    indexed = [r for r in rules if rule_query(r)]
    index = stored(trigram_index(docs, key, body, query_trigrams(rules)), "trigram-index")
    chosen = candidates(index, indexed)
    none = F.array().cast(NO_SPANS)

    def full(rule):
        return F.when(F.col("body").rlike(rule.pattern), rule_spans(F.col("body"), rule)).otherwise(none)

    rows = docs.select(key.alias("doc_id"), row_key(key, body).alias("key"), body.alias("body"))
    joined = rows.join(chosen, "key", "left")
    found = [full(r) if r not in indexed else F.when(
        F.array_contains("kinds", r.kind) & F.col("body").rlike(r.pattern), rule_spans(F.col("body"), r)).otherwise(none) for r in rules]
    return joined.select("doc_id", *[f.alias(r.kind) for f, r in zip(found, rules)])


def joined_spans(rules) -> Column:
    """``kind:start:end`` of all given rules, by start, then by rule order, comma-joined."""
    def ranked(rank):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"))

    tagged = [F.transform(F.col(r.kind), ranked(i)) for i, r in enumerate(rules)]
    names = F.array(*[F.lit(r.kind) for r in rules])
    ordered = F.array_sort(F.concat(*tagged))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
