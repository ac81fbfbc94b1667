"""Customer class and location of a review, and the review text without that metadata.

The gazetteer is a bounded lookup held in the plan, so resolving a location is
a narrow row operation: candidate words are found in the text and looked up,
instead of scanning the text once per alias or joining texts to a table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewspark import lexicons as lx
from reviewspark.functions import text as tx
from reviewspark.functions.spans import SPAN, find_spans, overlaps
from reviewspark.scale import let

MAX_ALIASES = 20_000
THRESHOLD = 0.80
REGION = "array<struct<code:string,name:string,location_type:string,province:string>>"


def resolve_customer(text: Column, field: Column | None = None, classes=None) -> Column:
    """struct(customer_id, customer_class, method, source, masked_id, warnings, spans)."""
    classes = classes or lx.CUSTOMER_CLASSES
    safe = F.coalesce(text, F.lit(""))
    given = F.trim(field.cast("string")) if field is not None else F.lit(None).cast("string")
    parts = F.struct(
        F.regexp_extract_all(safe, F.lit(lx.CUSTOMER_LABEL), F.lit(2)).alias("ids"),
        F.when(given.rlike(r"^\d+$"), given).alias("field"), (F.coalesce(given, F.lit("")) != "").alias("given"),
        F.transform(find_spans(safe, lx.CUSTOMER_LABEL), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))

    def result(v):
        text_id = F.get(v["ids"], F.lit(0))
        chosen = F.coalesce(v["field"], text_id)
        cls = F.coalesce(F.try_element_at(lx.literal_map(classes), F.substring(chosen, 1, 1)), F.lit("UNKNOWN"))
        warnings = F.filter(F.array(
            F.when(F.size(F.array_distinct(v["ids"])) > 1, "multiple_customer_ids"), F.when(v["given"] & v["field"].isNull(), "invalid_structured_customer_id"),
            F.when(v["field"].isNotNull() & text_id.isNotNull() & (v["field"] != text_id), "customer_id_conflict"),
            F.when(chosen.isNotNull() & (cls == "UNKNOWN"), "unsupported_customer_prefix")), lambda w: w.isNotNull())
        return F.struct(
            chosen.alias("customer_id"), cls.alias("customer_class"), F.when(chosen.isNotNull(), "first_digit_rule").alias("method"),
            F.when(v["field"].isNotNull(), "structured_field").when(text_id.isNotNull(), "review_text").alias("source"),
            F.concat(F.substring(chosen, 1, 2), F.repeat(F.lit("*"), F.greatest(F.lit(1), F.length(chosen) - 2))).alias("masked_id"), warnings.alias("warnings"), v["spans"].alias("spans"))

    return let(parts, result)


class Gazetteer:
    """Aliases of regions and provinces, checked to be small enough for the plan."""

    def __init__(self, region_alias: DataFrame, province_alias: DataFrame):
        if region_alias.limit(MAX_ALIASES + 1).count() > MAX_ALIASES or province_alias.limit(MAX_ALIASES + 1).count() > MAX_ALIASES:
            raise ValueError(f"a gazetteer holds at most {MAX_ALIASES} aliases")
        self.regions: dict[str, list] = {}
        for r in region_alias.orderBy("alias", "code").collect():
            self.regions.setdefault(r["alias"], []).append((r["code"], r["name"], r["location_type"], r["province"]))
        self.provinces = {r["alias"]: r["province"] for r in province_alias.collect()}

    def region_map(self) -> Column:
        pairs = []
        for alias, rows in self.regions.items():
            pairs += [F.lit(alias), F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("code", "name", "location_type", "province"))]) for r in rows])]
        return F.create_map(*pairs)

    def first_words(self) -> list[str]:
        return sorted({a.split(" ")[0] for a in self.regions})

    def longest(self) -> int:
        return max((len(a.split(" ")) for a in self.regions), default=1)

    def single_words(self) -> list[str]:
        return sorted(a for a in self.regions if " " not in a)


def _fuzzy(aliases: Sequence[str]):
    out = T.ArrayType(T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("aliases", T.ArrayType(T.StringType()))]))

    def best(word):
        ranked = sorted(((SequenceMatcher(None, word, a).ratio(), a) for a in aliases), reverse=True)
        top = ranked[0][0] if ranked else 0.0
        return {"ratio": top, "aliases": sorted(a for r, a in ranked if top - r <= 0.03)}

    def run(words: pd.Series) -> pd.Series:
        seen: dict[str, dict] = {}
        return words.map(lambda ws: None if ws is None else [seen.setdefault(w, best(w)) if w not in seen else seen[w] for w in ws])

    return F.pandas_udf(run, out)


def _location(raw, city, province, kind, semantic, source, status, confidence, candidates, evidence, start, end, code) -> Column:
    return F.struct(
        raw.alias("raw_location"), city.alias("city_or_regency"), province.alias("province"), kind.alias("location_type"), semantic.alias("semantic_type"), source.alias("source"),
        status.alias("status"), confidence.cast("double").alias("confidence"), candidates.alias("candidates"), evidence.alias("evidence"), start.cast("int").alias("start"),
        end.cast("int").alias("end"), code.alias("region_code"))


def _none(kind="string") -> Column:
    return F.lit(None).cast(kind)


def _strings() -> Column:
    return F.array().cast("array<string>")


def not_found() -> Column:
    return _location(_none(), _none(), _none(), _none(), F.lit("unknown_location_type"), _none(), F.lit("not_found"), F.lit(0.0), _strings(), _strings(), _none("int"), _none("int"), _none())


def _resolution(raw, candidates, source: str, evidence, confidence, start, end, province=None) -> Column:
    """Status of a set of candidate regions: resolved, ambiguous or conflict, with capped confidence."""
    told = province if province is not None else _none()

    def result(v):
        fitting = F.filter(v["all"], lambda r: r["province"] == v["province"])
        conflict = v["province"].isNotNull() & (F.size(v["all"]) > 0) & (F.size(fitting) == 0)
        use = F.when(v["province"].isNotNull() & (F.size(fitting) > 0), fitting).otherwise(v["all"])
        ev = F.when(v["province"].isNotNull() & (F.size(fitting) > 0), F.concat(v["ev"], F.array(F.lit("province_relation_valid")))).otherwise(v["ev"])
        names = F.transform(use, lambda r: r["name"])
        provinces = F.array_distinct(F.transform(use, lambda r: r["province"]))
        one = F.get(use, F.lit(0))
        ok = v["conf"] >= THRESHOLD
        joined = F.array_join(v["ev"], " ")
        semantic = F.lit("customer_location") if source == "structured_field" else (
            F.when(joined.rlike("pengiriman|dikirim"), "delivery_destination").when(joined.rlike("cabang|outlet"), "store_location").otherwise("mentioned_location"))
        unknown = F.lit("unknown_location_type")
        src = F.lit(source)
        return (
            F.when(conflict, _location(v["raw"], _none(), v["province"], _none(), unknown, src, F.lit("conflict"), F.round(F.least(v["conf"], F.lit(0.49)), 2), F.transform(v["all"], lambda r: r["name"]),
                                       F.concat(v["ev"], F.array(F.lit("city_province_conflict"))), v["start"], v["end"], _none()))
            .when(F.size(use) != 1, _location(v["raw"], _none(), F.coalesce(v["province"], F.when(F.size(provinces) == 1, F.get(provinces, F.lit(0)))), _none(), unknown, src, F.lit("ambiguous"),
                                              F.round(F.least(v["conf"], F.lit(0.69)), 2), names, F.concat(ev, F.array(F.lit("multiple_master_data_matches"))), v["start"], v["end"], _none()))
            .otherwise(_location(v["raw"], F.when(ok, one["name"]), one["province"], F.when(ok, one["location_type"]), semantic, src, F.when(ok, "resolved").otherwise("ambiguous"),
                                 F.round(v["conf"], 2), F.when(ok, _strings()).otherwise(names), ev, v["start"], v["end"], F.when(ok, one["code"]))))

    inputs = F.struct(raw.alias("raw"), F.array_distinct(candidates).alias("all"), evidence.alias("ev"), confidence.alias("conf"), start.alias("start"), end.alias("end"), told.alias("province"))
    return let(inputs, result)


def _in_word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM" or unicodedata.category(c) in ("Nd", "Nl", "Pc")


def any_of(words: Sequence[str]) -> str:
    """Pattern of any of the words, branching by letter, so that its cost grows with a word's length, not with their number."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def show(node):
        branches = [re.escape(c) + show(n) for c, n in sorted(node.items()) if c]
        return f"(?:{'|'.join(branches)}){'?' if '' in node else ''}" if branches else ""

    return show(root) if root else "(?!)"


def location_hits(text: Column, gazetteer: Gazetteer, cue: str = lx.LOCATION_CUE, not_places: Sequence[str] | None = None) -> Column:
    """Scored alias hits of a text, contained ones removed: array of struct(start, end, raw, score, evidence, regions)."""
    firsts = [w for w in gazetteer.first_words() if all(_in_word(c) for c in w)]
    lookup, longest = gazetteer.region_map(), gazetteer.longest()
    # only words that begin an alias get offsets, each with the words behind it that an alias may take
    first = rf"(?U)(?<!\w){any_of(firsts)}(?!\w)(?=((?:\W+\w+){{0,{longest - 1}}}))"

    def grams(low):
        def sized(w, tail):
            def gram(n):
                more = F.regexp_extract(tail, rf"(?U)^(?:\W+\w+){{{n - 1}}}", 0) if n > 1 else F.lit("")
                term = F.concat(w["term"], more)
                return F.when(F.lit(n == 1) | (more != ""), F.struct(
                    w["start"].alias("s"), (w["start"] + F.length(term)).alias("e"), F.try_element_at(lookup, F.regexp_replace(term, r"(?U)\s+", " ")).alias("regions")))

            return F.array(*[gram(n) for n in range(1, longest + 1)])

        return F.flatten(F.zip_with(find_spans(low, first), F.regexp_extract_all(low, F.lit(first), F.lit(1)), sized))

    def found(v):
        text, low, bad = v["text"], v["low"], v["bad"]
        known = F.filter(grams(low), lambda g: g["regions"].isNotNull() & ~F.exists(bad, lambda b: overlaps(g["s"], g["e"], b["start"], b["end"])))

        def score(g):
            lo = F.greatest(F.lit(0), g["s"] - 35)
            view = F.struct(
                F.trim(F.regexp_extract(F.substring(low, lo + 1, g["s"] - lo), "(?Ui)" + cue, 0)).alias("signal"), F.substring(low, lo + 1, g["s"] - lo).alias("before"),
                F.substring(text, g["s"] + 1, g["e"] - g["s"]).alias("raw"), F.substring(low, g["e"] + 1, F.lit(40)).alias("after"))

            def value(v):
                cued = v["signal"] != ""
                typed = v["before"].rlike(r"(?Ui)(?:^|\s)(?:kota|kabupaten|kab)\s*$")
                capital = v["raw"].rlike(r"^\p{Lu}")
                leading = (g["s"] == 0) & v["after"].rlike(r"(?Ui)^\s+(?:no|id|customer)")
                base = F.lit(0.42) + F.when(cued, 0.43).otherwise(0.0)
                base = F.when(typed, F.greatest(base, F.lit(0.97))).otherwise(base) + F.when(capital, 0.05).otherwise(0.0) + F.when(leading, 0.43).otherwise(0.0)
                ev = F.filter(F.array(
                    F.lit("exact_master_data_match"), F.when(cued, F.concat(F.lit("location_context: "), v["signal"])), F.when(typed, "explicit_administrative_type"),
                    F.when(capital, "capitalized_candidate"), F.when(leading, "leading_metadata_position")), lambda e: e.isNotNull())
                return F.struct(g["s"].alias("start"), (-g["e"]).alias("_e"), (-F.round(F.least(base, F.lit(0.99)), 9)).alias("_s"), g["e"].alias("end"), v["raw"].alias("raw"),
                                F.round(F.least(base, F.lit(0.99)), 9).alias("score"), ev.alias("evidence"), g["regions"].alias("regions"))

            return let(view, value)

        # a hit that holds another one begins at most as many words before it as the longest alias has, with as many ends each
        near = longest * longest
        return let(F.array_sort(F.transform(known, score)), lambda hs: F.filter(hs, lambda h, i: ~F.exists(
            F.slice(hs, F.greatest(i - near, F.lit(0)) + 1, F.least(i, F.lit(near))), lambda k: (h["start"] >= k["start"]) & (h["end"] <= k["end"]))))

    def refused(v):
        bad = [find_spans(v["low"], "(?Ui)" + p) for p in (lx.NOT_A_PLACE if not_places is None else not_places)]
        return let(F.struct(v["text"].alias("text"), v["low"].alias("low"), F.concat(F.array().cast(f"array<{SPAN}>"), *bad).alias("bad")), found)

    # bound once: nothing below lowers the text again for each hit
    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), refused)


def resolve_locations(df: DataFrame, gazetteer: Gazetteer, text: str = "text", city: str | None = None, province: str | None = None, cue: str = lx.LOCATION_CUE,
                      not_places: Sequence[str] | None = None, fuzzy: bool = True) -> DataFrame:
    """Add ``location`` and ``location_warnings``: structured fields first, then exact, then fuzzy text evidence."""
    t = F.coalesce(F.col(text), F.lit(""))
    x = df.withColumn("_hits", location_hits(t, gazetteer, cue, not_places))
    lookup = gazetteer.region_map()
    if fuzzy:
        words = F.filter(find_spans(t, r"\b[A-Z][A-Za-z]{4,}\b"), lambda w: F.lower(F.substring(t, F.greatest(F.lit(0), w["start"] - 30) + 1, F.least(F.lit(30), w["start"]))).rlike("(?Ui)" + cue))
        x = x.withColumn("_words", F.when(F.size("_hits") == 0, words)).withColumn("_words", F.when(F.size("_words") > 0, F.col("_words")))
        x = x.withColumn("_near", _fuzzy(gazetteer.single_words())(F.transform("_words", lambda w: tx.location_key(w["term"]))))
        pairs = F.filter(F.zip_with("_words", "_near", lambda w, n: F.struct(w.alias("w"), n.alias("n"))), lambda p: p["n"]["ratio"] >= 0.84)
        x = x.withColumn("_fuzzy", F.get(pairs, F.lit(0)))
    best = F.aggregate("_hits", F.get("_hits", F.lit(0)), lambda a, h: F.when(h["score"] > a["score"], h).otherwise(a))
    many = F.size("_hits") > 1

    def from_text(h):
        ev = F.when(many, F.concat(h["evidence"], F.array(F.lit("multiple_locations_in_review")))).otherwise(h["evidence"])
        return _resolution(h["raw"], h["regions"], "review_text", ev, h["score"], h["start"], h["end"])

    found = F.when(F.size("_hits") > 0, let(best, from_text))
    text_warn = F.when(many, F.array(F.lit("multiple_locations_detected"))).otherwise(_strings())
    if fuzzy:
        f = F.col("_fuzzy")
        found = found.when(f.isNotNull(), _resolution(
            f["w"]["term"], F.flatten(F.transform(f["n"]["aliases"], lambda a: F.try_element_at(lookup, a))), "fuzzy_review_text",
            F.array(F.lit("fuzzy_master_data_match"), F.concat(F.lit("score:"), F.format_number(f["n"]["ratio"], 2))), F.least(F.lit(0.91), f["n"]["ratio"]), f["w"]["start"], f["w"]["end"]))
        text_warn = F.when(f.isNotNull(), F.array(F.lit("fuzzy_location_match"))).otherwise(text_warn)
    x = x.withColumn("_text", found.otherwise(not_found())).withColumn("_text_warn", text_warn)
    none = _none()
    given_p = F.trim(F.col(province).cast("string")) if province else none
    known_p = F.try_element_at(lx.literal_map(gazetteer.provinces), tx.location_key(given_p)) if province and gazetteer.provinces else none
    given_c = F.trim(F.col(city).cast("string")) if city else none
    key_c = tx.location_key(given_c)
    every = F.try_element_at(lookup, key_c) if city else _none(REGION)
    cities = F.filter(every, lambda r: r["location_type"] == "city")
    chosen = F.when(~key_c.rlike(r"^(?:kab|kabupaten)\b") & (F.size(cities) > 0), cities).otherwise(every)
    x = x.withColumns({"_p": known_p, "_c": F.when(F.coalesce(given_c, F.lit("")) != "", chosen), "_city": F.when(given_c != "", given_c), "_prov": F.when(given_p != "", given_p)})
    structured = _resolution(F.col("_city"), F.col("_c"), "structured_field", F.array(F.lit("structured_city_field"), F.lit("exact_master_data_match")), F.lit(0.99), _none("int"), _none("int"), F.col("_p"))
    x = x.withColumn("_structured", F.when(F.col("_c").isNotNull(), structured))
    differs = (F.col("_text.status") == "resolved") & ~F.col("_text.city_or_regency").eqNullSafe(F.col("_structured.city_or_regency"))
    clash = F.col("_p").isNotNull() & (F.col("_text.status") != "not_found") & ~F.col("_text.province").eqNullSafe(F.col("_p"))
    only_p = F.col("_p").isNotNull() & (F.col("_text.status") == "not_found")

    def edit(c, **changes):
        names = ["raw_location", "city_or_regency", "province", "location_type", "semantic_type", "source", "status", "confidence", "candidates", "evidence", "start", "end", "region_code"]
        return F.struct(*[changes.get(n, F.col(f"{c}.{n}")).alias(n) for n in names])

    loc = (
        F.when(F.col("_structured").isNotNull(), F.when(differs, edit("_structured", evidence=F.concat("_structured.evidence", F.array(F.lit("review_text_mentions_different_location"))))).otherwise(F.col("_structured")))
        .when(clash, edit("_text", status=F.lit("conflict"), confidence=F.least(F.col("_text.confidence"), F.lit(0.49)), evidence=F.concat("_text.evidence", F.array(F.lit("structured_province_conflict")))))
        .when(only_p, edit("_text", raw_location=F.col("_prov"), province=F.col("_p"), location_type=F.lit("province"), source=F.lit("structured_field"), status=F.lit("resolved"),
                           confidence=F.lit(0.99), evidence=F.array(F.lit("structured_province_field"))))
        .otherwise(F.col("_text"))
    )
    has_s = F.col("_structured").isNotNull()
    warn = F.filter(F.array(
        F.when(F.col("_prov").isNotNull() & F.col("_p").isNull(), "unknown_structured_province"), F.when(has_s & differs, "location_source_conflict"),
        F.when(F.col("_city").isNotNull() & ~has_s, "unknown_structured_city")), lambda w: w.isNotNull())
    warn = F.concat(warn, F.when(has_s, _strings()).otherwise(F.col("_text_warn")), F.when(~has_s & clash, F.array(F.lit("location_source_conflict"))).otherwise(_strings()))
    return x.withColumn("location", loc).withColumn("location_warnings", warn).select(*df.columns, "location", "location_warnings")


def cut_spans(text: Column, spans: Column) -> Column:
    """Spans cut out from right to left, edge punctuation trimmed, spaces compacted."""
    right_first = F.reverse(F.array_sort(spans))
    cut = F.aggregate(right_first, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit(" "), F.substring(t, s["end"] + 1, F.length(t))))
    return tx.compact_spaces(F.regexp_replace(cut, r"(?U)^[\s,;:.-]+|[\s,;:.-]+$", ""))


def enrich(df: DataFrame, gazetteer: Gazetteer, text: str = "raw_text", customer: str | None = "customer_id", city: str | None = "city", province: str | None = "province", **options) -> DataFrame:
    """Customer, location, clean text and merged warnings of every review, in one narrow pass."""
    c = resolve_customer(F.col(text), F.col(customer) if customer else None)
    x = resolve_locations(df.withColumn("customer", c), gazetteer, text, city, province, **options)
    from_text = (F.col("location.status") == "resolved") & F.col("location.source").isin("review_text", "fuzzy_review_text") & F.col("location.start").isNotNull()
    spans = F.when(from_text, F.concat("customer.spans", F.array(F.struct(F.col("location.start").alias("start"), F.col("location.end").alias("end"))))).otherwise(F.col("customer.spans"))
    return x.withColumns({
        "clean_review": cut_spans(F.col(text), spans), "warnings": F.array_distinct(F.concat("customer.warnings", "location_warnings"))}).drop("location_warnings")
