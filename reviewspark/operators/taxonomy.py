"""Category rules as row expressions: keyword scoring, head overrides, label harmonisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark import lexicons as lx
from reviewspark.functions import text as tx
from reviewspark.scale import let, small


def map_category(aspect: Column, context: Column, domain_hint: Column | None = None, rules: Sequence[tuple] | None = None) -> Column:
    """Aspect-first keyword scoring.

    Returns struct(taxonomy_id, label, domain, confidence, method, evidence).
    Every keyword is one ``contains`` inside the row, so there is neither a
    join nor a row per (aspect, rule).
    """
    table = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(t).alias("t"), F.lit(d).alias("d"), F.lit(name).alias("n"),
                 F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(min(len(k.split()), 4)).alias("w")) for k in keys]).alias("keys"))
        for i, (t, d, name, keys) in enumerate(rules or lx.TAXONOMY_RULES)
    ])
    hint = F.coalesce(domain_hint, F.lit("")) if domain_hint is not None else F.lit("")
    inputs = F.struct(F.lower(F.coalesce(aspect, F.lit(""))).alias("a"), F.lower(F.coalesce(context, F.lit(""))).alias("c"), hint.alias("h"))

    def score(r, v):
        hits = F.struct(F.filter(r["keys"], lambda x: F.contains(v["a"], x["k"])).alias("a"), F.filter(r["keys"], lambda x: F.contains(v["c"], x["k"])).alias("c"))

        def row(m):
            total = (
                F.aggregate(m["a"], F.lit(0.0), lambda s, x: s + 4.0 + x["w"] * 0.35) + F.aggregate(m["c"], F.lit(0.0), lambda s, x: s + 0.35 + x["w"] * 0.05)
                + F.when(v["h"] == r["d"], 0.8).otherwise(0.0))
            words = F.transform(F.concat(m["a"], m["c"]), lambda x: x["k"])
            return F.when((F.size(m["a"]) > 0) | (F.size(m["c"]) > 0), F.struct(
                (F.size(m["a"]) > 0).alias("on_aspect"), F.round(total, 9).alias("score"), (r["d"] != "generic").alias("specific"),
                F.array_max(F.transform(words, lambda k: F.length(k))).alias("longest"), (-r["i"]).alias("order"), r["t"].alias("taxonomy_id"),
                r["n"].alias("label"), r["d"].alias("domain"), F.size(m["a"]).alias("na"), F.size(m["c"]).alias("nc"), F.slice(words, 1, 8).alias("evidence")))

        return let(hits, row)

    def result(v):
        best_of = F.array_max(F.filter(F.transform(table, lambda r: score(r, v)), lambda r: r.isNotNull()))

        def shape(best):
            conf = F.least(F.lit(0.93), 0.56 + 0.1 * best["na"] + 0.03 * best["nc"] + F.when(v["h"] == best["domain"], 0.04).otherwise(0.0))
            return F.struct(
                F.coalesce(best["taxonomy_id"], F.lit("generic.other")).alias("taxonomy_id"), F.coalesce(best["label"], F.lit("other")).alias("label"),
                F.coalesce(best["domain"], F.when(v["h"] != "", v["h"]), F.lit("generic")).alias("domain"),
                F.when(best.isNull(), 0.0).otherwise(F.round(conf, 4)).alias("confidence"),
                F.when(best.isNull(), "heuristic_no_match").otherwise("heuristic_aspect_first").alias("method"),
                F.coalesce(best["evidence"], F.array().cast("array<string>")).alias("evidence"))

        return let(best_of, shape)

    return let(inputs, result)


def map_category_with_heads(aspect: Column, context: Column, domain_hint: Column | None = None, rules=None) -> Column:
    """Head rules (price, prayer room, service speed, service plus wait) before keyword scoring."""
    low = F.lower(F.coalesce(aspect, F.lit("")))

    def fixed(tid, label, conf, method, evidence):
        return F.struct(
            F.lit(tid).alias("taxonomy_id"), F.lit(label).alias("label"), F.lit("generic").alias("domain"), F.lit(conf).alias("confidence"),
            F.lit(method).alias("method"), F.array(*[F.lit(e) for e in evidence]).alias("evidence"))

    return (
        F.when(low.rlike("(?Ui)" + lx.PRICE_HEAD), fixed("generic.price_value", "Price & Value", 0.93, "heuristic_head_precedence", ["price_head"]))
        .when(low.rlike("(?Ui)" + lx.PRAYER_HEAD), fixed("generic.prayer_room", "Prayer Room / Facilities", 0.93, "heuristic_head_precedence", ["prayer_room_head"]))
        .when(low.rlike(r"(?Ui)\bservice\s*speed\b"), fixed("generic.service_speed", "Service Speed", 0.93, "heuristic_head_precedence", ["service_speed_head"]))
        .when(low.rlike("(?Ui)" + lx.SERVICE_ASPECT) & F.coalesce(context, F.lit("")).rlike("(?Ui)" + lx.WAIT_EVIDENCE),
              fixed("generic.service_speed", "Service Speed", 0.86, "heuristic_contextual_speed", ["service_aspect", "waiting_evidence"]))
        .otherwise(map_category(aspect, context, domain_hint, rules))
    )


def canonical_category(raw: Column, aspect: Column, rules=None) -> Column:
    """A source's own category name to one of the 18 categories, by ordered patterns."""
    low = F.translate(F.lower(F.coalesce(raw, F.lit(""))), "_#", "  ")
    both = F.concat_ws(" ", low, F.lower(F.coalesce(aspect, F.lit(""))))
    out = None
    for scope, pattern, label in rules or lx.SOURCE_CATEGORY_RULES:
        cond = (low if scope == "raw" else both).rlike("(?U)" + pattern)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise("Other")


def fallback_category(aspect: Column, context: Column, rules=None) -> Column:
    """Keyword chain over aspect and context; ``Overall Experience`` if nothing fits."""
    low = F.lower(F.coalesce(aspect, F.lit("")))
    both = F.concat_ws(" ", low, F.lower(F.coalesce(context, F.lit(""))))
    out = None
    for scope, words, inner, inner_label, label in rules or lx.FALLBACK_CATEGORY_RULES:
        cond = tx.any_contains(low if scope == "aspect" else both, words)
        value = F.when(tx.any_contains(low, inner), inner_label).otherwise(label) if inner else F.lit(label)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise("Overall Experience")


def correct_category(aspect: Column, opinion: Column, predicted: Column) -> Column:
    """Post-prediction correction from the aspect and opinion surfaces."""
    a, o = F.lower(aspect), F.lower(F.coalesce(opinion, F.lit("")))
    both = F.concat_ws(" ", a, o)
    return (
        F.when(both.rlike(r"(?U)\b(musholla|mushola|musala|masjid)\b"), "Prayer Room / Facilities")
        .when(a.rlike(r"(?U)\b(harga|biaya|tarif|price)\b"), "Price & Value")
        .when(both.rlike(r"(?U)\b(antrean|antrian|nunggu|menunggu|waktu tunggu)\b"), "Waiting Time")
        .when(o.rlike(r"(?U)\b(lama|lambat|cepat|terlambat|delay)\b") & a.rlike(r"(?U)\b(pelayanan|layanan|proses|service|servis|pesanan|order)\b"), "Service Speed")
        .otherwise(predicted)
    )


def hierarchical_issue(scores: DataFrame, allowed: DataFrame, keys: Sequence[str], unsupported: Sequence[str] = (), policy: str = "best_effort", floor: float = 0.6) -> DataFrame:
    """Best allowed issue per tuple from a scored table (domain, entity, entity_confidence, issue, logit).

    ``allowed`` lists (domain, entity, issue); an entity without a list allows
    everything.  The probability is a softmax over the allowed issues.  The
    strict policy abstains on low confidence or diagnostic-only labels.
    """
    listed = small(allowed.select("domain", "entity").distinct().withColumn("_listed", F.lit(True)))
    ok = small(allowed.select("domain", "entity", "issue").distinct().withColumn("_ok", F.lit(True)))
    open_ = scores.join(listed, ["domain", "entity"], "left").join(ok, ["domain", "entity", "issue"], "left").where("_listed is null or _ok is not null")
    best = open_.groupBy(*keys, "domain", "entity").agg(
        F.max(F.struct(F.col("logit"), F.col("issue"))).alias("top"), F.max("logit").alias("m"), F.first("entity_confidence").alias("entity_confidence"),
        F.collect_list("logit").alias("all_"))
    total = F.aggregate(F.array_sort("all_"), F.lit(0.0), lambda s, x: s + F.exp(x - F.col("m")))
    out = best.select(*keys, "domain", "entity", F.col("top.issue").alias("_issue"), F.least(F.col("entity_confidence"), 1 / total).alias("taxonomy_confidence"))
    low = F.col("taxonomy_confidence") < floor
    odd = F.col("entity").isin(*unsupported) | F.col("_issue").isin(*unsupported) if unsupported else F.lit(False)
    out = out.withColumns({"taxonomy_low_confidence": low, "taxonomy_unsupported_label": odd, "taxonomy_abstained": F.lit(policy == "strict") & (low | odd)})
    return out.withColumns({
        "issue_id": F.when(F.col("taxonomy_abstained"), "ABSTAIN").otherwise(F.col("_issue")),
        "taxonomy": F.when(F.col("taxonomy_abstained"), "OTHER#ABSTAIN").otherwise(F.concat_ws("#", "entity", "_issue")), "taxonomy_policy": F.lit(policy),
    }).drop("_issue")


def evaluation_key(taxonomy_id: Column, label: Column, aliases=None) -> Column:
    """Harmonised key for comparing categories named under different schemas."""
    table = lx.literal_map(aliases or lx.TAXONOMY_ALIASES)
    low = tx.collapse_ws(F.lower(label))
    tid = F.lower(F.trim(F.coalesce(taxonomy_id, F.lit(""))))
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, tid), tid)


def category_examples(records: DataFrame, splits: Sequence[str], unseen: str = "sight") -> DataFrame:
    """Marked training examples for the category classifier."""
    rows = records.where(F.col("split").isin(*splits) & ((F.lower("domain") != unseen) | (F.col("split") == "unseen_test")))
    ex = rows.select("id", "text", "split", "domain", "language", "source_dataset", F.explode("annotations").alias("a")).where(
        F.col("a.aspect_start").isNotNull() & (F.coalesce("a.aspect_category", F.lit("")) != ""))
    return ex.select(
        F.col("id").alias("record_id"), "split", "domain", "language", "source_dataset",
        tx.mark_pair(F.col("text"), F.col("a.aspect_start"), F.col("a.aspect_end")).alias("text"),
        canonical_category(F.col("a.aspect_category"), F.col("a.aspect_term")).alias("label_name"), F.coalesce("a.sample_weight", F.lit(1.0)).alias("sample_weight"),
    ).where("text is not null")


def choose_category(learned: Column, learned_confidence: Column, rule: Column, floor: float = 0.55) -> Column:
    """The classifier's label above the floor, else the rule's."""
    return F.when(learned_confidence >= floor, learned).otherwise(rule)
