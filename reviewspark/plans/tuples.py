"""Review text to tuples: recovery, merging, pairing, decoding, category, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark import lexicons as lx
from reviewspark.functions import text as tx
from reviewspark.operators import pairing as pr
from reviewspark.operators import sentiment as se
from reviewspark.operators import spans as sp
from reviewspark.operators import taxonomy as ta
from reviewspark.scale import computed
from reviewspark.session import cut_lineage

POLARITY = {"negative_quality": "negative", "waiting": "negative", "duration": "negative", "staff_action": "positive", "free": "positive", "positive": "positive", "neutral": "neutral"}


def _capped(spans: Column, cap: float) -> Column:
    return F.transform(spans, lambda s: sp.make_span(s["start"], s["end"], F.least(s["score"], F.lit(cap)), s["source_view"], F.lit(True), s["family"]))


def recovered_aspects(docs: DataFrame, aspect_patterns=None, heads=None, rules=None, cap: float = 0.60) -> DataFrame:
    """Rows with aspects[] from the lexicons, coordinated aspects split, overlaps merged."""
    text = F.col("text")

    def confidence(surface):
        return F.nullif(ta.map_category(surface, F.lit(""), None, rules)["confidence"], F.lit(0.0))

    found = computed(docs, {"_a": _capped(sp.recover_aspects(text, aspect_patterns, heads), cap)})
    return computed(found, {"aspects": sp.merge_spans(sp.split_coordinated(text, F.col("_a"), confidence))}).drop("_a")


def recovered(docs: DataFrame, aspect_patterns=None, heads=None, opinion_patterns=None, rules=None, cap: float = 0.60) -> DataFrame:
    """Rows with aspects[] and opinions[] from the lexicons, coordinated aspects split, overlaps merged."""
    opinions = sp.merge_spans(_capped(sp.recover_opinions(F.col("text"), opinion_patterns), cap))
    return computed(recovered_aspects(docs, aspect_patterns, heads, rules, cap), {"opinions": opinions})


def review_tuples(docs: DataFrame, key: str = "doc_id", profile: str = "maps_high_recall", budget: int | None = None, rules=None, keep: Sequence[str] = (),
                  negation: tuple[str, str] | None = None, **lexicons) -> DataFrame:
    """Routed tuples (triplets and aspect-only rows) of every review.

    Reviews without text or with reserved markers give no tuple.  Only the pair
    rows of a review are shuffled, never its text.
    """
    text = F.col("text")
    usable = docs.where((F.trim(text) != "") & ~tx.any_contains(text, lx.MARKERS)).select(key, "text", *keep)
    spans = recovered(usable, rules=rules, **lexicons)
    pairs, diag = pr.candidate_pairs(spans, key, 0.1, budget=budget, negation=negation)
    # read for the triplets and for the aspects that are left over
    kept = cut_lineage(pr.decode_pairs(pairs, key, 0.1).where("outcome = 'kept'"))
    polarity = F.try_element_at(lx.literal_map(POLARITY), F.col("opinion.family"))
    flipped = F.when(F.col("negation.negated") & (polarity == "positive"), "negative").otherwise(F.coalesce(polarity, F.lit("neutral")))
    category = F.coalesce(F.col("aspect.family"), ta.map_category(F.col("aspect_term"), F.col("opinion_term"), None, rules)["label"])
    triplets = kept.select(
        key, F.lit("triplet").alias("output_type"), "aspect_term", F.col("aspect.start").alias("aspect_start"), F.col("aspect.end").alias("aspect_end"),
        F.col("aspect.score").alias("aspect_confidence"), "opinion_term", F.col("opinion.start").alias("opinion_start"), F.col("opinion.end").alias("opinion_end"),
        F.col("opinion.score").alias("opinion_confidence"), F.col("score").alias("pair_score"), flipped.alias("sentiment"), F.lit(0.6).alias("sentiment_confidence"),
        ta.correct_category(F.col("aspect_term"), F.col("opinion_term"), category).alias("category"), F.lit(0.6).alias("taxonomy_confidence"),
        "ambiguous_binding", "negation", F.lit(True).alias("heuristic"), F.lit(False).alias("confidence_is_calibrated"), F.lit("heuristic_review_only").alias("relation_method"))
    # without a budget nothing is skipped, and the pairs need not be found again
    counted = triplets.withColumn("skipped_pairs", F.lit(0).cast("bigint")) if budget is None else triplets.join(diag.select(key, "skipped_pairs"), key, "left")
    triplets = pr.route_tuples(counted)
    # opinions are not looked for again
    single = pr.aspect_only(recovered_aspects(usable, rules=rules, **{k: v for k, v in lexicons.items() if k != "opinion_patterns"}), kept, key)
    lone = single.select(
        key, F.lit("aspect_only").alias("output_type"), "aspect_term", F.col("aspect.start").alias("aspect_start"), F.col("aspect.end").alias("aspect_end"),
        F.col("aspect.score").alias("aspect_confidence"), F.coalesce("aspect.family", F.lit("Other")).alias("category"), F.lit("no_valid_pair").alias("relation_method"),
        F.lit(True).alias("needs_human_review"), F.array(F.lit("no_valid_pair")).alias("review_reasons"), F.col("aspect.score").alias("overall_confidence"))
    return triplets.unionByName(lone, allowMissingColumns=True).withColumn("profile", F.lit(profile))


def in_reading_order(tuples: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tuples by review, aspect and opinion offset; aspect-only rows first."""
    return tuples.orderBy(key, "aspect_start", F.coalesce("opinion_start", F.lit(-1)))


def rule_report(docs: DataFrame, group: str, top: int | None = None, key: Column | None = None, **options) -> DataFrame:
    """Rule tuples counted per group, category and sentiment; duplicate texts counted once if ``key`` is given."""
    rows = docs
    if key is not None:
        rows = docs.withColumn("_k", key).groupBy("_k", group).agg(F.min("text").alias("text"))
    tuples = se.analyze_reviews(rows, [group], **options)
    out = tuples.groupBy(group, "category", "sentiment").agg(F.count(F.lit(1)).alias("tuples"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return out.orderBy(F.col("tuples").desc(), group, "category", "sentiment").limit(top) if top else out
