"""Aspect-opinion pairs: candidates, decoding, confidence, aliases, relation training pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewspark import lexicons as lx
from reviewspark.functions import text as tx
from reviewspark.functions.spans import find_spans, gap_text, overlaps
from reviewspark.operators.spans import head_key
from reviewspark.scale import computed, let, lower_bound

WHITESPACE = " \t\n\r\x0b\x0c"
#: Characters read before a span.
NEAR = 160
COORDINATORS = ["dan", "and", "serta", "&", "と", "و"]


def coordination_window(text: Column, start: Column, words: Sequence[str] = tuple(COORDINATORS)) -> Column:
    """Where an earlier aspect must end to be coordinated with one that starts here: struct(lo, hi).

    Reads backwards from the aspect, so a long review is not scanned per span; only behind a very long
    run of blanks all of the text before it.
    """
    longest = max(map(len, words))

    def of(v):
        before, from_ = v["before"], v["from"]
        out = None
        for w in words:
            hi = F.length(before) - len(w)
            lo = F.length(F.rtrim(F.substring(before, F.lit(1), hi), F.lit(WHITESPACE)))
            value = F.struct((from_ + lo).alias("lo"), (from_ + hi).alias("hi"))
            out = F.when(v["low"].endswith(w), value) if out is None else out.when(v["low"].endswith(w), value)
        return out

    def read(from_):
        before = F.rtrim(F.substring(text, from_ + 1, start - from_), F.lit(WHITESPACE))
        # only the end is compared with the words
        return let(before, lambda b: F.struct(b.alias("before"), F.lower(F.right(b, F.lit(longest))).alias("low"), from_.alias("from")))

    near = let(F.greatest(F.lit(0), start - NEAR), read)
    # what is left must show the coordinator and something before it
    short = let(near, lambda v: F.when((v["from"] == 0) | (F.length(F.rtrim(F.substring(v["before"], F.lit(1), F.length(v["before"]) - longest), F.lit(WHITESPACE))) > 0), v).otherwise(
        let(F.lit(0), read)))
    return let(short, of)


def coordinated(a_start: Column, a_end: Column, a_win: Column, b_start: Column, b_end: Column, b_win: Column) -> Column:
    """Only a coordinator lies between the two aspects, whichever comes first."""
    right_b = (a_start <= b_start) & b_win.isNotNull() & a_end.between(b_win["lo"], b_win["hi"])
    right_a = (b_start <= a_start) & a_win.isNotNull() & b_end.between(a_win["lo"], a_win["hi"])
    return F.coalesce(right_b, F.lit(False)) | F.coalesce(right_a, F.lit(False))


def windows(low: Column, high: Column, points: Column) -> Column:
    """For each i the points between ``low[i]`` and ``high[i]``: array<struct<at,n>>, the first one's place and their number.

    ``points`` ascend; two binary searches per i.
    """
    return let(points, lambda p: F.zip_with(low, high, lambda a, b: let(lower_bound(p, a), lambda at: F.struct(
        at.alias("at"), F.greatest(F.lit(0), lower_bound(p, b + 1) - at).alias("n")))))


def by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["end"] - y["end"]).cast("int"))


def candidate_pairs(docs: DataFrame, key: str = "doc_id", threshold: float = 0.1, barrier: str = lx.PAIR_BARRIER, budget: int | None = None,
                    coordinators: Sequence[str] = tuple(COORDINATORS), negation: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, per-review diagnostics) from rows with text, aspects[], opinions[].

    The heuristic strength is .5 / (1 + distance / 100), so a pair below the threshold can be ruled out by
    distance alone. Both lists are sorted by offset, a binary search gives the opinions within reach of every
    aspect, and only these are paired. Barriers are found once per review: behind every span the next one, so
    that a pair is blocked if the next barrier behind its first span ends before its second. Texts are read once
    per span. ``budget`` keeps the nearest pairs of a review and reports how many were skipped.
    """
    reach = int(round(100 * (0.5 / threshold - 1) + 1e-9))
    text = F.col("text")
    pattern = "(?Ui)" + barrier
    bound, words = negation or (lx.NEGATION_BOUNDARY, lx.NEGATION_WORDS)

    def around(s, fn):
        """The span's text with a character on either side, read once."""
        return let(F.substring(text, F.greatest(s["start"], F.lit(1)), s["end"] - F.greatest(s["start"], F.lit(1)) + 2), fn)

    def read(v, spans, extra):
        """Spans with the end of the next barrier and what is read from the text around them."""
        # an offset is cut if it is inside a word, where a pattern sees another word end than in the gap alone
        return F.transform(spans, lambda s: around(s, lambda t: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s.alias("span"), F.substring(t, F.when(s["start"] > 0, F.lit(2)).otherwise(F.lit(1)), s["end"] - s["start"]).alias("term"),
            F.get(v["barriers"], lower_bound(v["starts"], s["end"]))["end"].alias("barrier"),
            ((F.length(t) > s["end"] - F.greatest(s["start"], F.lit(1)) + 1) & t.rlike(r"(?U)\w\w\z")).alias("cut_end"),
            ((s["start"] > 0) & t.rlike(r"(?U)\A\w\w")).alias("cut_start"), *extra(s))))

    def pair(a, o):
        first = a["end"] <= o["start"]
        next_ = F.when(first, a["barrier"]).otherwise(o["barrier"])
        seam = F.when(first, a["cut_end"] | o["cut_start"]).otherwise(o["cut_end"] | a["cut_start"])
        apart = ~overlaps(a["start"], a["end"], o["start"], o["end"])
        blocked = F.when(seam, gap_text(text, a["start"], a["end"], o["start"], o["end"]).rlike(pattern)).otherwise(
            F.coalesce(next_ <= F.when(first, o["start"]).otherwise(a["start"]), F.lit(False)))
        return F.struct(F.abs(a["start"] - o["start"]).alias("distance"), a.alias("a"), o.alias("o"), (~apart).alias("overlap"), (apart & blocked).alias("blocked"))

    def near(v):
        return windows(F.transform(v["aspects"], lambda s: s["start"] - reach), F.transform(v["aspects"], lambda s: s["start"] + reach), F.transform(v["opinions"], lambda s: s["start"]))

    # every step is bound to a lambda variable: a column that is used inside a lambda would be evaluated again for each element
    pairs = let(find_spans(text, pattern), lambda m: let(F.struct(
        by_start(F.col("aspects")).alias("aspects"), by_start(F.col("opinions")).alias("opinions"), m.alias("barriers"), F.transform(m, lambda x: x["start"]).alias("starts")),
        lambda v: let(F.struct(
            read(v, v["aspects"], lambda s: [coordination_window(text, s["start"], coordinators).alias("coord")]).alias("as"),
            read(v, v["opinions"], lambda s: [tx.negation_scope(text, s["start"], s["end"], bound, words).alias("negation")]).alias("os"), near(v).alias("near")),
            lambda w: F.flatten(F.zip_with(w["as"], w["near"], lambda a, n: F.transform(F.slice(w["os"], n["at"] + 1, n["n"]), lambda o: pair(a, o)))))))
    if budget is not None:
        pairs = F.slice(F.transform(F.array_sort(F.transform(pairs, lambda p: F.struct(
            p["distance"].alias("d"), p["a"]["start"].alias("s1"), p["a"]["end"].alias("e1"), p["o"]["start"].alias("s2"), p["o"]["end"].alias("e2"), p.alias("p")))), lambda r: r["p"]), 1, budget)
    found = computed(docs.where((F.size("aspects") > 0) & (F.size("opinions") > 0)).select(
        key, "text", "aspects", "opinions", (F.size("aspects").cast("bigint") * F.size("opinions")).alias("proposed")), {"_pairs": pairs})
    skipped = F.lit(0).cast("bigint") if budget is None else F.greatest(F.lit(0).cast("bigint"), F.col("proposed") - budget)
    diagnostics = found.select(
        key, F.col("proposed").alias("candidate_pairs"), skipped.alias("skipped_pairs"),
        F.size(F.filter("_pairs", lambda p: p["overlap"])).alias("overlap_rejected"), F.size(F.filter("_pairs", lambda p: p["blocked"])).alias("blocked_pairs"))
    ex = found.select(key, F.explode("_pairs").alias("p")).where("not p.overlap and not p.blocked").select(
        key, "p.distance", F.col("p.a.span").alias("aspect"), F.col("p.o.span").alias("opinion"), F.col("p.a.coord").alias("coord"),
        F.col("p.o.negation").alias("negation"), F.col("p.a.term").alias("aspect_term"), F.col("p.o.term").alias("opinion_term"))
    return ex.withColumn("score", F.lit(0.5) / (1 + F.col("distance") / 100)), diagnostics


def decode_pairs(pairs: DataFrame, key: str = "doc_id", threshold: float = 0.5, max_opinions: int = 8, sharing: float = 0.90, margin: float = 0.05) -> DataFrame:
    """Opinion-level competition with an outcome per pair.

    ``outcome`` is kept, competing_aspect or max_opinions_per_aspect.  The best
    aspect of an opinion wins; coordinated and confidently shared aspects stay.
    ``ambiguous_binding`` marks near ties.  All windows run inside one review.
    """
    a, o = F.col("aspect"), F.col("opinion")
    # one exchange by review serves every window
    base = pairs.where(F.col("score") >= threshold).repartition(F.col(key))
    by_op = W.partitionBy(key, "opinion.start", "opinion.end").orderBy(F.col("score").desc(), "aspect.start", "aspect.end")
    whole = W.partitionBy(key, "opinion.start", "opinion.end")
    x = base.withColumn("_rn", F.row_number().over(by_op)).withColumn("_best", F.first(F.struct("score", "aspect", "coord")).over(by_op))
    x = x.withColumn("_coord", coordinated(a["start"], a["end"], F.col("coord"), F.col("_best.aspect.start"), F.col("_best.aspect.end"), F.col("_best.coord")))
    rival = (F.col("_rn") > 1) & ~F.col("_coord") & (F.col("_best.score") - F.col("score") < margin)
    x = x.withColumn("_rivals", F.sum(rival.cast("int")).over(whole))
    shared = (F.col("score") >= sharing) & (F.col("_best.score") - F.col("score") <= margin)
    best = F.col("_rn") == 1
    keep = best | F.col("_coord") | shared
    x = x.withColumns({
        "_keep": keep, "shared_opinion": ~best & keep,
        "ambiguous_binding": F.when(best, F.col("_rivals") > 0).otherwise(keep & ~F.col("_coord")),
    })
    by_aspect = W.partitionBy(key, "aspect.start", "aspect.end", "_keep").orderBy(F.col("score").desc(), "opinion.start", "opinion.end")
    x = x.withColumn("_slot", F.row_number().over(by_aspect))
    outcome = F.when(~F.col("_keep"), "competing_aspect").when(F.col("_slot") > max_opinions, "max_opinions_per_aspect").otherwise("kept")
    return x.withColumn("outcome", outcome).drop("_rn", "_best", "_coord", "_rivals", "_keep", "_slot")


def aspect_only(docs: DataFrame, kept: DataFrame, key: str = "doc_id") -> DataFrame:
    """Aspects that no pair uses, as review items without an opinion."""
    every = docs.select(key, "text", F.explode("aspects").alias("aspect")).select(
        key, "aspect", F.substring(F.col("text"), F.col("aspect.start") + 1, F.col("aspect.end") - F.col("aspect.start")).alias("aspect_term"))
    used = kept.select(key, F.col("aspect.start").alias("_s"), F.col("aspect.end").alias("_e")).distinct()
    e = every.withColumns({"_s": F.col("aspect.start"), "_e": F.col("aspect.end")})
    return e.join(used, [key, "_s", "_e"], "left_anti").drop("_s", "_e")


def nearest_opinions(text: Column, aspects: Column, opinions: Column, k: int = 1, reach: int = 90) -> Column:
    """Per aspect the ``k`` nearest opinions of the same sentence: array<struct<aspect, opinions>>.

    Only opinions whose offsets can be within reach are looked at.
    """
    longest = F.coalesce(F.array_max(F.transform(opinions, lambda o: o["end"] - o["start"])), F.lit(0))

    def of(ordered, a, w):
        bounds = F.struct(tx.sentence_left(text, a["start"]).alias("left"), tx.sentence_right(text, a["end"]).alias("right"))

        def near(v):
            inside = F.filter(F.slice(ordered, w["at"] + 1, w["n"]), lambda o: (o["start"] >= v["left"]) & (o["end"] <= v["right"]))
            dist = F.transform(inside, lambda o: F.struct(
                F.when(o["end"] <= a["start"], a["start"] - o["end"]).when(o["start"] >= a["end"], o["start"] - a["end"]).otherwise(0).alias("distance"),
                (-o["score"]).alias("s"), o["start"].alias("p"), o.alias("o")))
            best = F.slice(F.array_sort(F.filter(dist, lambda d: d["distance"] <= reach)), 1, k)
            return F.struct(a.alias("aspect"), F.transform(best, lambda d: F.struct(d["distance"].alias("distance"), d["o"].alias("opinion"))).alias("opinions"))

        return let(bounds, near)

    def every(v):
        found = windows(
            F.transform(aspects, lambda a: a["start"] - reach - v["longest"]), F.transform(aspects, lambda a: a["end"] + reach), F.transform(v["ordered"], lambda o: o["start"]))
        return F.zip_with(aspects, found, lambda a, w: of(v["ordered"], a, w))

    return let(F.struct(by_start(opinions).alias("ordered"), longest.alias("longest")), every)


def top_opinions(pairs: DataFrame, scores: DataFrame | None, key: str = "doc_id", k: int = 3, threshold: float = 0.5) -> DataFrame:
    """Best ``k`` opinions per aspect: by relation probability where a scored table has one, else by distance."""
    x = pairs
    if scores is not None:
        x = x.join(scores.select(key, "aspect_start", "opinion_start", "probability"), [key, "aspect_start", "opinion_start"], "left")
    else:
        x = x.withColumn("probability", F.lit(None).cast("double"))
    x = x.where("probability is null or probability >= %s" % threshold)
    rank = W.partitionBy(key, "aspect_start").orderBy(F.coalesce(-F.col("probability"), F.lit(0.0)), "distance", F.col("opinion_score").desc(), "opinion_start")
    return x.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def pair_features(text: Column, a_s: Column, a_e: Column, o_s: Column, o_e: Column) -> Column:
    """Eight features as an array: distance, same sentence, same clause, negation, contrast, reserved, id, en."""
    left, right = F.least(a_s, o_s), F.greatest(a_e, o_e)
    hull = F.substring(text, left + 1, right - left)
    low = F.lower(hull)

    def flag(c):
        return c.cast("double")

    return F.array(
        F.least(F.lit(1.0), F.abs(a_s - o_s) / F.greatest(F.lit(1), F.length(text))),
        flag(tx.sentence_index(text, a_s) == tx.sentence_index(text, o_s)), flag(tx.clause_index(text, a_s) == tx.clause_index(text, o_s)),
        flag(hull.rlike("(?Ui)" + lx.FEATURE_NEGATION)), flag(hull.rlike("(?Ui)" + lx.FEATURE_CONTRAST)), F.lit(0.0),
        flag(low.rlike("(?U)" + lx.FEATURE_ID)), flag(low.rlike("(?U)" + lx.FEATURE_EN)),
    )


def alias_terms(aspects: Column, reach: int = 420) -> Column:
    """For each aspect (term, start) the distinct surfaces of the same head within reach, nearest text first."""
    def of(keyed):
        near = windows(F.transform(keyed, lambda a: a["s"] - reach), F.transform(keyed, lambda a: a["s"] + reach), F.transform(keyed, lambda a: a["s"]))
        return F.zip_with(keyed, near, lambda a, w: F.struct(
            a["t"].alias("term"), a["s"].alias("start"),
            F.array_distinct(F.transform(F.filter(F.slice(keyed, w["at"] + 1, w["n"]), lambda b: b["h"] == a["h"]), lambda b: b["t"])).alias("alias_terms")))

    return let(F.array_sort(F.transform(aspects, lambda a: F.struct(a["start"].alias("s"), head_key(a["term"]).alias("h"), a["term"].alias("t")))), of)


def consolidate_aliases(items: DataFrame, key: str = "doc_id", reach: int = 420) -> DataFrame:
    """Repeated mentions of one head become one item unless they are far apart.

    Longest surface, best non-neutral sentiment, merged evidence.  Items:
    aspect_term, aspect_start, aspect_end, sentiment, sentiment_confidence,
    aspect_confidence, opinion_evidence[].  Groups are the mentions of one head
    in one review.
    """
    head = head_key(F.col("aspect_term"))
    keyed = items.withColumn("_h", F.when(F.length(head) >= 3, head).otherwise(F.concat(F.lit("__"), F.col("aspect_start").cast("string"))))
    w = W.partitionBy(key, "_h")
    sized = keyed.withColumns({"_n": F.count(F.lit(1)).over(w), "_span": F.max("aspect_start").over(w) - F.min("aspect_start").over(w)})
    merge = (F.col("_n") > 1) & (F.col("_span") <= reach)
    single = sized.where(~merge).drop("_h", "_n", "_span").withColumns({"alias_terms": F.array("aspect_term"), "alias_consolidated": F.lit(False)})
    order = F.struct(F.col("aspect_start") - F.col("aspect_end"), F.col("aspect_start"))
    polar = F.col("sentiment").isin("positive", "negative")
    rank = F.when(polar, F.struct(-F.col("sentiment_confidence"), F.col("aspect_start")))
    group = sized.where(merge).groupBy(key, "_h").agg(
        F.min_by(F.struct("aspect_term", "aspect_start", "aspect_end", "sentiment", "sentiment_confidence"), order).alias("c"),
        F.min_by(F.when(polar, F.struct("sentiment", "sentiment_confidence")), rank).alias("p"), F.max("aspect_confidence").alias("aspect_confidence"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("aspect_start", "opinion_evidence"))), lambda x: x["opinion_evidence"]))).alias("opinion_evidence"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("aspect_start", "aspect_term"))), lambda x: x["aspect_term"])).alias("alias_terms"),
    ).select(
        key, "c.aspect_term", "c.aspect_start", "c.aspect_end", F.coalesce("p.sentiment", "c.sentiment").alias("sentiment"),
        F.coalesce("p.sentiment_confidence", "c.sentiment_confidence").alias("sentiment_confidence"), "aspect_confidence", "opinion_evidence", "alias_terms",
        F.lit(True).alias("alias_consolidated"))
    return single.select(*group.columns).unionByName(group)


def route_tuples(tuples: DataFrame, auto_accept: float = 0.90, category_floor: float = 0.60, relation_validated: bool = False) -> DataFrame:
    """overall_confidence, review_reasons and needs_human_review of scored tuples.

    Confidence is the least of aspect, opinion, pair and sentiment confidence;
    every doubt is a named reason and any reason sends the tuple to a human.
    """
    conf = F.least("aspect_confidence", "opinion_confidence", "pair_score", "sentiment_confidence")
    heuristic = F.coalesce("heuristic", F.lit(True))
    calibrated = F.coalesce("confidence_is_calibrated", F.lit(False)) & ~heuristic
    t = tuples.withColumn("overall_confidence", conf).withColumn("confidence_is_calibrated", calibrated)
    reasons = F.array(
        F.when(heuristic, "heuristic_or_lexicon_evidence"), F.when(~F.col("confidence_is_calibrated"), "tuple_confidence_not_calibrated"),
        F.when(F.lit(not relation_validated), "relation_not_human_validated"), F.when(F.coalesce("ambiguous_binding", F.lit(False)), "ambiguous_binding"),
        F.when(F.col("overall_confidence") < auto_accept, "low_tuple_confidence"),
        F.when((F.coalesce("category", F.lit("Other")) == "Other") | (F.col("taxonomy_confidence") < category_floor), "taxonomy_needs_review"),
        F.when(F.coalesce("skipped_pairs", F.lit(0)) > 0, "incomplete_candidate_processing"),
    )
    t = t.withColumn("review_reasons", F.filter(reasons, lambda r: r.isNotNull()))
    return t.withColumn("needs_human_review", F.size("review_reasons") > 0)


def queue_by_rules(tuples: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Plain routing: low confidence, heuristic pairing or no category."""
    return tuples.withColumn(
        "needs_human_review",
        (F.col("confidence") < threshold) | F.contains(F.lower("relation_method"), F.lit("heuristic")) | (F.col("taxonomy_id") == "generic.other"))


def _pair(a: Column) -> Column:
    return F.struct(a["aspect_start"].alias("as"), a["aspect_end"].alias("ae"), a["opinion_start"].alias("os"), a["opinion_end"].alias("oe"))


def _positives(records_annotations="annotations") -> Column:
    explicit = F.filter(records_annotations, lambda a: a["aspect_start"].isNotNull() & a["opinion_start"].isNotNull() & F.coalesce(a["relation"], F.lit(True)))
    return F.array_sort(F.array_distinct(F.transform(explicit, _pair)))


def _crossed(positives: Column, allowed=None) -> Column:
    """Every aspect with every opinion that is not its own, of those for which ``allowed(aspect)`` gives a test that holds.

    An aspect's own opinions are looked up once per aspect: an array of structs would be compared pair by pair.
    """
    def cross(own, a, opinions):
        def pairs(test):
            kept = F.filter(opinions, lambda o: test(o) & ~F.exists(own, lambda q: q["os"].eqNullSafe(o["os"]) & q["oe"].eqNullSafe(o["oe"])))
            return F.transform(kept, lambda o: F.struct(a["as"].alias("as"), a["ae"].alias("ae"), o["os"].alias("os"), o["oe"].alias("oe")))

        return allowed(a, pairs) if allowed else pairs(lambda o: F.lit(True))

    def of(v):
        return F.flatten(F.transform(v["aspects"], lambda a: let(
            F.filter(v["positives"], lambda p: p["as"].eqNullSafe(a["as"]) & p["ae"].eqNullSafe(a["ae"])), lambda own: cross(own, a, v["opinions"]))))

    return let(positives, lambda ps: let(F.struct(
        F.array_distinct(F.transform(ps, lambda p: F.struct(p["as"].alias("as"), p["ae"].alias("ae")))).alias("aspects"),
        F.array_distinct(F.transform(ps, lambda p: F.struct(p["os"].alias("os"), p["oe"].alias("oe")))).alias("opinions"), ps.alias("positives")), of))


def safe_relation_pairs(records: DataFrame, explicit: DataFrame | None = None, negatives_per_positive: int = 2) -> tuple[DataFrame, DataFrame]:
    """(relation training pairs, issues).

    Annotated pairs are positives.  Cross pairs become negatives only in
    human-approved, complete, natural records, nearest first and in training
    at most two per positive.  Explicit rows add to them; an explicit negative
    on a record nobody reviewed, or one that contradicts a positive, is an issue.
    """
    human = F.coalesce("human_approved", F.lit(False)) & ~F.coalesce("is_synthetic", F.lit(False))
    complete = human & F.coalesce("annotation_complete", F.lit(False))
    base = computed(records.select("id", "text", "split", "place_id", "family_id", "source_dataset", "sample_weight", complete.alias("human_gold"), human.alias("_human"),
                                   F.coalesce("is_synthetic", F.lit(False)).alias("_syn"), "annotations"), {"_pos": _positives()}).drop("annotations")
    near = F.array_sort(F.transform(_crossed(F.col("_pos")), lambda p: F.struct(
        F.least(F.abs(p["as"] - p["oe"]), F.abs(p["os"] - p["ae"])).alias("d"), p.alias("p"))))
    cap = F.lit(negatives_per_positive) * F.greatest(F.lit(1), F.size("_pos"))
    negatives = F.transform(F.when(F.col("split") == "train", F.slice(near, F.lit(1), cap)).otherwise(near), lambda x: x["p"])
    meta = ["id", "text", "split", "place_id", "family_id", "source_dataset", "human_gold", "sample_weight"]
    pos = base.select(*meta, F.explode("_pos").alias("p"), F.lit(1).alias("label"), F.lit("canonical_positive").alias("relation_source"))
    neg = computed(base.where("human_gold"), {"_neg": negatives}).select(*meta, F.explode("_neg").alias("p"), F.lit(0).alias("label"), F.lit("derived_human_complete").alias("relation_source"))
    derived = pos.unionByName(neg)
    issues = records.sparkSession.createDataFrame([], "id string, issue string")
    if explicit is not None:
        e = explicit.select(F.col("record_id").alias("id"), F.struct(
            F.col("aspect_start").alias("as"), F.col("aspect_end").alias("ae"), F.col("opinion_start").alias("os"), F.col("opinion_end").alias("oe")).alias("p"),
            F.col("label").cast("int").alias("label"), F.coalesce("source", F.lit("explicit_relation_table")).alias("relation_source"), F.col("sample_weight").alias("_w"))
        j = e.join(base.drop("_pos"), "id")
        positive = pos.select("id", "p", F.lit(True).alias("_is_pos"))
        j = j.join(positive, ["id", "p"], "left")
        unsafe = (F.col("label") == 0) & ~(F.col("_syn") | F.col("_human"))
        clash = (F.col("label") == 0) & F.coalesce("_is_pos", F.lit(False))
        issues = j.where(unsafe).select("id", F.lit("negative_on_unreviewed_record").alias("issue")).union(j.where(clash).select("id", F.lit("contradicts_annotation").alias("issue")))
        fine = j.where(~unsafe & ~clash).withColumn("sample_weight", F.coalesce("_w", "sample_weight")).select(*meta, "p", "label", "relation_source").dropDuplicates(["id", "p"])
        derived = derived.join(fine.select("id", "p"), ["id", "p"], "left_anti").unionByName(fine)
    return derived.select("id", "text", "p.*", "label", "split", "place_id", "family_id", "source_dataset", "relation_source", "human_gold", "sample_weight").withColumnsRenamed(
        {"as": "aspect_start", "ae": "aspect_end", "os": "opinion_start", "oe": "opinion_end"}), issues


def gold_relation_examples(records: DataFrame) -> DataFrame:
    """Marked gold pairs; cross pairs inside the aspect's sentence are the negatives."""
    gold = records.where(F.lower("human_status").isin(lx.PLACE_GOLD_STATUSES) & F.col("annotation_complete"))
    text = F.col("text")
    base = computed(gold.select("id", "text", "split", "place_id", "annotations"), {"_pos": _positives()}).drop("annotations")

    def sentence(a, pairs):
        bounds = F.struct(tx.sentence_left(text, a["as"]).alias("left"), tx.sentence_right(text, a["ae"]).alias("right"))
        return let(bounds, lambda v: pairs(lambda o: (o["os"] >= v["left"]) & (o["oe"] <= v["right"])))

    inside = computed(base, {"_in": _crossed(F.col("_pos"), sentence)})
    rows = base.select("*", F.explode("_pos").alias("p"), F.lit(1).alias("label")).union(inside.select(*base.columns, F.explode("_in").alias("p"), F.lit(0).alias("label")))
    return rows.select(
        F.col("id").alias("record_id"), "split", "place_id", "label", tx.mark_pair(text, F.col("p.as"), F.col("p.ae"), F.col("p.os"), F.col("p.oe")).alias("marked"),
        F.lit(1.0).alias("sample_weight"), F.lit("human_gold").alias("source"))


def auxiliary_relation_examples(records: DataFrame, positive_weight: float, negative_weight: float | None = None) -> DataFrame:
    """Positives of auxiliary records; cross pairs only where the record declares complete hard supervision."""
    text = F.col("text")
    base = records.withColumn("_pos", _positives())
    rows = base.select("id", "text", "split", "place_id", F.explode("_pos").alias("p"), F.lit(1).alias("label"), F.lit(positive_weight).alias("sample_weight"))
    if negative_weight is not None:
        hard = base.where(F.coalesce("annotation_complete", F.lit(False)) & (F.col("difficulty_level") == "hard_multi_aspect"))
        rows = rows.union(hard.select("id", "text", "split", "place_id", F.explode(_crossed(F.col("_pos"))).alias("p"), F.lit(0).alias("label"), F.lit(negative_weight).alias("sample_weight")))
    return rows.select(F.col("id").alias("record_id"), "split", "place_id", "label", "sample_weight",
                       tx.mark_pair(text, F.col("p.as"), F.col("p.ae"), F.col("p.os"), F.col("p.oe")).alias("marked"))


def unsafe_negatives(examples: DataFrame, source: str = "source") -> DataFrame:
    """Must be empty: machine-labelled sources never teach negatives."""
    return examples.where((F.col("label") == 0) & F.contains(F.lower(F.col(source)), F.lit("silver")))


def decode_joint(scores: DataFrame, keys: Sequence[str], label: str = "label", probability: str = "probability") -> DataFrame:
    """Joint-label table to one row per related pair: best label, relation confidence, sentiment probabilities."""
    g = scores.groupBy(*keys).agg(
        F.max_by(label, F.struct(probability, label)).alias("joint_label"), F.max(probability).alias("joint_confidence"),
        F.max(F.when(F.col(label) == "no_relation", F.col(probability))).alias("_none"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(label) != "no_relation", F.struct(F.replace(F.col(label), F.lit("related_"), F.lit("")), F.col(probability)))))).alias("sentiment_probabilities"))
    return g.where("joint_label <> 'no_relation'").withColumns({
        "sentiment": F.replace(F.col("joint_label"), F.lit("related_"), F.lit("")), "relation_confidence": 1 - F.coalesce("_none", F.lit(0.0))}).drop("_none")


def clean_relations(relations: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relation rows against their records: (clean distinct rows, issues)."""
    labels = lx.literal_map({"0": "0", "1": "1", "not_related": "0", "related": "1", "hard_negative": "0", "false": "0", "true": "1"})
    r = relations.withColumn("_label", F.try_element_at(labels, F.lower(F.col("label").cast("string"))).cast("int"))
    orphan = r.join(records.select(F.col("id").alias("record_id")), "record_id", "left_anti").select("record_id", F.lit("orphan_relation").alias("issue"))
    j = r.join(records.select(F.col("id").alias("record_id"), F.length("text").alias("_n"), F.col("sample_weight").alias("_w")), "record_id")

    def bad(kind):
        s, e = F.col(f"{kind}_start"), F.col(f"{kind}_end")
        return s.isNull() | e.isNull() | ~((s >= 0) & (s < e) & (e <= F.col("_n")))

    problem = F.when(F.col("_label").isNull(), "ambiguous_label").when(bad("aspect") | bad("opinion"), "invalid_relation_offsets")
    j = j.withColumn("_problem", problem)
    sig = ["record_id", "aspect_start", "aspect_end", "opinion_start", "opinion_end"]
    ok = j.where("_problem is null")
    g = ok.groupBy(*sig).agg(F.min("_label").alias("label"), F.max("_label").alias("_hi"), F.min(F.coalesce("sample_weight", "_w")).alias("sample_weight"), F.min("source").alias("source"))
    clash = g.where("label <> _hi").select("record_id", F.lit("contradictory_labels").alias("issue"))
    issues = orphan.union(j.where("_problem is not null").select("record_id", "_problem")).union(clash)
    return g.where("label = _hi").drop("_hi"), issues
