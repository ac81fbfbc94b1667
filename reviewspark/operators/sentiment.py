"""Rule tuples, sentiment guardrails, local contexts and training examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark import lexicons as lx
from reviewspark.functions import text as tx
from reviewspark.functions.spans import find_spans, first_span
from reviewspark.operators.taxonomy import fallback_category
from reviewspark.scale import let

TUPLE = "struct<aspect:string,opinion:string,sentiment:string,category:string,confidence:double,start:int,end:int,method:string>"


def rule_tuples(text: Column, threshold: float = 0.5, rules=None, negations: Sequence[str] | None = None, positives: Sequence[str] | None = None,
                categories=None) -> Column:
    """All rule tuples of a review as an array, or the first/last-word fallback if no rule fires.

    A rule fires on its aspect word; its opinion word raises the confidence from
    .84 to .93.  One tuple per aspect word, the earlier rule first.  A negation
    anywhere in the review turns positive rules negative.
    """
    words: dict[str, list] = {}
    for rule in rules or lx.RULE_TUPLES:
        words.setdefault(rule[0], []).append(rule)
    empty = F.array().cast(f"array<{TUPLE}>")

    def of_review(v):
        t, low, negated = v["t"], v["low"], v["negated"]

        def build(aspect, opinion, sentiment, category):
            def row(m):
                conf = F.when(m["has"], 0.93).otherwise(0.84)
                shown = F.when(m["has"], F.substring(t, F.locate(opinion, low), F.lit(len(opinion)))).otherwise(opinion)
                polarity = F.when(negated, "negative").otherwise("positive") if sentiment == "positive" else F.lit(sentiment)
                return F.when(conf >= threshold, F.struct(
                    F.substring(t, m["at"] + 1, F.lit(len(aspect))).alias("aspect"), shown.alias("opinion"), polarity.alias("sentiment"), F.lit(category).alias("category"),
                    conf.alias("confidence"), m["at"].cast("int").alias("start"), (m["at"] + len(aspect)).cast("int").alias("end"), F.lit("rule").alias("method")))

            return let(F.struct(F.contains(low, F.lit(opinion)).alias("has"), (F.locate(aspect, low) - 1).alias("at")), row)

        fired = [F.when(F.contains(low, F.lit(a)), F.coalesce(*[build(*r) for r in rs])) for a, rs in words.items()]

        def fallback(_):
            tokens = F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")

            def row(ws):
                first = F.element_at(ws, 1)
                last = F.when(F.size(ws) > 1, F.element_at(ws, -1)).otherwise("bagus")
                polarity = F.when(tx.any_contains(low, lx.RULE_POSITIVE_WORDS if positives is None else positives), "positive").otherwise("negative")
                return F.array(F.struct(
                    first.alias("aspect"), last.alias("opinion"), polarity.alias("sentiment"), fallback_category(first, t, categories).alias("category"),
                    F.lit(0.85).alias("confidence"), F.lit(0).alias("start"), F.length(first).alias("end"), F.lit("fallback").alias("method")))

            return let(tokens, row)

        found = F.filter(F.array(*fired), lambda x: x.isNotNull())
        return F.when(t == "", empty).otherwise(let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(fallback(f))))

    def lowered(t):
        return let(F.struct(t.alias("t"), F.lower(t).alias("low")), lambda v: let(F.struct(
            v["t"].alias("t"), v["low"].alias("low"), tx.any_contains(v["low"], lx.RULE_NEGATIONS if negations is None else negations).alias("negated")), of_review))

    return let(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), lowered)


def analyze_reviews(docs: DataFrame, keys: Sequence[str], text: str = "text", **options) -> DataFrame:
    """One row per rule tuple of every review: a narrow explode, no join and no shuffle."""
    return docs.select(*keys, F.explode(rule_tuples(F.col(text), **options)).alias("t")).select(*keys, "t.*")


def waiting_guardrail(aspect: Column, context: Column, sentiment: Column, confidence: Column) -> Column:
    """A long wait on a service-type aspect is negative: struct(sentiment, confidence, applied)."""
    low_a, low_c = F.lower(F.coalesce(aspect, F.lit(""))), F.lower(F.coalesce(context, F.lit("")))
    hit = low_a.rlike("(?Ui)" + lx.SERVICE_ASPECT) & low_c.rlike("(?Ui)" + lx.WAIT_EVIDENCE) & low_c.rlike("(?Ui)" + lx.WAIT_GUARD) & (sentiment != "negative")
    return F.struct(
        F.when(hit, "negative").otherwise(sentiment).alias("sentiment"), F.when(hit, F.greatest(confidence, F.lit(0.78))).otherwise(confidence).alias("confidence"), hit.alias("applied"))


def semantic_guardrail(aspect: Column, category: Column, context: Column, sentiment: Column, confidence: Column) -> Column:
    """Ordered high-precision overrides on the sentence: struct(sentiment, confidence, reason)."""
    a, cat = F.lower(F.coalesce(aspect, F.lit(""))), F.coalesce(category, F.lit(""))

    def ctx(p):
        return context.rlike("(?Ui)" + p)

    def asp(p):
        return a.rlike("(?Ui)" + p)

    rules = [
        ((F.contains(cat, F.lit("parking")) | asp(r"\bparkir")) & ctx(r"\b(susah|sulit|sempit|penuh)\b"), "negative", "parking_difficulty"),
        ((F.contains(cat, F.lit("prayer_room")) | asp(r"\b(musholla|mushola|musala)")) & ctx(r"\b(kecil|sempit|kotor|susah)\b"), "negative", "prayer_room_negative_cue"),
        ((F.contains(cat, F.lit("beverage")) | asp(r"\b(americano|kopi|latte|espresso|cappuccino|minuman)")) & ctx(r"\b(rasa(?:nya)?\s+beda|tidak\s+enak|ga\s+enak|gak\s+enak|kecewa)\b"), "negative", "beverage_quality_negative_cue"),
        ((F.contains(cat, F.lit("portion")) | asp(r"\bporsi")) & ctx(r"\b(dikit|sedikit|kecil)\b"), "negative", "portion_small"),
        (asp(r"\b(kasir|barista|dokter|perawat|bidan|staff|staf|pegawai)\b") & ctx(lx.STRONG_POSITIVE) & ~ctx(lx.STRONG_NEGATIVE), "positive", "staff_positive_action"),
        (asp(r"\btoilet") & ctx(r"\bbersih\b"), "positive", "toilet_clean"),
        (asp(r"^\s*(harga|biaya|tarif|price)\b") & ctx(r"\b(standar|standard|normal|sesuai daftar)\b") & ~ctx(r"\b(mahal|murah|pricey|worth|oke|bagus|buruk)\b"), "neutral", "price_factual_neutral"),
        (~asp(r"^\s*(harga|biaya|tarif|price)\b") & asp(r"\b(lokasi|letak|akses)") & ctx(r"\b(di|berada|lantai|jalan|gedung)\b") & ~ctx(r"\b(strategis|susah|sulit|mudah|jauh|dekat|bagus|buruk)\b"), "neutral", "location_factual_neutral"),
    ]
    pick = None
    for cond, value, reason in rules:
        row = F.struct(F.lit(value).alias("s"), F.lit(reason).alias("r"))
        pick = F.when(cond, row) if pick is None else pick.when(cond, row)
    changed = pick.isNotNull() & (pick["s"] != sentiment)
    return F.struct(
        F.when(changed, pick["s"]).otherwise(sentiment).alias("sentiment"), F.when(changed, F.greatest(confidence, F.lit(0.80))).otherwise(confidence).alias("confidence"),
        F.when(changed, pick["r"]).alias("reason"))


def lateness_override(opinion: Column, context: Column, sentiment: Column, words: Sequence[str] | None = None) -> Column:
    """Lateness words in the opinion (or, without one, in the context) force negative."""
    where = F.lower(F.coalesce(F.when(opinion != "", opinion), context))
    return F.when(tx.any_contains(where, words or lx.LATENESS_WORDS), "negative").otherwise(sentiment)


def neutral_review_list(examples: DataFrame, text: str = "marked_context", positive: str = lx.POSITIVE_CUES, negative: str = lx.NEGATIVE_CUES) -> DataFrame:
    """Neutral examples that carry polar cues, with the flags."""
    flags = F.concat_ws(",", F.when(F.col(text).rlike("(?Ui)" + positive), "positive_cue"), F.when(F.col(text).rlike("(?Ui)" + negative), "negative_cue"))
    return examples.where("sentiment = 'neutral'").withColumn("audit_flags", flags).where("audit_flags <> ''")


def hard_contrast(anns: Column) -> Column:
    """At least two different classes in one record."""
    valid = F.filter(F.transform(anns, lambda a: tx.canonical_sentiment(a["sentiment"])), lambda s: s.isin(lx.SENTIMENTS))
    return F.size(F.array_distinct(valid)) >= 2


def _new_target(clause: Column) -> Column:
    low = F.lower(clause)
    return low.rlike(r"(?U)\b\w+nya\b") | low.rlike(r"(?U)\b(?:" + "|".join(lx.CONTRAST_TARGETS) + r")\b")


def local_context(text: Column, start: Column, end: Column, peers: Column, max_chars: int = 420, contrast: str = lx.LOCAL_CONTRAST) -> Column:
    """struct(left, right) of the sentence around a span, cut at contrast words that lead to another target."""
    half = max_chars // 2

    def within(v):
        found = F.transform(find_spans(F.substring(text, v["left"] + 1, v["right"] - v["left"]), "(?Ui)" + contrast), lambda m: F.struct(
            (v["left"] + m["start"]).alias("s"), (v["left"] + m["end"]).alias("e")))
        others = F.filter(peers, lambda p: ~((p["start"] == start) & (p["end"] == end)) & (p["end"] > v["left"]) & (p["start"] < v["right"]))

        def walk(o):
            def step(acc, m):
                right_peer = F.exists(o, lambda p: (p["start"] >= m["e"]) & (p["start"] < acc["right"]))
                left_peer = F.exists(o, lambda p: (p["end"] <= m["s"]) & (p["end"] > acc["left"]))
                cuts = F.struct(
                    (~acc["done"] & (end <= m["s"]) & (right_peer | _new_target(F.substring(text, m["e"] + 1, acc["right"] - m["e"])))).alias("r"),
                    (~acc["done"] & (start >= m["e"]) & (left_peer | _new_target(F.substring(text, acc["left"] + 1, m["s"] - acc["left"])))).alias("l"))
                return let(cuts, lambda c: F.struct(
                    F.when(c["l"], m["e"]).otherwise(acc["left"]).cast("int").alias("left"), F.when(c["r"], m["s"]).otherwise(acc["right"]).cast("int").alias("right"),
                    (acc["done"] | c["r"]).alias("done")))

            cut_of = F.aggregate(found, F.struct(v["left"].alias("left"), v["right"].alias("right"), F.lit(False).alias("done")), step)

            def sized(cut):
                wide = cut["right"] - cut["left"] > max_chars
                return F.struct(
                    F.when(wide, F.greatest(F.lit(0), start - half)).otherwise(cut["left"]).alias("left"),
                    F.when(wide, F.least(F.length(text), end + half)).otherwise(cut["right"]).alias("right"))

            return let(cut_of, sized)

        return let(others, walk)

    return let(F.struct(tx.sentence_left(text, start).cast("int").alias("left"), tx.sentence_right(text, end).cast("int").alias("right")), within)


def marked_context(text: Column, start: Column, end: Column, peers: Column, o_start: Column | None = None, o_end: Column | None = None, max_chars: int = 420) -> Column:
    """Local context with the aspect marked and, if it lies inside, the opinion too."""
    def marked(v):
        s, e = start - v["left"], end - v["left"]
        if o_start is None:
            return tx.mark_pair(v["piece"], s, e)
        inside = (o_start >= v["left"]) & (o_start < o_end) & (o_end <= v["right"]) & ((o_end <= start) | (o_start >= end))
        return let(F.struct(F.when(inside, o_start - v["left"]).alias("s"), F.when(inside, o_end - v["left"]).alias("e")), lambda o: tx.mark_pair(v["piece"], s, e, o["s"], o["e"]))

    return let(local_context(text, start, end, peers, max_chars), lambda c: let(F.struct(
        c["left"].alias("left"), c["right"].alias("right"), F.substring(text, c["left"] + 1, c["right"] - c["left"]).alias("piece")), marked))


def sentiment_examples(records: DataFrame, split: str, with_opinion: bool = True) -> DataFrame:
    """Explicit and implicit aspect examples with marked context, contrast flag and neutral subtype."""
    valid = F.filter("annotations", lambda a: F.coalesce(tx.canonical_sentiment(a["sentiment"]).isin(lx.SENTIMENTS), F.lit(False)))
    peers = F.transform(F.filter(valid, lambda a: a["aspect_start"].isNotNull() & a["aspect_end"].isNotNull()), lambda a: F.struct(a["aspect_start"].alias("start"), a["aspect_end"].alias("end")))
    base = records.where(F.col("split") == split).select("id", "text", "domain", "language", "source_dataset", hard_contrast(F.col("annotations")).alias("hard_contrast"),
                                                         valid.alias("_v"), peers.alias("_peers"))
    ex = base.select("*", F.posexplode("_v").alias("idx", "a"))
    implicit = F.coalesce(F.col("a.implicit"), F.lit(False)) | F.col("a.aspect_start").isNull()
    o = (F.col("a.opinion_start"), F.col("a.opinion_end")) if with_opinion else (None, None)
    marked = marked_context(F.col("text"), F.col("a.aspect_start"), F.col("a.aspect_end"), F.col("_peers"), *o)
    target = F.when(implicit, F.col("a.aspect_category")).otherwise(F.expr("substring(text, a.aspect_start + 1, a.aspect_end - a.aspect_start)"))
    sent = tx.canonical_sentiment(F.col("a.sentiment"))
    return ex.select(
        F.concat_ws("__", "id", F.col("idx").cast("string")).alias("example_id"), F.col("id").alias("record_id"), "domain", "language", "source_dataset", sent.alias("sentiment"),
        target.alias("target"), F.when(implicit, F.concat(F.lit("[ASP] "), target, F.lit(" [/ASP] [CTX] "), F.col("text"))).otherwise(marked).alias("marked_context"), "hard_contrast",
        F.when(implicit, "implicit_category").otherwise("explicit_span").alias("target_type"), implicit.alias("implicit"),
        F.when(sent == "neutral", F.when(implicit, "implicit_neutral").when(F.col("hard_contrast"), "contrast_neutral").otherwise("factual_neutral")).alias("neutral_subtype"),
        F.coalesce("a.sample_weight", F.lit(1.0)).alias("sample_weight"),
    ).where("target is not null")


def document_examples(docs: DataFrame, splits: Sequence[str], weight: float = 0.25) -> DataFrame:
    """Whole-document sentiment examples."""
    sent = tx.canonical_sentiment(F.col("overall_sentiment"))
    return docs.where(F.col("split").isin(*splits)).select(
        F.concat(F.lit("document::"), "id").alias("example_id"), F.col("id").alias("record_id"), "text", sent.alias("sentiment"), F.lit("DOCUMENT").alias("target"),
        F.concat(F.lit("[DOC] "), "text", F.lit(" [/DOC]")).alias("marked_context"), F.lit("document_sentiment_warmup").alias("target_type"),
        F.when(sent == "neutral", "document_level").alias("neutral_subtype"), F.lit(weight).alias("sample_weight"),
    ).where(F.col("sentiment").isin(lx.SENTIMENTS))


def category_examples(df: DataFrame, keywords=None, text: str = "text") -> DataFrame:
    """Category-conditioned examples: the longest keyword found is marked, else the category leads the text."""
    table = keywords or lx.CATEGORY_KEYWORDS
    t = F.col(text)
    marked = None
    for cat, words in table.items():
        spans = [first_span(t, r"(?Ui)(?<!\w)\Q" + w + r"\E(?!\w)") for w in sorted(words, key=len, reverse=True)]
        value = F.coalesce(*spans)
        marked = F.when(F.lower("category") == cat, value) if marked is None else marked.when(F.lower("category") == cat, value)
    hit = df.withColumn("_m", marked)
    plain = F.translate("category", "_", " ")
    return hit.withColumns({
        "target": F.coalesce("_m.term", plain),
        "marked_context": F.when(F.col("_m").isNotNull(), tx.mark_pair(t, F.col("_m.start"), F.col("_m.end"))).otherwise(
            F.concat(F.lit("[ASP] "), plain, F.lit(" [/ASP] [CTX] "), t)),
        "target_type": F.when(F.col("_m").isNotNull(), "public_explicit_category_span").otherwise("category_conditioned"),
    }).drop("_m")


def controlled_augmentation(spark, pairs=None, connectors=None, neutral=None, weight: float = 0.30) -> DataFrame:
    """Contrast sentences (pair x connector x target) and factual neutral sentences.

    ``pairs`` are rows or a DataFrame of a1, o1, s1, a2, o2, s2, domain.
    """
    p = pairs if isinstance(pairs, DataFrame) else spark.createDataFrame(
        pairs or lx.CONTRAST_PAIRS, "a1 string, o1 string, s1 string, a2 string, o2 string, s2 string, domain string")
    joins = F.explode(F.array(*[F.lit(c) for c in (connectors or lx.CONTRAST_CONNECTORS)])).alias("c")
    both = p.select("*", joins).withColumn("sentence", F.concat("a1", F.lit(" "), "o1", "c", "a2", F.lit(" "), "o2", F.lit(".")))
    rows = both.select("domain", "sentence", F.explode(F.array(F.struct(F.col("a1").alias("target"), F.col("s1").alias("sentiment")), F.struct(F.col("a2").alias("target"), F.col("s2").alias("sentiment")))).alias("t"))
    rows = rows.select("domain", "sentence", "t.target", "t.sentiment", F.lit(True).alias("hard_contrast"))
    flat = spark.createDataFrame(neutral or lx.NEUTRAL_TEMPLATES, "target string, sentence string, domain string").select(
        "domain", "sentence", "target", F.lit("neutral").alias("sentiment"), F.lit(False).alias("hard_contrast"))
    out = rows.unionByName(flat)
    at = F.expr("locate(lower(target), lower(sentence))")
    marked = F.when(at > 0, tx.mark_pair(F.col("sentence"), at - 1, at - 1 + F.length("target"))).otherwise(
        F.concat(F.lit("[ASP] "), "target", F.lit(" [/ASP] [CTX] "), "sentence"))
    return out.withColumns({"marked_context": marked, "sample_weight": F.lit(weight), "split": F.lit("train"), "target_type": F.lit("controlled_synthetic")})
