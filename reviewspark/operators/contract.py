"""Filters and record contracts: good rows on one side, an issues table on the other.

A contract breach is a row in ``issues``, never an exception: a cluster job must
not die on its first bad record.  Annotation checks run inside the record's own
array, so none of these operators shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark import lexicons as lx
from reviewspark.functions import text as tx
from reviewspark.functions.spans import offset_ok
from reviewspark.schemas import ANNOTATION
from reviewspark.scale import computed, let, small


def _annotation(a: Column, **changes: Column) -> Column:
    """The annotation struct with some fields replaced, in schema order."""
    return F.struct(*[changes.get(f.name, a[f.name]).cast(f.dataType).alias(f.name) for f in ANNOTATION.fields])


def _codes(*checks: tuple[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(cond, F.lit(code)) for code, cond in checks]), lambda c: c.isNotNull())


def unique_annotations(anns: Column, key) -> Column:
    """Order-preserving distinct by a key of the annotation, the first of each key.

    Most reviews have no key twice, which the hashed keys tell; only in others is the place of each key looked up.
    """
    def of(keys):
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), anns).otherwise(
            F.filter(anns, lambda a, i: F.array_position(keys, F.get(keys, i)) == i + 1))

    # a struct is told apart by its JSON, nulls kept: arrays of structs are compared pair by pair, strings are hashed
    return let(F.transform(anns, lambda a: _as_text(key(a))), of)


def _as_text(key: Column) -> Column:
    return F.to_json(F.struct(key.alias("k")), {"ignoreNullFields": "false"})


def _first_seen(anns: Column, key) -> Column:
    return unique_annotations(anns, key)


def pair_signature(a: Column) -> Column:
    return F.struct(a["aspect_start"].alias("as"), a["aspect_end"].alias("ae"), a["opinion_start"].alias("os"), a["opinion_end"].alias("oe"))


def usable_annotation(a: Column) -> Column:
    """Explicit aspect with a three-class label."""
    return a["aspect_start"].isNotNull() & a["aspect_end"].isNotNull() & F.coalesce(a["sentiment"].isin(lx.SENTIMENTS), F.lit(False))


def complete_human(records: DataFrame) -> Column:
    return (
        F.coalesce(F.col("human_approved"), F.lit(False)) & F.coalesce(F.col("annotation_complete"), F.lit(False))
        & ~F.coalesce(F.col("is_synthetic"), F.lit(False))
    )


def gold_only(records: DataFrame, statuses=None) -> DataFrame:
    return records.where(F.lower("human_status").isin(statuses or lx.PLACE_GOLD_STATUSES))


def silver_auxiliary(records: DataFrame, review_conf: float = lx.SILVER_REVIEW_CONF, annotation_conf: float = lx.SILVER_ANNOTATION_CONF,
                     class_weights: dict[str, float] | None = None, loss_weight: float = 0.25) -> DataFrame:
    """Machine-labelled training rows that may support training: never held-out, never gold.

    With ``class_weights`` each annotation carries its class weight, the record
    the mean of them, and an annotated pair is marked positive-only.
    """
    kept = F.transform(
        F.filter("annotations", lambda a: (F.coalesce(a["annotation_confidence"], F.lit(0.0)) >= annotation_conf)
                 & F.coalesce(tx.canonical_sentiment(a["sentiment"]).isin(lx.SENTIMENTS), F.lit(False))),
        lambda a: _annotation(a, sentiment=tx.canonical_sentiment(a["sentiment"]), sample_weight=(
            F.try_element_at(F.create_map(*[F.lit(x) for kv in class_weights.items() for x in kv]), tx.canonical_sentiment(a["sentiment"]))
            if class_weights else F.lit(loss_weight))),
    )
    base = records.where(
        (F.col("split") == "train") & ~F.coalesce(F.col("needs_human_review"), F.lit(False))
        & (F.coalesce(F.col("review_annotation_confidence"), F.lit(0.0)) >= review_conf)
    ).withColumn("annotations", kept).where(F.size("annotations") > 0)
    total = F.aggregate("annotations", F.lit(0.0), lambda acc, a: acc + a["sample_weight"])
    return base.withColumns({
        "sample_weight": total / F.size("annotations"), "annotation_complete": F.lit(False),
        "positive_only": F.exists("annotations", lambda a: a["opinion_start"].isNotNull() & F.coalesce(a["relation"], F.lit(True))),
    })


def unseen_domain_holdout(records: DataFrame, domain: str = "sight") -> DataFrame:
    """The unseen domain keeps only its official test rows, relabelled; its other rows leave."""
    is_unseen = F.lower("domain") == domain
    return records.where(~is_unseen | (F.col("split") == "test")).withColumn("split", F.when(is_unseen, "unseen_test").otherwise(F.col("split")))


def drop_duplicate_status(records: DataFrame, statuses=("exclude_duplicate", "duplicate")) -> DataFrame:
    flagged = F.lower(F.trim(F.coalesce("duplicate_status", F.lit("")))).isin(*statuses) | (
        F.lower(F.trim(F.coalesce("suggested_split", F.lit("")))) == "exclude_duplicate"
    )
    return records.where(~flagged)


def linguistic_slices(records: DataFrame, key: str = "id", negation: str = lx.SLICE_NEGATION, emoji: str | None = None,
                      code_switched: Column | None = None) -> DataFrame:
    """(id, slice) rows: negation, emoji, elongation, short, multi-aspect, code-switch."""
    text = F.col("text")
    emoji = emoji or "|".join(lx.EMOJI_TOKENS)
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    flags = {
        "negation": text.rlike("(?Ui)" + negation),
        "emoji": text.rlike(emoji),
        "typo_or_elongation": text.rlike(r"([A-Za-z])\1{2,}"),
        "short_review": words <= 5,
        "multi_aspect": F.size(F.filter("annotations", lambda a: a["aspect_start"].isNotNull())) >= 2,
        "code_switch": code_switched if code_switched is not None else F.lit(False),
    }
    names = F.filter(F.array(*[F.when(cond, F.lit(n)) for n, cond in flags.items()]), lambda x: x.isNotNull())
    return records.select(key, F.explode(names).alias("slice"))


def profile_thresholds(spark, profiles=None) -> DataFrame:
    return spark.createDataFrame(
        profiles or lx.PROFILES, "profile string, aspect_threshold double, opinion_threshold double, recovery boolean, dual_view boolean"
    )


def confidence_cut(rows: DataFrame, profiles: DataFrame, score: str = "score", threshold: str = "aspect_threshold") -> DataFrame:
    """Rows that reach their profile's threshold; the profile table has one row per profile."""
    return rows.join(small(profiles.select("profile", threshold)), "profile").where(F.col(score) >= F.col(threshold)).drop(threshold)


def three_class_view(anns: Column) -> Column:
    """Labels outside the three classes move to null; the span itself stays."""
    return F.transform(anns, lambda a: _annotation(
        a, sentiment=F.when(tx.canonical_sentiment(a["sentiment"]).isin(lx.SENTIMENTS), tx.canonical_sentiment(a["sentiment"]))))


def unsupported_labels(anns: Column) -> Column:
    """The labels that ``three_class_view`` removed, kept for the audit."""
    return F.filter(F.transform(anns, lambda a: tx.canonical_sentiment(a["sentiment"])), lambda s: s.isNotNull() & ~s.isin(lx.SENTIMENTS))


def _annotation_problems(text: Column, anns: Column) -> Column:
    """The problem of each annotation or null; the text is measured once per review, not once per offset."""
    def problem(a, n):
        def bad(kind):
            s, e, t = a[f"{kind}_start"], a[f"{kind}_end"], a[f"{kind}_term"]
            inside = (s >= 0) & (s < e) & (e <= n)
            return (
                F.when(s.isNull() != e.isNull(), f"partial_{kind}_offset")
                .when(s.isNotNull() & ~inside, f"invalid_{kind}_offset")
                .when(s.isNotNull() & t.isNotNull() & inside & (F.substring(text, s + 1, e - s) != t), f"{kind}_offset_mismatch")
            )

        return F.coalesce(bad("aspect"), bad("opinion"))

    return let(F.length(text), lambda n: F.transform(anns, lambda a: problem(a, n)))


def validate_review_rows(rows: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Staged review rows to (records, errors); a bad annotation leaves, the review stays."""
    text = F.col("text")
    place = tx.first_nonempty(F.col("place_id"), F.col("place_name"), F.concat(F.lit("unknown_place__"), F.col("id")))
    wanted = F.lower(F.trim(F.coalesce("split", F.lit(""))))
    checked = rows.withColumn("_problems", _annotation_problems(text, F.col("annotations")))
    good = F.filter(F.zip_with("annotations", "_problems", lambda a, p: F.struct(a.alias("a"), p.alias("p"))), lambda z: z["p"].isNull())
    empty = F.trim(F.coalesce(text, F.lit(""))) == ""
    records = checked.where(~empty).withColumns({
        "place_id": place,
        "split": F.when(wanted.isin("train", "validation", "test"), wanted).otherwise(tx.place_split(place)),
        "domain": tx.domain_alias(F.col("domain")),
        "rejected_annotation_count": F.size(F.filter("_problems", lambda p: p.isNotNull())),
        "annotations": F.transform(good, lambda z: _annotation(
            z["a"], sentiment=tx.canonical_sentiment(z["a"]["sentiment"]),
            aspect_start=F.when(~F.coalesce(z["a"]["implicit"], F.lit(False)), z["a"]["aspect_start"]),
            aspect_end=F.when(~F.coalesce(z["a"]["implicit"], F.lit(False)), z["a"]["aspect_end"]),
            aspect_term=F.when(~F.coalesce(z["a"]["implicit"], F.lit(False)), z["a"]["aspect_term"]),
        )),
        "annotation_source": F.lit(source),
    }).drop("_problems")
    errors = checked.where(~empty).select("id", F.posexplode("_problems").alias("annotation", "error")).where("error is not null").unionByName(
        checked.where(empty).select("id", F.lit(None).cast("int").alias("annotation"), F.lit("empty_review").alias("error"))
    )
    return records, errors


def canonical_records(raw: DataFrame, neutral_policy: str = "factual_is_no_opinion", empty: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The full record contract: (clean records, issues).

    ``raw`` follows ``schemas.RAW_RECORD``; a record with any issue stays out of
    the clean branch. ``empty`` tells the records without a text, by default those of a blank one.
    """
    text = F.col("text")
    split = F.coalesce(F.try_element_at(lx.literal_map(lx.SPLIT_ALIASES), F.col("split")), F.col("split"))
    status = F.lower(F.coalesce(F.col("human_status"), F.lit("")))
    quality = F.lower(tx.first_nonempty(F.col("annotation_status"), status, F.lit("unlabeled_pending_human")))
    said_synthetic = F.contains(quality, F.lit("synthetic")) | F.contains(F.lower(F.coalesce("source_dataset", F.lit(""))), F.lit("synthetic"))
    synthetic = F.when(F.col("is_synthetic").isNull(), said_synthetic).otherwise(tx.strict_bool(F.col("is_synthetic")))
    approved = F.when(F.col("human_approved").isNull(), F.lit(False)).otherwise(tx.strict_bool(F.col("human_approved")))
    complete = F.when(F.col("annotation_complete").isNull(), F.lit(False)).otherwise(tx.strict_bool(F.col("annotation_complete")))
    human = F.coalesce(approved, F.lit(False)) | status.isin(lx.GOLD_STATUSES)
    weight = F.coalesce(F.expr("try_cast(sample_weight as double)"), F.when(F.col("sample_weight").isNull(), F.when(human, 1.0).otherwise(0.25)))

    def label(a):
        return tx.canonical_sentiment(a["sentiment"])

    unsupported = ["conflict", "mixed", "unknown", "abstain", "no_opinion"]
    # every step is worked out once per record, though the clean branch and the issues both test it
    base = computed(raw, {"_anns": F.coalesce(F.col("annotations"), F.array().cast(raw.schema["annotations"].dataType))})
    anns = F.col("_anns")

    def factual(a):
        return F.coalesce(a["mention_type"] == "factual_no_opinion", F.lit(False))

    opinions = F.filter(anns, lambda a: ~factual(a))
    if neutral_policy == "factual_is_neutral":
        opinions = F.transform(anns, lambda a: F.when(factual(a), _annotation(a, sentiment=F.lit("neutral"), relation=F.lit(False))).otherwise(_annotation(a)))
    labelled = F.filter(opinions, lambda a: ~F.coalesce(label(a).isin(unsupported), F.lit(False)))
    cleaned = F.transform(labelled, lambda a: _annotation(
        a, sentiment=label(a), implicit=F.coalesce(a["implicit"], a["aspect_start"].isNull()), relation=F.coalesce(a["relation"], F.lit(True))))
    base = computed(base, {"_clean": cleaned, "_problems": _annotation_problems(text, anns)})
    clean = F.col("_clean")
    bad_label = F.exists(clean, lambda a: ~F.coalesce(a["sentiment"].isin(lx.SENTIMENTS), F.lit(False)))
    signatures = F.size(F.array_distinct(F.transform(clean, lambda a: _as_text(pair_signature(a)))))
    signed = F.size(F.array_distinct(F.transform(clean, lambda a: _as_text(F.struct(pair_signature(a).alias("p"), a["sentiment"].alias("s"))))))
    mentions = F.filter(anns, lambda a: factual(a) | F.coalesce(label(a).isin(unsupported), F.lit(False)))
    checks = _codes(
        ("missing_id", F.col("id").isNull()),
        ("empty_text", F.trim(F.coalesce(text, F.lit(""))) == "" if empty is None else empty),
        ("unknown_split", ~F.coalesce(split.isin("train", *lx.PROTECTED_SPLITS), F.lit(False))),
        ("missing_source_dataset", F.coalesce("source_dataset", F.lit("")) == ""),
        ("invalid_is_synthetic", synthetic.isNull()), ("invalid_human_approved", approved.isNull()),
        ("invalid_annotation_complete", complete.isNull()),
        ("not_natural_gold", human & (F.coalesce(synthetic, F.lit(False)) | F.contains(quality, F.lit("silver")) | F.contains(quality, F.lit("translated")))),
        ("synthetic_without_family", F.coalesce(synthetic, F.lit(False)) & F.col("family_id").isNull()),
        ("invalid_sample_weight", weight.isNull() | F.isnan(weight) | ~(weight > 0) | (weight == float("inf"))),
        ("invalid_sentiment", bad_label), ("contradictory_sentiment", signed > signatures),
    )
    staged = computed(base, {"_codes": F.concat(checks, F.array_distinct(F.filter("_problems", lambda p: p.isNotNull())))}).withColumns({
        "_mentions": mentions, "_weight": weight,
        "_human": human, "_synthetic": synthetic, "_complete": complete, "_split": split, "_quality": quality, "_status": status,
    })
    issues = staged.select("id", F.explode("_codes").alias("issue"))
    lost = F.exists("_mentions", lambda a: ~factual(a))
    has = {
        "sentiment": F.exists("annotations", lambda a: a["sentiment"].isNotNull()),
        "aspect": F.exists("annotations", lambda a: a["aspect_start"].isNotNull()),
        "opinion": F.exists("annotations", lambda a: a["opinion_start"].isNotNull()),
        "relation": F.exists("annotations", lambda a: a["relation"] & a["aspect_start"].isNotNull() & a["opinion_start"].isNotNull()),
        "taxonomy": F.exists("annotations", lambda a: F.coalesce(a["aspect_category"], F.lit("")) != ""),
    }
    good = staged.where(F.size("_codes") == 0).select(
        "id", "text", F.col("text").alias("raw_text"), F.col("_split").alias("split"), "source_dataset",
        F.coalesce("source_bundle", F.lit("legacy")).alias("source_bundle"), F.coalesce("source_record_id", "id").alias("source_record_id"),
        F.col("_quality").alias("annotation_status"), F.col("_human").alias("human_approved"),
        F.when(F.col("_human"), "human_approved").otherwise(F.when(F.col("_status") == "", "not_human_gold").otherwise(F.col("_status"))).alias("human_status"),
        F.col("_synthetic").alias("is_synthetic"), F.col("_complete") & ~lost, F.col("_complete").alias("source_annotation_complete"),
        "family_id", "place_id", F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("domain", F.lit("unknown")).alias("domain"),
        F.col("_weight").alias("sample_weight"), F.col("_mentions").alias("mentions"),
        _first_seen(F.col("_clean"), pair_signature).alias("annotations"),
    ).toDF(
        "id", "text", "raw_text", "split", "source_dataset", "source_bundle", "source_record_id", "annotation_status", "human_approved",
        "human_status", "is_synthetic", "annotation_complete", "source_annotation_complete", "family_id", "place_id", "language", "domain",
        "sample_weight", "mentions", "annotations",
    )
    return good.withColumns({
        "tasks": F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in has.items()]), lambda x: x.isNotNull()),
        "raw_exact_key": tx.raw_exact_key(text), "normalized_soft_key": tx.soft_key(text),
        "provenance": F.array(F.struct("source_bundle", "source_dataset", "source_record_id")),
    }), issues


def schema_issues(records: DataFrame, collection: str, empty: Column | None = None) -> DataFrame:
    """collection, record_id, severity, issue, annotation for every breach of the unified schema.

    ``empty`` tells the records without a text, by default those of a blank one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    allowed = ["train", "validation", "test", "unseen_test", "diagnostic"]
    status = F.lower(F.coalesce("annotation_status", F.lit("")))

    def issue(severity, code, cond, annotation=F.lit(None).cast("int")):
        return F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("issue"), annotation.alias("annotation")))

    whole = F.array(
        issue("hard_error", "missing_stable_id", F.col("id").isNull()),
        issue("hard_error", "empty_text", F.trim(text) == "" if empty is None else empty),
        issue("hard_error", "raw_text_mutated", ~F.coalesce("raw_text", text).eqNullSafe(text)),
        issue("hard_error", "invalid_split", ~F.coalesce(F.col("split").isin(allowed), F.lit(False))),
        issue("hard_error", "missing_provenance", F.col("source_dataset").isNull() | F.col("source_record_id").isNull()),
        issue("warning", "derived_record_missing_parent_family", status.rlike("synthetic|translated") & F.col("family_id").isNull()),
    )

    def per_annotation(a, i):
        sentiment = tx.canonical_sentiment(a["sentiment"])
        rows = [issue("hard_error", "invalid_sentiment", ~F.coalesce(sentiment.isin(*lx.SENTIMENTS, "conflict"), F.lit(False)), i)]
        for kind in ("aspect", "opinion"):
            s, e, t = a[f"{kind}_start"], a[f"{kind}_end"], a[f"{kind}_term"]
            rows.append(issue("hard_error", f"partial_{kind}_offset", s.isNull() != e.isNull(), i))
            both = s.isNotNull() & e.isNotNull()
            rows.append(issue("hard_error", f"invalid_{kind}_offset", both & ~offset_ok(text, s, e), i))
            same = F.lower(F.substring(text, s + 1, e - s)) == F.lower(t)
            rows.append(issue("hard_error", f"{kind}_term_offset_mismatch", both & offset_ok(text, s, e) & t.isNotNull() & ~same, i))
        return F.array(*rows)

    found = F.concat(whole, F.flatten(F.transform("annotations", per_annotation)))
    return records.select(F.lit(collection).alias("collection"), F.col("id").alias("record_id"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(
        "collection", "record_id", "x.severity", "x.issue", "x.annotation"
    )


def offset_errors(records: DataFrame, kinds=("aspect", "opinion")) -> DataFrame:
    """id, annotation, kind, problem: out of bounds, or a term that is not the text at its offsets."""
    text = F.col("text")

    def probe(a, i):
        rows = []
        for kind in kinds:
            s, e, t = a[f"{kind}_start"], a[f"{kind}_end"], a[f"{kind}_term"]
            bad = F.when(~offset_ok(text, s, e), "bounds").when(~offset_ok(text, s, e, t), "term_mismatch")
            rows.append(F.when(s.isNotNull() & e.isNotNull() & bad.isNotNull(), F.struct(i.alias("annotation"), F.lit(kind).alias("kind"), bad.alias("problem"))))
        return F.array(*rows)

    found = F.filter(F.flatten(F.transform("annotations", probe)), lambda x: x.isNotNull())
    return records.select("id", F.explode(found).alias("x")).select("id", "x.*")


def row_status(rows: DataFrame, max_chars: int = 10_000, failed: Column | None = None, empty: Column | None = None) -> DataFrame:
    """processing_status and error_code of each review row; ``empty`` tells the empty ones, by default those of a blank review."""
    review = F.trim(F.coalesce("review", F.lit("")))
    failed = failed if failed is not None else F.lit(False)
    status = (
        F.when(review == "" if empty is None else empty, "empty_review").when(F.length(review) > max_chars, "invalid_input").when(failed, "model_error").otherwise("success")
    )
    code = F.when(F.col("processing_status") == "invalid_input", "REVIEW_TOO_LONG").when(F.col("processing_status") == "model_error", "MODEL_INFERENCE_ERROR")
    warnings = F.when(F.col("processing_status") == "empty_review", F.array(F.lit("empty_review"))).when(
        F.col("processing_status") == "invalid_input", F.array(F.lit("review_too_long"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("processing_status", status).withColumn("error_code", code).withColumn("row_warnings", warnings)


API_COLUMNS = {
    "aspect": "string", "opinion": "string", "sentiment": "string", "complaint_taxonomy": "string", "confidence": "double", "relation": "boolean",
    "domain": "string", "domain_confidence": "double", "entity_id": "string", "issue_id": "string", "taxonomy_confidence": "double",
    "taxonomy_abstained": "boolean", "taxonomy_low_confidence": "boolean", "taxonomy_policy": "string", "needs_human_review": "boolean",
    "review_reasons": "array<string>",
}


def api_tuples(tuples: DataFrame, keys: list[str]) -> DataFrame:
    """Any engine's tuples in the canonical columns; what an engine does not give is null."""
    have = set(tuples.columns)

    def column(name, kind):
        if name == "complaint_taxonomy":
            options = [F.col(c) for c in ("complaint_taxonomy", "taxonomy") if c in have]
            return F.coalesce(*options) if options else F.lit(None).cast(kind)
        if name == "sentiment":
            return tx.api_sentiment(F.col("sentiment"))
        if name == "review_reasons" and name not in have:
            return F.array().cast(kind)
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    return tuples.select(*keys, *[column(n, k).alias(n) for n, k in API_COLUMNS.items()])
