"""Distress rules: severe and mild candidates, verification, rankings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlight import labels as L
from hearthlight import rules as R
from hearthlight.functions import matching as M
from hearthlight.functions import scores as S
from hearthlight.functions import text, verdicts
from hearthlight.operators.barrier import evaluate_once
from hearthlight.operators.fraud import StaffPolicy, drop_staff
from hearthlight.operators.texts import KEY

_ALL_HINTS = tuple(p for group in R.RARE_HINTS.values() for p in group)
_STRONG = (
    "severe_sum_high", "severe_hard_guardrail", "support_need_signal",
    "support_need_with_grief_hint", "sadness_above_review_band", "grief_review_band",
    "remorse_review_band",
)
_LOW_SIGNAL = ("fear_review_band", "nervousness_review_band", "embarrassment_review_band")
_OVERRIDE_FLAGS = ("support_need_signal", "support_need_with_grief_hint", "severe_sum_high")


def hint_labels(normalized, labels=tuple(R.RARE_HINTS)) -> Column:
    """Labels whose hint phrases occur in the normalized text, in the order given."""
    def found(norm: Column, hits: Column) -> Column:
        return M.compact([
            F.when(M.any_pattern_at(norm, hits, R.RARE_HINTS[label]), F.lit(label))
            for label in labels
        ])
    return _with_hits(text.col(normalized), _ALL_HINTS, found)


def _with_hits(value: Column, patterns, body) -> Column:
    return M.let(value, lambda t: M.let(M.start_hits(t, patterns), lambda h: body(t, h)))


def support_hits(normalized) -> Column:
    """Support-need patterns that match the normalized text, in list order."""
    return _with_hits(text.col(normalized), R.SUPPORT_NEED, lambda norm, hits: M.compact(
        M.pattern_hits(norm, hits, R.SUPPORT_NEED)))


def conflict_signal(cleaned) -> Column:
    return _with_hits(F.lower(text.col(cleaned)), R.CONFLICT, lambda low, hits: M.any_pattern_at(
        low, hits, R.CONFLICT))


def with_text_signals(df: DataFrame, content: str = "content") -> DataFrame:
    """Text side of the rules: hints, support hits and hardship phrases, one scan per text.

    Rows that carry them are not scanned again.
    """
    if {"rare_hints", "support_need_hits", "_hardship", "_context"} <= set(df.columns):
        return df
    low = F.lower(F.coalesce(F.col(content), F.lit("")))
    staged = evaluate_once(df, {"_norm": text.normalize_training_text(content), "_low": low})
    starts = [M.literal_start(p) for p in (*R.SUPPORT_NEED, *_ALL_HINTS)]
    staged = M.with_hit_list(staged, "_norm", starts, "_hits", at_edge=True)
    norm, hits = F.col("_norm"), F.col("_hits")
    low = F.col("_low")
    phrases = [M.longest_literal(p) for p in R.HARDSHIP_PHRASES]
    found = evaluate_once(staged, {
        "rare_hints": M.compact([
            F.when(M.any_pattern_at(norm, hits, R.RARE_HINTS[label]), F.lit(label))
            for label in sorted(R.RARE_HINTS)
        ]),
        "support_need_hits": M.compact(M.pattern_hits(norm, hits, R.SUPPORT_NEED)),
        "_hardship": M.any_term(low, phrases) & M.any_pattern(low, R.HARDSHIP_PHRASES),
    })
    # The context patterns only matter beside three support hits.
    return evaluate_once(found, {
        "_context": (F.size("support_need_hits") >= 3)
        & M.any_term(low, [M.literal_start(p) for p in R.HARDSHIP_CONTEXT])
        & M.any_pattern(low, [M.start_first(p) for p in R.HARDSHIP_CONTEXT]),
    }).drop("_norm", "_low", "_hits")


def severe_details(df: DataFrame, content: str = "content",
                   thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Add struct column ``severe`` with the evidence and ``candidate``.

    Needs the text column and the 28 score columns; scores are cleaned first.
    """
    act = dict(thresholds or L.DEFAULT_THRESHOLDS)
    band = {label: max(0.05, act[label] * 0.75) for label in L.LABELS}
    df = with_text_signals(S.normalize_scores(df), content)
    s = S.score
    has_support = F.size("support_need_hits") > 0
    context_peak = S.peak(L.SUPPORT_CONTEXT)
    total = F.col("_sum")
    spike = S.peak(L.SERIOUS)
    dominant_set = (*L.SERIOUS, "confusion")
    floor = F.coalesce(*[
        F.when(F.col("_dominant") == label, F.lit(act[label] * 0.20)) for label in dominant_set
    ])
    signal = has_support & (context_peak >= floor)
    tests = [
        (f"{label}_review_band", s(label) >= F.when(
            F.array_contains("rare_hints", label), F.lit(base * 0.65)).otherwise(F.lit(base)))
        for label, base in L.REVIEW_BANDS.items()
    ]
    tests += [
        ("embarrassment_review_band", s("embarrassment") >= band["embarrassment"]),
        ("sadness_above_review_band", s("sadness") >= band["sadness"]),
        ("sadness_disappointment_cluster",
         (s("disappointment") >= band["disappointment"]) & (s("sadness") >= act["sadness"] * 0.6)),
        ("fear_nervousness_cluster",
         (s("fear") >= act["fear"] * 0.5) & (s("nervousness") >= act["nervousness"] * 0.5)),
        ("severe_sum_high",
         total >= max(0.45, sum(act[label] for label in L.SEVERE_SUM) * 0.50)),
        ("severe_hard_guardrail",
         (total >= L.SEVERE_SUM_GUARDRAIL) | (spike >= L.SEVERE_SPIKE_GUARDRAIL)),
        ("support_need_signal", signal),
        ("support_need_with_grief_hint", ~signal & has_support & (s("grief") >= 0.08)),
        ("lexical_hardship_override", (context_peak >= 0.08) & F.col("_hardship")),
        ("multi_hit_context_override",
         (F.size("support_need_hits") >= 3) & F.col("_context")),
    ]
    found = M.compact([F.when(test, F.lit(name)) for name, test in tests])
    strong = F.array(*map(F.lit, _STRONG))
    weak = F.array(*map(F.lit, _LOW_SIGNAL))
    cleared = (
        ~F.arrays_overlap("_flags", strong)
        & (F.size(F.array_except("_flags", weak)) == 0)
        & ~has_support & (F.col("_count") <= 1)
    )
    staged = df.withColumns({
        "_sum": S.component_sum(L.SEVERE_SUM),
        "_count": S.component_count(L.SEVERE_SUM),
        "_dominant": S.dominant(dominant_set),
    })
    staged = evaluate_once(staged, {"_flags": found})
    kept = F.when(cleared, F.array().cast("array<string>")).otherwise(F.col("_flags"))
    staged = evaluate_once(staged, {"_kept": kept})
    details = F.struct(
        (F.size("_kept") > 0).alias("candidate"),
        total.alias("severe_sum"),
        F.when(F.col("_count") > 0, total / F.col("_count")).otherwise(0.0).alias("severe_avg"),
        S.components(L.SEVERE_SUM).alias("severe_components"),
        F.col("_count").alias("severe_component_count"),
        spike.alias("severe_spike"),
        F.col("_dominant").alias("dominant_emotion"),
        S.peak(dominant_set).alias("dominant_score"),
        F.col("_kept").alias("reason_flags"),
        "rare_hints", "support_need_hits",
    )
    return staged.withColumn("severe", details).drop(
        "_sum", "_count", "_dominant", "_flags", "_kept", "_hardship", "_context",
        "rare_hints", "support_need_hits",
    )


def mild_details(df: DataFrame) -> DataFrame:
    """Add struct column ``mild`` to rows that carry ``severe``."""
    negatives = tuple(label for label in L.NEGATIVE if label != "confusion")
    severe = F.col("severe")
    total, peak = S.plain_sum(negatives), S.peak(L.SUPPORT_CONTEXT)
    count = S.component_count(negatives)
    has_support = F.size(severe["support_need_hits"]) > 0
    top_set = (*negatives, "confusion")
    candidate = (
        ((total >= 0.20) & (total < 0.55))
        | ((peak >= 0.18) & (total >= 0.12))
        | (has_support & (peak >= 0.12))
    ) & (S.peak(top_set) > 0)
    is_severe = severe["candidate"]

    def pick(severe_field: str, value: Column) -> Column:
        return F.when(is_severe, severe[severe_field]).otherwise(value)

    return df.withColumn("mild", F.struct(
        (~is_severe & candidate).alias("candidate"),
        pick("severe_sum", total).alias("negative_sum"),
        pick("severe_avg", F.when(count > 0, total / count).otherwise(0.0)).alias("negative_avg"),
        pick("severe_components", S.components(negatives)).alias("negative_components"),
        pick("severe_component_count", count).alias("negative_component_count"),
        pick("dominant_emotion", S.dominant(top_set)).alias("dominant_emotion"),
        pick("dominant_score", S.peak(top_set)).alias("dominant_score"),
        severe["support_need_hits"].alias("support_need_hits"),
    ))


_IDENTITY = ("community_name", "commenter_name", "commenter_email")


def severe_candidates(df: DataFrame, staff: StaffPolicy = StaffPolicy()) -> DataFrame:
    """Severe rows of non-staff authors in display units (points of 100), with ``text_key`` instead of
    ``comment`` where the rows have been parted from their texts."""
    severe = F.col("severe")
    words = F.coalesce("content", F.lit("")).alias("comment") if "content" in df.columns else KEY
    return drop_staff(df, staff).filter("severe.candidate").select(
        "interaction_id",
        text.title_case(severe["dominant_emotion"]).alias("emotion"),
        text.percent(severe["dominant_score"]).alias("score"),
        text.percent(severe["severe_sum"]).alias("total_negative"),
        text.percent(severe["severe_avg"]).alias("avg_negative_intensity"),
        severe["severe_component_count"].alias("negative_component_count"),
        F.transform(severe["severe_components"], text.title_case).alias("negative_components"),
        severe["reason_flags"].alias("reason_flags"),
        severe["rare_hints"].alias("rare_hints"),
        severe["support_need_hits"].alias("support_need_hits"),
        words, *_IDENTITY,
    )


def mild_candidates(df: DataFrame) -> DataFrame:
    mild = F.col("mild")
    words = F.coalesce("content", F.lit("")).alias("comment") if "content" in df.columns else KEY
    return df.filter("mild.candidate").select(
        "interaction_id",
        text.title_case(mild["dominant_emotion"]).alias("emotion"),
        text.percent(mild["dominant_score"]).alias("score"),
        text.percent(mild["negative_sum"]).alias("total_negative"),
        text.percent(mild["negative_avg"]).alias("avg_negative_intensity"),
        mild["negative_component_count"].alias("negative_component_count"),
        F.transform(mild["negative_components"], text.title_case).alias("negative_components"),
        words, *_IDENTITY,
    )


def verify(rows: DataFrame, verdict_table: DataFrame, raw: str = "sanity_raw") -> DataFrame:
    """Reviewer verdict with recall override for every candidate.

    Adds ``verdict``, ``recall_override``, ``is_concerning``, ``verdict_source`` and the log
    ``status``. Answers that are errors keep a null source; ``verified`` drops them.
    """
    answers = verdict_table.select("interaction_id", F.col(raw).alias("_raw"))
    joined = rows.join(answers, "interaction_id", "left").withColumn(
        raw, F.coalesce("_raw", F.lit("ERROR: Timeout"))
    ).drop("_raw")
    failed = verdicts.is_error(raw)
    override = (
        (F.size("support_need_hits") > 0) | (F.col("total_negative") >= 55)
        | F.arrays_overlap("reason_flags", F.array(*map(F.lit, _OVERRIDE_FLAGS)))
    )
    said, over = F.col("verdict"), F.col("recall_override")
    concerning = (
        F.when(failed | said, said).when(said.isNull(), over)
        .otherwise(over & (F.col("total_negative") >= 70))
    )
    keep = F.col("is_concerning")
    return joined.withColumns({
        "verdict": F.when(~failed, verdicts.boolean_verdict(raw)),
        "recall_override": override,
    }).withColumn("is_concerning", F.coalesce(F.when(failed, False).otherwise(concerning),
                                              F.lit(False))).withColumns({
        "verdict_source": F.when(failed, None).when(said, "gemini_true")
        .when(said.isNull() & keep, "recall_override_ambiguous")
        .when(keep, "recall_override_false").otherwise("gemini_false"),
        "status": F.when(failed, F.col(raw)).when(said.isNotNull(), "Verified")
        .when(keep, "Recall Override").otherwise("Ambiguous"),
    })


def verified(rows: DataFrame, reviewer_true_only: bool = False) -> DataFrame:
    """Concerns that survive verification; optionally only those the reviewer confirmed."""
    kept = rows.filter("is_concerning")
    return kept.filter("verdict_source = 'gemini_true'") if reviewer_true_only else kept


def verification_log(rows: DataFrame, raw: str = "sanity_raw") -> DataFrame:
    """One log row per reviewed candidate, with the verdict as shown to staff."""
    failed = verdicts.is_error(raw)
    unsure = F.contains("status", F.lit("Error")) | (F.col("status") == "Ambiguous")
    return rows.select(
        "interaction_id",
        text.preview("comment", 120, always_dots=True).alias("comment_preview"),
        F.col("emotion").alias("flagged_for"),
        F.when(failed, "API_ERROR").otherwise(F.col(raw)).alias("raw_response"),
        F.col("is_concerning").alias("interpreted_label"),
        "status",
        F.when(unsure, "UNCERTAIN").when(F.col("is_concerning"), "VERIFIED")
        .otherwise("REJECTED").alias("display_verdict"),
    )


def severity_ranking(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("total_negative"), "interaction_id")


def top_mild(rows: DataFrame, n: int = 10) -> DataFrame:
    return severity_ranking(rows).limit(n)
