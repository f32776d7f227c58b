"""The three end-to-end jobs, assembled from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlight.functions import weeks
from hearthlight.operators import distress, evaluation, fraud, metrics, sampling, trends
from hearthlight.session import cut_lineage
from hearthlight.sources import interactions as ingest
from hearthlight.sources.tables import corpus_interactions, corpus_items


def scored_rows(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Interactions joined with their scores and both detail structs."""
    joined = rows.join(scores, "interaction_id")
    return distress.mild_details(distress.severe_details(joined))


def escalations(rows: DataFrame, staff: fraud.StaffPolicy = fraud.StaffPolicy(),
                include_trusted_users: bool = False) -> DataFrame:
    """How many interactions escalate, by ISO week and severity."""
    scanned = fraud.scan(fraud.drop_staff(rows, staff, include_trusted_users))
    hits = scanned.withColumn("severity_level", fraud.severity()).filter(
        "severity_level IS NOT NULL")
    return hits.groupBy(
        weeks.week_key("activity_date").alias("week_key"), "severity_level"
    ).agg(F.count(F.lit(1)).alias("escalated"))


@dataclass(frozen=True)
class WeeklyAnalysis:
    """Frames of one weekly run; each is a plan of its own."""

    interactions: DataFrame
    severe: DataFrame
    mild: DataFrame
    routed: DataFrame
    summary: DataFrame


def weekly_analysis(raw: DataFrame, scores: DataFrame, verdict_table: DataFrame, year: int,
                    week: int, window_weeks: int = 4, accounts: DataFrame | None = None,
                    policy: fraud.Policy = fraud.Policy(),
                    staff: fraud.StaffPolicy = fraud.StaffPolicy()) -> WeeklyAnalysis:
    """Load, score, verify, route and summarise one week; fraud looks at the whole window."""
    # The week before is always read, for the change in health; fraud looks at its own window.
    loaded = ingest.interaction_window(raw, year, week, max(2, window_weeks))
    window = loaded.filter(F.col("scam_scan_offset") < max(1, window_weeks))
    this_week = loaded.filter("scam_scan_offset = 0")
    # The text rules of the current week feed four frames.
    current = cut_lineage(trends.with_week(scored_rows(this_week, scores)))
    two_weeks = trends.with_week(
        loaded.filter("scam_scan_offset <= 1").select("interaction_id", "activity_date")
        .join(scores, "interaction_id"))
    profile = cut_lineage(metrics.mean_profile(two_weeks, ["monday"]))  # two rows
    routed = fraud.review_severity(
        fraud.cascade(window, verdict_table, accounts, policy, staff), policy)
    verified = distress.verify(distress.severe_candidates(current, staff), verdict_table)
    monday = F.lit(weeks.week_bounds(year, week)[0])
    summary = trends.weekly_summary(
        profile, metrics.profile_health(profile, ["monday"]),
        metrics.weekly_counts(current, ["monday"]),
        fraud.flags(routed).agg(F.count(F.lit(1)).alias("fraud_flags")).select(
            monday.alias("monday"), "fraud_flags"),
        distress.verified(verified, True).agg(F.count(F.lit(1)).alias("severe_verified")).select(
            monday.alias("monday"), "severe_verified"),
    ).filter(F.col("week_key") == weeks.week_key(monday))
    return WeeklyAnalysis(
        this_week, distress.severity_ranking(distress.verified(verified)),
        distress.top_mild(distress.mild_candidates(current), 50), routed, summary,
    )


def training_batch(raw: DataFrame, scores: DataFrame, year: int, week: int, lookback: int = 12,
                   size: int = 60, master: DataFrame | None = None) -> DataFrame:
    """Stratified sample of recent history for teacher labels."""
    history = ingest.training_history(raw, year, week, lookback)
    return sampling.draw_training_sample(history, scores, size, master)


@dataclass(frozen=True)
class BenchmarkReport:
    rows: DataFrame
    tier1: DataFrame
    cascade: DataFrame | None
    categories: DataFrame


def benchmark(corpus: DataFrame, verdict_table: DataFrame | None = None) -> BenchmarkReport:
    """Evaluate the heuristic, and with verdicts the full cascade, on labelled texts."""
    items = cut_lineage(fraud.scan(corpus_items(corpus), "text"))
    flagged = None
    if verdict_table is not None:
        people = corpus_interactions(items, carried=("heuristic_score", "matched_terms"))
        flagged = fraud.flags(fraud.cascade(people, verdict_table))
    rows = evaluation.benchmark_rows(items, flagged)
    return BenchmarkReport(
        rows, metrics.binary_metrics(rows, "expected_scam", "tier1_flag"),
        metrics.binary_metrics(rows, "expected_scam", "cascade_flag") if flagged else None,
        metrics.category_summary(rows),
    )
