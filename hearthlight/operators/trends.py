"""Week-over-week comparison, trend tables and the weekly summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlight import labels as L
from hearthlight.functions import weeks
from hearthlight.operators.dedup import latest_per_key


def with_week(df: DataFrame, ts: str = "activity_date") -> DataFrame:
    """Add ``monday`` of the ISO week."""
    return df.withColumn("monday", weeks.monday_of(ts))


def health_change(health: DataFrame) -> DataFrame:
    """Health of each week beside the calendar week before it.

    The join is on Monday minus seven days: a missing week leaves the delta empty, where a lag
    would silently compare with an older week.
    """
    before = health.select(
        F.date_add("monday", 7).alias("monday"), F.col("health_score").alias("previous_score")
    )
    return health.join(before, "monday", "left").withColumn(
        "delta", F.round(F.col("health_score") - F.col("previous_score"), 2)
    )


def top_concerns(profile: DataFrame, n: int = 3, floor: float = 0.01) -> DataFrame:
    """Strongest negative labels of a one-row mean profile, as percent."""
    negatives = list(L.NEGATIVE)
    return (
        profile.unpivot([], negatives, "label", "mean")
        .filter(F.col("mean") > floor).orderBy(F.desc("mean"), "label").limit(n)
        .withColumn("percent", F.round(F.col("mean") * 100, 1))
    )


def concern_list(keys: Sequence[str], n: int = 3, floor: float = 0.01):
    """The same per key as one text, for mean profiles with many rows."""
    cells = F.filter(
        F.array(*[
            F.struct((-F.col(label)).alias("down"), F.lit(label).alias("label"))
            for label in L.NEGATIVE
        ]),
        lambda c: -c["down"] > floor,
    )
    return F.array_join(
        F.transform(F.slice(F.array_sort(cells), 1, n), lambda c: F.concat(
            c["label"], F.lit(" "), F.round(-c["down"] * 100, 1).cast("string"), F.lit("%"))),
        ", ",
    )


def trend_table(health: DataFrame, counts: DataFrame, snapshots: DataFrame, span: DataFrame,
                ) -> DataFrame:
    """Health and counts for each week of ``span`` (see ``weeks.week_span``).

    Verified counts come only from saved snapshots. A week without rows takes score and row
    count from its snapshot, else 0.
    """
    saved = snapshots.select(
        "week_key", "severe_count", "scam_count",
        F.col("comment_count").alias("_saved_rows"), F.col("score").alias("_saved_score"),
    )
    rows = (
        span.withColumn("week_key", weeks.week_key("monday"))
        .join(health.select("monday", "health_score"), "monday", "left")
        .join(counts.select("monday", F.col("interactions").alias("_rows")), "monday", "left")
        .join(saved, "week_key", "left")
    )
    empty = F.col("_rows").isNull()
    return rows.select(
        "week_key", weeks.week_range_label("monday").alias("week_range"),
        F.when(empty, F.coalesce("_saved_score", F.lit(0.0)))
        .otherwise(F.coalesce("health_score", F.lit(0.0))).alias("health_score"),
        "severe_count", "scam_count",
        F.when(empty, F.coalesce("_saved_rows", F.lit(0))).otherwise(F.col("_rows"))
        .alias("comment_count"),
    ).orderBy("week_key")


def emotion_trend(profiles: DataFrame, span: DataFrame, selected, top: int = 6) -> DataFrame:
    """Percent per week of the negative labels that lead in the selected week.

    ``profiles`` has one mean row per ``monday``; ``selected`` is the Monday to rank by.
    """
    negatives = list(L.NEGATIVE)
    order = F.array(*map(F.lit, negatives))
    long = profiles.select("monday", *negatives).unpivot(["monday"], negatives, "label", "mean")
    lead = (
        long.filter(F.col("monday") == F.lit(selected))
        .orderBy(F.desc("mean"), F.array_position(order, F.col("label"))).limit(top)
        .select("label")
    )
    grid = span.select(
        "monday", F.explode(order).alias("label")
    ).join(lead, "label", "left_semi")
    return grid.join(long, ["monday", "label"], "left").select(
        F.concat(F.lit("Week "), weeks.iso_week("monday").cast("string")).alias("week"),
        "monday", "label",
        F.round(F.coalesce("mean", F.lit(0.0)) * 100, 1).alias("percent"),
    )


def profile_table(profile: DataFrame) -> DataFrame:
    """Mean per label with its group and the common scale of the profile chart."""
    others = [label for label in L.LABELS if label != "neutral"]
    scale = F.greatest(F.greatest(*others) * 1.25, F.lit(0.12))
    group = (
        F.when(F.col("label") == "neutral", "neutral")
        .when(F.col("label").isin(*L.NEGATIVE), "negative").otherwise("positive")
    )
    return profile.withColumn("scale_max", scale).unpivot(
        ["scale_max"], list(L.LABELS), "label", "mean"
    ).select("label", group.alias("label_group"), "mean", "scale_max")


def weekly_summary(profile: DataFrame, health: DataFrame, counts: DataFrame,
                   fraud: DataFrame, severe: DataFrame) -> DataFrame:
    """One row per week: score, change, counts and the three strongest concerns."""
    text = profile.select("monday", concern_list(["monday"]).alias("top_concerns"))
    return (
        health_change(health).join(text, "monday", "left").join(counts, "monday", "left")
        .join(fraud, "monday", "left").join(severe, "monday", "left")
        .select(
            weeks.week_key("monday").alias("week_key"), "health_score", "previous_score", "delta",
            F.coalesce("interactions", F.lit(0)).alias("interactions"),
            F.coalesce("fraud_flags", F.lit(0)).alias("fraud_flags"), "top_concerns",
            F.coalesce("severe_verified", F.lit(0)).alias("severe_verified"),
            F.coalesce("mild_candidates", F.lit(0)).alias("mild_candidates"),
            F.coalesce("negative_dominant", F.lit(0)).alias("negative_dominant"),
        )
    )


def latest_snapshots(log: DataFrame, session: DataFrame | None = None) -> DataFrame:
    """Newest snapshot per week; a row of the running session beats every stored row."""
    rows = log.withColumn("_session", F.lit(0))
    if session is not None:
        rows = rows.unionByName(session.withColumn("_session", F.lit(1)))
    return latest_per_key(
        rows, ["week_key"], [F.desc("_session"), F.desc("updated_at"), "model_id", "score"]
    ).drop("_session")


def miss_rate_history(log: DataFrame) -> DataFrame:
    """Newest miss-rate entry per (year, week), with its label, in time order."""
    rows = latest_per_key(log, ["year", "week"], [F.desc("updated_at")])
    return rows.select(
        F.format_string("W%d/%d", "week", "year").alias("label"), "year", "week",
        "false_negative_rate", "false_negatives_detected", "sample_size", "scam_flags",
    ).orderBy("year", "week")
