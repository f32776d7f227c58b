"""Aggregates over scores, flags and labelled predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlight import labels as L
from hearthlight.functions import scores as S
from hearthlight.operators.barrier import evaluate_once


def _add(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _ratio(top: Column, bottom: Column, default: float = 0.0) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(default))


def count_true(condition) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


# --- weekly profile ---------------------------------------------------------------------


def mean_profile(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of each of the 28 labels, per key."""
    return df.groupBy(*keys).agg(*[F.avg(label).alias(label) for label in L.LABELS])


def health_score() -> Column:
    """10 for no negative share, 0 for all negative, over a mean profile; null without signal."""
    negative, total = S.plain_sum(L.NEGATIVE), S.plain_sum(L.LABELS)
    return F.when(total != 0, F.round(10 * (1 - negative / total), 2))


def profile_health(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Health of mean profiles that are there already."""
    return profile.select(*keys, health_score().alias("health_score"))


def weekly_health(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return profile_health(mean_profile(df, keys), keys)


def is_negative_dominant() -> Column:
    """The strongest label is negative and above 0; the first label wins a tie."""
    return (S.peak() > 0) & S.dominant().isin(*L.NEGATIVE)


def weekly_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row counts per key over rows that carry ``severe`` and ``mild`` details.

    Staff rows count here as well; only the candidate lists leave them out.
    """
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("interactions"),
        count_true(is_negative_dominant()).alias("negative_dominant"),
        count_true(F.col("severe.candidate")).alias("severe_candidates"),
        count_true(F.col("mild.candidate")).alias("mild_candidates"),
    )


def activity_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        count_true(F.col("activity_type") == "Original Post").alias("posts"),
        count_true(F.col("activity_type") == "Comment").alias("comments"),
        F.count(F.lit(1)).alias("total"),
    )


def value_counts(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("rows"))


def severity_counts(rows: DataFrame) -> DataFrame:
    """One row: how many reviewed flags fall in each severity."""
    return rows.agg(*[
        count_true(F.col("severity") == level).alias(level.lower())
        for level in ("CRITICAL", "HIGH", "MEDIUM", "LOW")
    ])


def label_positives(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows with a score above 0, per label, from one pass over the wide table."""
    wide = df.agg(*[count_true(F.col(label) > 0).alias(label) for label in labels])
    return wide.unpivot([], list(labels), "label", "rows")


def reason_histogram(rows: DataFrame, top: int = 12) -> DataFrame:
    """Most frequent reason flags of the candidates."""
    counts = rows.select(F.explode("reason_flags").alias("reason_flag")).groupBy(
        "reason_flag"
    ).agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.desc("rows"), "reason_flag").limit(top)


# --- binary predictions -------------------------------------------------------------------


def binary_metrics(df: DataFrame, truth: str, predicted: str,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates; a rate with an empty denominator is 0."""
    actual, said = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(actual).alias("scam_examples"),
        F.count_if(~actual).alias("legit_examples"),
        F.count_if(actual & said).alias("tp"), F.count_if(~actual & said).alias("fp"),
        F.count_if(~actual & ~said).alias("tn"), F.count_if(actual & ~said).alias("fn"),
    )
    c = F.col
    rated = counts.withColumns({
        "precision": _ratio(c("tp"), c("tp") + c("fp")),
        "recall": _ratio(c("tp"), c("scam_examples")),
        "specificity": _ratio(c("tn"), c("legit_examples")),
        "accuracy": _ratio(c("tp") + c("tn"), c("total")),
        "false_positive_rate": _ratio(c("fp"), c("legit_examples")),
    })
    rates = ("precision", "recall", "specificity", "accuracy", "false_positive_rate")
    return rated.withColumns({f"{r}_pct": F.round(c(r) * 100, 1) for r in rates})


def category_summary(df: DataFrame) -> DataFrame:
    """Per category: examples and hits of the first tier and of the full cascade."""
    scam = F.coalesce("expected_scam", F.lit(False))
    tier1, full = F.coalesce("tier1_flag", F.lit(False)), F.coalesce("cascade_flag", F.lit(False))
    return df.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(
        F.count(F.lit(1)).alias("examples"),
        F.count_if(scam).alias("scams"), F.count_if(~scam).alias("legit"),
        F.count_if(scam & tier1).alias("tier1_hits"), F.count_if(~scam & tier1).alias("tier1_fp"),
        F.count_if(scam & full).alias("cascade_hits"),
        F.count_if(~scam & full).alias("cascade_fp"),
    ).orderBy("category")


def triage_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Agreement on support triage; rows without both decisions are left out."""
    t, p = F.col(truth), F.col(predicted)
    counts = df.filter(t.isNotNull() & p.isNotNull()).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"),
    )
    c = F.col
    return counts.withColumns({
        "precision": _ratio(c("tp"), c("tp") + c("fp")),
        "recall": _ratio(c("tp"), c("tp") + c("fn")),
        "f1": _ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
        "benign_fp_rate": c("fp") / F.greatest(c("tn") + c("fp"), F.lit(1)),
    })


def feedback_precision(log: DataFrame) -> DataFrame:
    """Verdict counts of the staff log and the share of confirmed flags."""
    v = F.col("verdict")
    counts = log.agg(
        count_true(v == "CONFIRMED_SCAM").alias("confirmed"),
        count_true(v == "FALSE_POSITIVE").alias("false_positives"),
        count_true(v == "NEEDS_HUMAN_REVIEW").alias("needs_review"),
    )
    c = F.col
    return counts.withColumn(
        "precision",
        c("confirmed") / F.greatest(c("confirmed") + c("false_positives"), F.lit(1)),
    )


# --- label agreement ----------------------------------------------------------------------


def label_confusion(pairs: DataFrame, thresholds: Mapping[str, float] | None = None,
                    student: str = "student_", teacher: str = "teacher_") -> DataFrame:
    """Confusion counts of teacher and student decisions per label.

    All 28 labels are counted in one pass over the wide rows; only the one-row result is turned
    into long form, so the data is never multiplied by 28.
    """
    act = dict(thresholds or L.DEFAULT_THRESHOLDS)

    def counts(label: str) -> Column:
        t = F.col(teacher + label) >= F.lit(act[label])
        s = F.col(student + label) >= F.lit(act[label])
        return F.struct(
            F.lit(label).alias("label"), F.lit(act[label]).alias("threshold"),
            F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"),
            F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn"),
        )

    wide = pairs.agg(F.array(*[counts(label) for label in L.LABELS]).alias("cells"))
    return wide.select(F.inline("cells"))


def label_report(confusion: DataFrame) -> DataFrame:
    """Per label precision, recall and F1, weakest first."""
    c = F.col
    return confusion.select(
        F.initcap("label").alias("emotion"), "threshold",
        (c("tp") + c("fn")).alias("support"), (c("tp") + c("fp")).alias("predicted"),
        F.round(_ratio(c("tp"), c("tp") + c("fp")), 3).alias("precision"),
        F.round(_ratio(c("tp"), c("tp") + c("fn")), 3).alias("recall"),
        F.round(_ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")), 3).alias("f1"),
    ).orderBy("f1", F.desc("support"), "emotion")


def watchlist_f1(report: DataFrame) -> DataFrame:
    names = [label.title() for label in L.WATCHLIST]
    return report.filter(F.col("emotion").isin(*names)).agg(
        F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 3).alias("watchlist_macro_f1")
    )


def global_agreement(confusion: DataFrame) -> DataFrame:
    """Macro F1 over both decisions, Cohen's kappa and a 95 % margin, all labels flattened.

    A class that neither side ever uses is not part of the macro mean.
    """
    c = F.col
    total = confusion.agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn")])
    n = c("tp") + c("fp") + c("fn") + c("tn")
    on = 2 * c("tp") + c("fp") + c("fn")
    off = 2 * c("tn") + c("fp") + c("fn")
    classes = (on > 0).cast("int") + (off > 0).cast("int")
    macro = (_ratio(2 * c("tp"), on) + _ratio(2 * c("tn"), off)) / classes
    observed = (c("tp") + c("tn")) / n
    chance = (
        (c("tp") + c("fn")) / n * ((c("tp") + c("fp")) / n)
        + (c("tn") + c("fp")) / n * ((c("tn") + c("fn")) / n)
    )
    return total.withColumn("decisions", n).filter("decisions > 0").withColumn(
        "macro_f1", macro
    ).withColumns({
        "kappa": F.when(chance != 1, (observed - chance) / (1 - chance)),
        "ci_margin": 1.96 * F.sqrt(c("macro_f1") * (1 - c("macro_f1")) / c("decisions")),
    })


# --- exact quantile ------------------------------------------------------------------------

_RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _bin(low, width, bins: int) -> Column:
    place = F.floor((F.col("value") - low) / width)
    return F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int")


def _locate(rows: DataFrame, q: float, outer: Column | None) -> Column:
    """Where the wanted ranks fall: first and last bin, rows before them, rank."""
    counted = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.select(
        "bin", "n", F.expr(f"sum(n) OVER (ORDER BY bin {_RUNNING})").alias("upto"),
        F.expr("sum(n) OVER ()").alias("total"),
    )
    if outer is None:
        placed = placed.withColumn("rank", (F.col("total") - 1) * F.lit(q))
    else:
        placed = placed.withColumns({
            "upto": F.col("upto") + outer["before"], "rank": outer["rank"],
        })
    wanted = placed.filter(
        (F.col("upto") >= F.floor("rank") + 1)
        & (F.col("upto") - F.col("n") < F.ceil("rank") + 1)
    )
    return wanted.agg(F.struct(
        F.min("bin").alias("first"), F.max("bin").alias("last"),
        F.min(F.col("upto") - F.col("n")).alias("before"), F.first("rank").alias("rank"),
    ).alias("spot")).scalar()


def exact_quantile(df: DataFrame, column: str, q: float, low: float, high: float,
                   bins: int = 4096) -> DataFrame:
    """One row with the linearly interpolated quantile of values in [low, high].

    An exact percentile aggregate keeps every distinct value in one task. Here the values are
    counted in ``bins`` ranges, the ranges that hold the wanted ranks are split into ``bins``
    again, and only the distinct values of that last slice are ordered. Equal values are counted
    first, so a value shared by a third of all rows is one row there.
    """
    width = (high - low) / bins
    rows = evaluate_once(df, {"value": F.col(column)}).select("value").filter("value IS NOT NULL")
    rows = evaluate_once(rows, {"bin": _bin(F.lit(low), F.lit(width), bins)})
    spot = _locate(rows, q, None)
    fine_low = F.lit(low) + spot["first"] * F.lit(width)
    fine_width = (spot["last"] - spot["first"] + 1) * F.lit(width) / bins
    rows = evaluate_once(rows.filter(F.col("bin").between(spot["first"], spot["last"])), {
        "bin": _bin(fine_low, fine_width, bins),
    })
    spot = _locate(rows, q, spot)
    near = rows.filter(F.col("bin").between(spot["first"], spot["last"])).groupBy("value").agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = near.select(
        "value",
        (F.expr(f"sum(n) OVER (ORDER BY value {_RUNNING})") + spot["before"]).alias("upto"),
        spot["rank"].alias("rank"),
    )
    lower = F.min(F.when(F.col("upto") >= F.floor("rank") + 1, F.col("value")))
    upper = F.min(F.when(F.col("upto") >= F.ceil("rank") + 1, F.col("value")))
    fraction = F.first(F.col("rank") - F.floor("rank"))
    return ranked.agg((lower + (upper - lower) * fraction).alias("quantile"))
