"""Evaluation jobs: benchmark, model agreement, ground truth, miss audit, staff feedback."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlight import labels as L
from hearthlight.functions import scores as S
from hearthlight.functions import text, verdicts
from hearthlight.operators import fraud
from hearthlight.operators.barrier import evaluate_once
from hearthlight.operators.dedup import keep_first
from hearthlight.operators.distress import severe_details
from hearthlight.operators.sampling import SEED, uniform_sample
from hearthlight.session import cut_lineage


# --- benchmark ------------------------------------------------------------------------------


def benchmark_rows(items: DataFrame, flagged: DataFrame | None = None, key: str = "row_index"
                   ) -> DataFrame:
    """Score every labelled text; ``cascade_flag`` marks items the full cascade flags."""
    scored = fraud.scan(items, "text").withColumns({
        "tier1_flag": fraud.benchmark_escalates(),
    })
    if flagged is None:
        return scored.withColumn("cascade_flag", F.lit(False))
    hit = flagged.select(F.col("interaction_id").alias(key), F.lit(True).alias("_hit"))
    return scored.join(hit, key, "left").withColumn(
        "cascade_flag", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


# --- model agreement --------------------------------------------------------------------------


def evaluation_pool(df: DataFrame, size: int | None = None, seed: int = SEED,
                    facts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Clean, viable, distinct texts; a sample of ``size``, or all of them.

    ``facts`` adds what later steps need of a cleaned ``content``; the rows then go on without the text. For a sample
    ids are drawn, and only the drawn rows bring their text.
    """
    cleaned = evaluate_once(df, {"content": text.clean_text("content")}).filter(
        text.is_viable_training_text("content")
    )
    if facts is None and size is not None:
        drawn = cut_lineage(evaluation_pool(df, size, seed, lambda rows: rows.select("interaction_id", "content", "_text")))
        kept = cleaned.join(drawn, "interaction_id", "left_semi")
        return keep_first(kept, [F.sha2("content", 256)], ["interaction_id"])
    if facts is None:
        return keep_first(cleaned, [F.sha2("content", 256)], ["interaction_id"])
    slim = facts(cleaned.withColumn("_text", F.sha2("content", 256))).drop("content")
    pool = keep_first(slim, ["_text"], ["interaction_id"]).drop("_text")
    return pool if size is None else uniform_sample(cut_lineage(pool), size, "interaction_id", seed)


def score_pairs(pool: DataFrame, student: DataFrame, teacher: DataFrame) -> DataFrame:
    """Teacher and student scores side by side; rows without a valid teacher are left out.

    Scores of other rows are left out before they move. Of a pool with texts, only id and text are kept.
    """
    student = student.join(pool.select("interaction_id"), "interaction_id", "left_semi")
    t = teacher.filter("valid").select(
        "interaction_id", *[F.col(e).alias(f"teacher_{e}") for e in L.LABELS])
    s = S.normalize_scores(student).select(
        "interaction_id", *[F.col(e).alias(f"student_{e}") for e in L.LABELS])
    if "content" in pool.columns:
        pool = pool.select("interaction_id", "content")
    return pool.join(t, "interaction_id").join(s, "interaction_id")


def with_preview(rows: DataFrame) -> DataFrame:
    """The start of a text, as ``disagreements`` shows it."""
    return rows.withColumn("text_preview", text.preview("content", 80))


def disagreements(pairs: DataFrame, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Labels of both sides and the label they differ on most. Pairs have a text, or its preview."""
    act = dict(thresholds or L.DEFAULT_THRESHOLDS)
    deltas = {f"delta_{e}": d for e, d in S.score_deltas().items()}
    pairs = pairs if "text_preview" in pairs.columns else with_preview(pairs)
    rows = pairs.select(
        "interaction_id", "text_preview",
        S.active_labels(act, "teacher_").alias("teacher_labels"),
        S.active_labels(act, "student_").alias("student_labels"),
        *[d.alias(name) for name, d in deltas.items()],
    )
    rows = rows.withColumn("_label", S.largest_delta())
    delta = F.coalesce(*[F.when(F.col("_label") == e, F.col(f"delta_{e}")) for e in L.LABELS])
    return rows.select(
        "interaction_id", "text_preview", "teacher_labels", "student_labels",
        F.initcap("_label").alias("disagreement_label"), delta.alias("disagreement_delta"),
    )


def triage_pairs(pairs: DataFrame, verdict_table: DataFrame, raw: str = "sanity_raw",
                 thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Support decision of the reviewer and of the severe rules on the student's scores. Pairs have a text, or
    what ``with_text_signals`` reads from it."""
    scores = [f"student_{e}" for e in L.LABELS]
    student = pairs.select(
        *[c for c in pairs.columns if c not in scores and not c.startswith("teacher_")],
        *[F.col(c).alias(c.removeprefix("student_")) for c in scores])
    decided = severe_details(student, "content", thresholds).select(
        "interaction_id", F.col("severe.candidate").alias("student_support"))
    said = verdict_table.select("interaction_id", F.when(
        ~verdicts.is_error(raw), verdicts.boolean_verdict(raw)).alias("teacher_support"))
    return decided.join(said, "interaction_id", "left")


# --- ground truth -----------------------------------------------------------------------------


def reviewer_truth(df: DataFrame, verdict_table: DataFrame,
                   staff: fraud.StaffPolicy = fraud.StaffPolicy(), raw: str = "sanity_raw"
                   ) -> DataFrame:
    """Reviewer decision for every row: staff are False, unreadable answers are null."""
    answers = verdict_table.select("interaction_id", raw)
    said = F.when(~verdicts.is_error(raw), verdicts.line_verdict(raw))
    return df.join(answers, "interaction_id", "left").select(
        "interaction_id", F.when(staff.matches(), False).otherwise(said).alias("truth"))


def compare_sets(truth: DataFrame, tier1: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Membership of every id in the truth, the first tier and the confirmed set."""
    def mark(df: DataFrame, name: str) -> DataFrame:
        return df.select("interaction_id", F.lit(True).alias(name))

    joined = mark(truth.filter("truth"), "in_truth").join(
        mark(tier1, "in_tier1"), "interaction_id", "full").join(
        mark(confirmed, "in_confirmed"), "interaction_id", "full")
    flags = ("in_truth", "in_tier1", "in_confirmed")
    return joined.select(
        "interaction_id", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])


def set_outcome(members: DataFrame) -> DataFrame:
    """Each id as true positive, false positive or false negative, and missed by tier 1."""
    t, c = F.col("in_truth"), F.col("in_confirmed")
    return members.filter(t | c).select(
        "interaction_id",
        F.when(t & c, "true_positive").when(c, "false_positive").otherwise("false_negative")
        .alias("outcome"),
        (t & ~F.col("in_tier1")).alias("tier1_missed"),
    )


def set_metrics(members: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the confirmed set; empty sets count as one."""
    t, c = F.col("in_truth"), F.col("in_confirmed")
    counts = members.agg(
        F.count_if(t).alias("truth_count"), F.count_if("in_tier1").alias("tier1_count"),
        F.count_if(c).alias("verified_count"), F.count_if(t & c).alias("tp"),
        F.count_if(c & ~t).alias("fp"), F.count_if(t & ~c).alias("fn"),
        F.count_if(t & ~F.col("in_tier1")).alias("tier1_missed"),
    )
    p = F.col("tp") / F.greatest("verified_count", F.lit(1))
    r = F.col("tp") / F.greatest("truth_count", F.lit(1))
    return counts.withColumns({
        "precision": F.round(p, 4), "recall": F.round(r, 4),
        "f1": F.round(2 * p * r / F.greatest(p + r, F.lit(1e-9)), 4),
    })


def true_positives(confirmed: DataFrame, truth: DataFrame) -> DataFrame:
    return confirmed.select("interaction_id").intersect(
        truth.filter("truth").select("interaction_id"))


def false_positives(confirmed: DataFrame, truth: DataFrame) -> DataFrame:
    return confirmed.select("interaction_id").exceptAll(
        truth.filter("truth").select("interaction_id"))


# --- miss audit --------------------------------------------------------------------------------


def miss_sample(df: DataFrame, flagged: DataFrame, size: int = 50, seed: int = SEED) -> DataFrame:
    """Sample of rows that passed. Ids are drawn; only the drawn rows bring their text."""
    passed = df.select("interaction_id").join(flagged.select("interaction_id"), "interaction_id", "left_anti")
    drawn = cut_lineage(uniform_sample(passed, size, "interaction_id", seed))
    return df.join(drawn, "interaction_id", "left_semi")


def missed_scams(sample: DataFrame, verdict_table: DataFrame, raw: str = "scam_raw") -> DataFrame:
    """Adds ``missed``: the reviewer calls a sampled row a scam with confidence 0.80 or more."""
    answers = verdict_table.select("interaction_id", raw)
    joined = sample.join(answers, "interaction_id", "left").withColumn(
        "_answer", F.from_json(verdicts.extract_json(raw), verdicts.SCAM_ANSWER))
    missed = (
        (F.trim(F.coalesce("content", F.lit(""))) != "") & ~verdicts.is_error(raw)
        & F.col("_answer")["is_scam"]
        & (F.col("_answer")["confidence"].try_cast("double") >= 0.80)
    )
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    return joined.withColumns({
        "missed": F.coalesce(missed, F.lit(False)),
        "unanswered": ~blank & F.coalesce(verdicts.is_error(raw), F.lit(False)),
        "confidence": F.col("_answer")["confidence"].try_cast("double"),
        "reasoning": F.col("_answer")["reasoning"],
        "indicators": F.col("_answer")["indicators"],
    }).drop("_answer", raw)


def miss_stats(audited: DataFrame, passed_total: int | Column | None = None) -> DataFrame:
    """Sample size, rows that passed, misses, miss rate in percent, and whether the reviewer
    answered for every row that is not blank; blank rows stay in the denominator."""
    n, m = F.count(F.lit(1)), F.count_if("missed")
    stats = audited.agg(
        n.alias("sample_size"), m.alias("false_negatives_detected"),
        (F.count_if("unanswered") == 0).alias("reviewer_available"),
        F.round(100 * m / F.greatest(n, F.lit(1)), 2).alias("false_negative_rate"),
    )
    total = passed_total if isinstance(passed_total, Column) else F.lit(passed_total)
    return stats.withColumn("passed_total", total.cast("bigint"))


# --- staff feedback ------------------------------------------------------------------------------


def first_feedback(log: DataFrame) -> DataFrame:
    """The earliest verdict per flag; of equal times the lesser verdict."""
    return keep_first(log, ["flag_index"], ["ts", "verdict"])


def with_feedback(flags: DataFrame, log: DataFrame, key: str = "interaction_id") -> DataFrame:
    """Flags with the first staff verdict, if any."""
    said = first_feedback(log).select(
        F.col("flag_index").alias(key), F.col("verdict").alias("staff_verdict"))
    return flags.join(said, key, "left")
