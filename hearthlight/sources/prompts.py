"""Prompt tables for reviewers that work outside Spark, keyed by interaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlight.functions.text import cap_chars, col
from hearthlight.labels import LABELS

NEED_PROMPT = (
    "Decide whether the comment below shows a real need or distress of its author that staff "
    "should look at. Routine questions, thanks, celebration and small talk are False; hardship, "
    "a request for help tied to it, or signs of not coping are True. When hardship is plausible "
    "but unclear, prefer True.\n"
    "Answer in two lines:\nREASONING: one or two sentences\nVERDICT: True or False\n\n"
    "Comment: "
)
SCAM_PROMPT = (
    "Decide whether the comment below is likely a scam, fraud or predatory solicitation. "
    "Networking, peer support, real services and shared contact data alone are not scams; "
    "requests for gift cards, crypto, codes, account data or moving money are.\n"
    "Answer with one JSON object: reasoning (text, first), is_scam (boolean), confidence "
    "(0 to 1), indicators (list of text), recommended_action (allow, flag_for_review or "
    "block).\n\nComment: "
)
CONTEXT_PROMPT = (
    "The comment below was flagged as a possible scam. Decide whether it is normal talk of "
    "this community (moves, deployments, benefits, local services, peer support) or still "
    "predatory. Community words do not excuse requests for money, codes or account data.\n"
    "Answer with one JSON object: reasoning (text), context_verdict (context_pass or "
    "context_fail), confidence (0 to 1), pattern (name of the community pattern, or "
    "predatory).\n\nComment: "
)
TEACHER_PROMPT = (
    "Score the emotions of the comment below from its text alone. Give each label a value from "
    "0 to 1, keep most near 0, and use 0.5 and more only for strong evidence.\n"
    "Answer with one JSON object: reasoning (text, first), then these labels: "
    + ", ".join(sorted(LABELS)) + ".\n\nComment: "
)


def prompt(template: str, content, max_chars: int | None = None) -> Column:
    """Template followed by the quoted text."""
    body = col(content) if max_chars is None else cap_chars(content, max_chars)
    return F.concat(F.lit(template + '"'), F.coalesce(body, F.lit("")), F.lit('"'))


def model_context() -> Column:
    """Advisory model signals of a severe candidate as one line."""
    def listed(name: str) -> Column:
        joined = F.array_join(name, ", ")
        return F.when(joined == "", "none").otherwise(joined)

    return F.concat(
        F.lit("dominant_emotion="), "emotion",
        F.lit("; dominant_score="), F.col("score").cast("string"),
        F.lit("%; cumulative_negative_load="), F.col("total_negative").cast("string"),
        F.lit(" pts; avg_negative_intensity="), F.col("avg_negative_intensity").cast("string"),
        F.lit("%; reason_flags="), listed("reason_flags"),
        F.lit("; rare_hints="), listed("rare_hints"),
        F.lit("; support_need_hits="), F.size("support_need_hits").cast("string"),
    )


def need_prompts(candidates: DataFrame) -> DataFrame:
    """Prompt per severe candidate, with the model signals appended as advice."""
    advice = F.concat(
        F.lit("\n\nModel signals (advisory, do not rely on them alone):\n"), model_context()
    )
    return candidates.select(
        "interaction_id", model_context().alias("model_context"),
        F.concat(prompt(NEED_PROMPT, "comment"), advice).alias("prompt"),
    )


def scam_prompts(candidates: DataFrame) -> DataFrame:
    return candidates.select("interaction_id", prompt(SCAM_PROMPT, "comment").alias("prompt"))


def context_prompts(rows: DataFrame) -> DataFrame:
    return rows.select("interaction_id", prompt(CONTEXT_PROMPT, "comment").alias("prompt"))


def teacher_prompts(sample: DataFrame, content: str = "content") -> DataFrame:
    return sample.select("interaction_id", prompt(TEACHER_PROMPT, content).alias("prompt"))


def write_prompts(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)
