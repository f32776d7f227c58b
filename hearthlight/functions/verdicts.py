"""Reading reviewer answers: JSON bodies and True/False verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlight.functions.text import col, strip

# Fields of the two reviewer answers; "pattern" names the recognised community pattern.
SCAM_ANSWER = (
    "is_scam boolean, confidence string, recommended_action string, reasoning string, "
    "reasons array<string>, indicators array<string>"
)
CONTEXT_ANSWER = "context_verdict string, pattern string, reasoning string"


def extract_json(value) -> Column:
    """JSON body of an answer: a fenced block, else the outermost braces, else the text."""
    text = strip(value)
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    first = F.locate("{", text)
    last = F.length(text) - F.locate("}", F.reverse(text)) + 1
    braces = (first > 0) & F.contains(text, F.lit("}")) & (last > first)
    return (
        F.when(fenced != "", fenced)
        .when(braces, F.substring(text, first, last - first + 1))
        .otherwise(text)
    )


def json_fields(value) -> Column:
    """The object's fields as text, or null when the answer is not a JSON object."""
    return F.from_json(col(value), "map<string,string>")


def is_error(value) -> Column:
    return F.startswith(col(value), F.lit("ERROR:"))


def boolean_verdict(value) -> Column:
    """Tolerant reading: an explicit VERDICT first, then a lone TRUE or FALSE, else null."""
    text = F.translate(F.upper(col(value)), "*# ", "")
    yes, no = F.contains(text, F.lit("TRUE")), F.contains(text, F.lit("FALSE"))
    return (
        F.when(F.contains(text, F.lit("VERDICT:TRUE")), True)
        .when(F.contains(text, F.lit("VERDICT:FALSE")), False)
        .when(yes & ~no, True)
        .when(no & ~yes, False)
    )


def line_verdict(value) -> Column:
    """Strict reading: the first line that starts with VERDICT: and says TRUE or FALSE."""
    said = F.regexp_extract(
        F.upper(col(value)), r"(?m)^\s*VERDICT:[^\S\r\n]*(TRUE|FALSE)", 1
    )
    return F.when(said == "TRUE", True).when(said == "FALSE", False)
