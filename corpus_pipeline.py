"""A training corpus from ``documents``: stages that each write their rows and read them again.

SQL cannot express the stages (a trained model, a tokenizer, seeded draws), so there is no oracle;
the tests hold each stage, and the whole, against brute force on a small table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthlight.llm import stages
from hearthlight.llm.common import table
from hearthlight.session import cut_lineage

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.toxicity),
    ("exact dedup", stages.exact),
    ("near dedup", stages.near),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
