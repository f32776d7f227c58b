"""Exact duplicates by skew-safe combining.

Three combining steps, each keyed by digest *and* full text, so that only equal texts are ever
merged: within each map task (Spark's partial aggregate), across the tasks of one salt, and across
salts. A text copied into a third of all rows leaves each task as one row and each salt as one row.

Defined results: a null text counts as empty; empty texts are copies of each other; rows that
repeat a document id count each; of equal texts the row with the largest id stays, and where that
id is itself repeated, every row with it stays; a row without an id counts in its group, whose
``keep_id`` is that of the others (null without others), and its own ``kept`` is null; texts of any
length are compared whole; columns besides the id and text are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlight.llm.common import lower_ascii, text_or_empty
from hearthlight.session import cut_lineage


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_duplicates(
    docs: DataFrame, salts: int = 16, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select("doc_id", lower_ascii(text_or_empty()).alias("norm")).select(
        "doc_id", "norm", digest(F.col("norm")).alias("digest")
    )
    by_salt = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    )
    groups = cut_lineage(
        by_salt.groupBy("digest", "norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .select("digest", "keep_id", "group_size", sha256(F.col("norm")).alias("text_sha256"))
    )
    # A digest with one group has been compared in full above: its rows are all equal, and the
    # digest alone finds their group again. Digests of several texts, if any, are grouped and
    # found again by the text itself.
    mixed = cut_lineage(groups.groupBy("digest").count().where("count > 1").select("digest"))
    plain = rows.select("doc_id", "digest").join(groups.join(mixed, "digest", "left_anti"), "digest")
    clashing = rows.join(mixed, "digest", "left_semi")
    apart = clashing.groupBy("digest", "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    exact = clashing.join(apart, ["digest", "norm"]).withColumn("text_sha256", sha256(F.col("norm")))
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    return plain.select(columns).unionByName(exact.select(columns)).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
