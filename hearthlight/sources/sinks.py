"""Writing results: CSV, JSON, snapshots, alert payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlight import schema
from hearthlight.functions.text import escape_html
from hearthlight.operators.trends import latest_snapshots
from hearthlight.sources.commits import FolderTable


def flat(df: DataFrame) -> DataFrame:
    """Arrays as ``a, b`` text, so a frame fits into CSV."""
    arrays = {name for name, kind in df.dtypes if kind.startswith("array<string")}
    return df.select(*[
        F.array_join(c, ", ").alias(c) if c in arrays else F.col(c) for c in df.columns
    ])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat(df).write.mode(mode).csv(path, header=True, escape='"')


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object per (year, week), in a folder per week."""
    report.write.mode("overwrite").partitionBy("year", "week").json(path)


def append_snapshot(snapshot: DataFrame, path: str) -> None:
    """Add a weekly snapshot; readers take the newest row per week."""
    snapshot.select(*schema.SNAPSHOT.fieldNames()).write.mode("append").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.SNAPSHOT).parquet(path)


class Snapshots:
    """Weekly snapshots in commits: a batch counts once, however often it is sent, and compaction keeps
    the newest row per week while readers go on."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = FolderTable(spark, path)

    def append(self, snapshot: DataFrame, name: str) -> bool:
        return self.table.add(snapshot.select(*schema.SNAPSHOT.fieldNames()), name)

    def read(self) -> DataFrame:
        return latest_snapshots(self.table.rows(schema.SNAPSHOT))

    def compact(self) -> bool:
        return self.table.compact(schema.SNAPSHOT, latest_snapshots)


def critical_alert(rows: DataFrame, keys: list[str], top: int = 5, shown: int = 4) -> DataFrame:
    """Per key, the number of critical flags, the first ``top`` as lines, and the overflow.

    Ranking comes first, so only ``top`` rows per key are ever gathered into one text.
    """
    from hearthlight.operators.dedup import top_per_group

    order = [F.desc(F.coalesce("confidence", F.lit(0.0))), F.desc("heuristic_score"),
             "interaction_id"]
    critical = rows.filter("severity = 'CRITICAL'")
    names = F.array_join(F.slice("indicators", 1, shown), ", ")
    line = F.concat(
        "commenter_name", F.lit(" ("), "community_name", F.lit(") conf="),
        F.coalesce(F.format_string("%.2f", "confidence"), F.lit("N/A")),
        F.lit(" indicators: "), F.when(names == "", "N/A").otherwise(names),
    )
    first = top_per_group(critical, keys, order, top, salt_on="interaction_id")
    entry = F.struct(
        (-F.coalesce("confidence", F.lit(0.0))).alias("c"),
        (-F.col("heuristic_score")).alias("h"), F.col("interaction_id").alias("i"),
        line.alias("line"),
    )
    lines = first.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    counts = critical.groupBy(*keys).agg(F.count(F.lit(1)).alias("critical_flags"))
    return counts.join(lines, keys).select(
        *keys, "critical_flags",
        F.array_join(F.transform("entries", lambda e: e["line"]), "\n").alias("lines"),
        F.greatest(F.col("critical_flags") - top, F.lit(0)).alias("overflow"),
    )


def severe_alert(rows: DataFrame) -> DataFrame:
    """Verified severe rows with every text field escaped for HTML mail."""
    fields = ("commenter_name", "commenter_email", "community_name", "emotion", "comment")
    return rows.select(
        "interaction_id", *[escape_html(F.coalesce(c, F.lit("N/A"))).alias(c) for c in fields],
        "score", "total_negative",
    )


def feedback_export(log: DataFrame) -> DataFrame:
    return log.select(
        "ts", "flag_index", "commenter_name", "verdict", "confidence", "comment_preview"
    )
