"""Tables dealt into buckets by key when they are written, so that joins on it need no shuffle later.

All tables of a cascade (interactions, scores, verdicts, accounts) get the same key and number of
buckets; Spark then joins bucket with bucket, sorted as they lie. Choose a bucket of some hundred
megabytes: buckets are the tasks of all such joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def store(rows: DataFrame, name: str, folder: str, buckets: int, key: str = "interaction_id") -> DataFrame:
    """Writes rows to ``folder`` as table ``name``. Rows are dealt by the key first, so that a bucket
    is one file and not one a task."""
    dealt = rows.repartition(buckets, key)
    dealt.write.mode("overwrite").option("path", folder).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return rows.sparkSession.table(name)


def reopen(spark: SparkSession, schema: str, name: str, folder: str, buckets: int, key: str = "interaction_id") -> DataFrame:
    """The table of an earlier session, whose catalog did not outlive it. ``schema`` is DDL text."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{name}` ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
        f"INTO {int(buckets)} BUCKETS LOCATION '{folder}'"
    )
    return spark.table(name)
