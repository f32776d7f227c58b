"""Keep-first, latest-per-key and top-n-per-group, safe on hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def _order(columns: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def keep_first(df: DataFrame, keys: Sequence, order: Sequence) -> DataFrame:
    """First row per key in ``order``.

    Spark applies the rank limit before the shuffle as well (WindowGroupLimit), so a key that
    holds a third of all rows sends at most one row per map task.
    """
    ranked = df.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(order)))
    )
    return ranked.filter("_rank = 1").drop("_rank")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int,
                  salt_on: str) -> DataFrame:
    """First ``n`` rows per group in ``order``.

    The group is ranked in ``SALTS`` slices first: the global first n rows are among the first n
    of their slice, so the result is exact, and the last ranking of a group reads at most
    ``SALTS`` times n rows, however hot the group is and however many map tasks hold it.
    """
    order = _order(order)

    def ranked(frame: DataFrame, by: Sequence) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return frame.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")

    salt = F.pmod(F.xxhash64(F.col(salt_on)), F.lit(SALTS)).alias("_salt")
    return ranked(ranked(df.select("*", salt), [*keys, "_salt"]).drop("_salt"), keys)


def keep_first_hash(df: DataFrame, order: Sequence, key: str = "text_hash") -> DataFrame:
    """Drop later copies of the same text hash."""
    return keep_first(df, [key], order)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Last write per key; ``order`` puts the newest row first."""
    return keep_first(df, keys, order)
