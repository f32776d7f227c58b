"""Evaluate costly expressions exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add ``columns`` behind a one-row generator.

    A filter on a computed column is normally pushed below the projection that computes it, with
    the expression copied into the filter. For rule sets with hundreds of text tests that means
    the work is done twice or more. Filters do not pass a generator, so here they read the value.

    It also keeps planning fast: a pushed-down filter over many computed columns multiplies the
    constraints the optimizer derives, once per column. Columns that exist are replaced.
    """
    cells = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [F.col(name) for name in df.columns if name not in columns]
    return df.select(*kept, F.inline(F.array(cells)))
