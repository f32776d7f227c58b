"""Connected components of links between documents, without gathering any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlight.session import cut_lineage


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the least node that each node of ``edges`` (a, b) reaches.

    Alternates two steps until nothing changes: every node links its greater neighbours, then its
    lesser ones, to the least node around it. The minimum is an aggregate that Spark combines
    before the shuffle, and links only ever move to smaller nodes, so a node with very many links
    costs no more than its links. Self-links and repeated links do no harm; without links there are
    no rows.
    """
    now = cut_lineage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    )
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both).select("u", F.least("u", "least").alias("least"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
            .where("u != v").distinct()
        )
        least = _least_neighbour(large)
        small = (
            large.join(least, "u")
            .select(F.inline(F.array(
                F.struct(F.col("v").alias("u"), F.col("least").alias("v")),
                F.struct(F.col("u"), F.col("least").alias("v")),
            )))
            .where("u != v").distinct()
        )
        now = cut_lineage(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
