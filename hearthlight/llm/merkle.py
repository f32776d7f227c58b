"""A Merkle manifest of a table: one tree a group, and a tree over the groups' roots.

Every level is a chain of equijoins of the level with itself: nodes stand in runs of ``width``, and
the rows of slot zero look for their siblings by computed place (own place plus 1, 2, ...; with two
slots that is the place with its last bit turned). A row of slot zero then holds its whole run and
emits the parent. On the way down each run joins the path of its parent, so that digests of high
levels, which all leaves below share, move once a node and not once a leaf.

Leaves are numbered by a sort that ranges over all tasks, so a group with a third of all rows is
spread like any other; texts are read once, for their digests. Nodes are staged in a folder a slot:
each sibling join reads only its own.

Defined results: nulls are fields of their own (``-``), and a null group is a group, before all
others; leaves without an id come first in their group, and leaves that share an id follow by digest;
rows that are repeated whole are leaves of their own; a null id is never tampered with. An empty text
is ``0:``; long texts are hashed whole. A lone leaf is its group's root, and a lone group's root the
root. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlight.llm.common import lower_ascii
from hearthlight.session import cut_lineage, new_folder

EMPTY = "''"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WIDTH = 8


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts one after another, as lowercase hex."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Length in UTF-8 bytes, a colon and the value; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hex(binary: Column | str) -> Column:
    return F.lower(F.hex(binary))


def _parent(width: int) -> Column:
    return F.expr(f"idx div {width}")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds idx, the place among the rows of one ``tree`` in ``order``, and n, their number.

    One sort over all tasks; a row's place is its place in its task, plus what earlier tasks hold of
    the tree, a table of one row a task and tree.
    """
    # Equal rows are split over tasks by where they were read.
    noisy = rows.withColumn("noise", F.monotonically_increasing_id())
    placed = noisy.orderBy("tree", *order, "noise").drop("noise").withColumn("at", F.monotonically_increasing_id())
    placed = cut_lineage(placed.withColumn("task", F.shiftrightunsigned("at", 33)))
    held = placed.groupBy("tree", "task").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("tree").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    held = cut_lineage(held.select(
        "tree", "task", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("tree")).alias("n"),
    ))
    return placed.join(held, ["tree", "task"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "task", "shift")


def _staged(nodes: DataFrame, width: int) -> DataFrame:
    path = new_folder(nodes.sparkSession, "nodes")
    nodes = nodes.withColumn("slot", F.expr(f"cast(idx % {width} as int)"))
    nodes.write.partitionBy("slot").parquet(path)
    return nodes.sparkSession.read.schema(nodes.schema).parquet(path)


def _runs(nodes: DataFrame, held: list[str], width: int) -> DataFrame:
    """tree, parent, n and a struct s0, s1, ... of what each slot holds (null past the last node)."""
    def slot(k: int) -> DataFrame:
        return nodes.where(F.col("slot") == k).select(
            "tree", _parent(width).alias("parent"), F.struct(*held).alias(f"s{k}"), *(["n"] if k == 0 else [])
        )
    runs = slot(0)
    for k in range(1, width):
        runs = runs.join(slot(k), ["tree", "parent"], "left")
    return runs


def _hexes(slots: range) -> str:
    return f"concat({', '.join(f'coalesce(lower(hex(s{k}.digest)), {EMPTY})' for k in slots) or EMPTY})"


def _children(width: int, data: bool) -> Column:
    """The nodes of a run, each with its siblings before and after it on top of the parent's path."""
    def child(k: int) -> str:
        step = f"named_struct('left', {_hexes(range(k))}, 'right', {_hexes(range(k + 1, width))})"
        held = f"'digest', s{k}.digest, 'data', s{k}.data, " if data else ""
        return f"named_struct('idx', parent * {width} + {k}, {held}'path', concat(array({step}), path), 'there', s{k} is not null)"

    return F.expr(f"inline(array({', '.join(map(child, range(width)))}))")


def climb(leaves: DataFrame, width: int = WIDTH) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """From leaves (tree, idx, n, digest, data) up to one node a tree: staged leaves, the runs of every
    level, and the roots (tree, digest, level)."""
    nodes = leaves = _staged(leaves, width)
    most, levels, roots = leaves.agg(F.max("n")).first()[0] or 0, [], []
    for level in range(64):
        roots.append(nodes.where("n = 1").select("tree", "digest", F.lit(level).alias("level")))
        if most <= 1:
            break
        held = ["digest", "data"] if level == 0 else ["digest"]
        runs = cut_lineage(_runs(nodes.where("n > 1"), held, width))
        levels.append(runs)
        nodes = _staged(runs.select(
            "tree", F.col("parent").alias("idx"), F.expr(f"(n + {width - 1}) div {width}").alias("n"),
            F.expr(f"unhex(sha2({_hexes(range(width))}, 256))").alias("digest"),
        ), width)
        most = -(-most // width)
    every = roots[0]
    for more in roots[1:]:
        every = every.unionByName(more)
    return leaves, levels, cut_lineage(every)


def descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, width: int = WIDTH) -> DataFrame:
    """tree, digest, data, the columns of ``tops``, and path, the (left, right) siblings of each level up.

    ``tops``: tree, level (of its root), path (above the root), and columns that every leaf gets.
    """
    more = [c for c in tops.columns if c not in ("tree", "level", "path")]

    def at_root(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("idx"), "path", *more)

    paths = at_root(len(levels))
    for level in range(len(levels) - 1, -1, -1):
        above = levels[level].join(paths.withColumnRenamed("idx", "parent"), ["tree", "parent"])
        below = above.select("tree", *more, _children(width, data=level == 0)).where("there").drop("there")
        if level == 0:
            lone = leaves.where("n = 1").join(at_root(0).drop("idx"), "tree")
            columns = ["tree", "digest", "data", "path", *more]
            return below.select(columns).unionByName(lone.select(columns))
        paths = cut_lineage(below.unionByName(at_root(level)))
    return leaves.join(at_root(0).drop("idx"), "tree").select("tree", "digest", "data", "path", *more)


def manifest(
    docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS,
    carried: dict[str, Column] | None = None, width: int = WIDTH,
) -> DataFrame:
    """One row per document: the key, leaf, subroot, root (hex), path, and the ``carried`` columns.

    ``path`` holds for each level, from the leaf to the root, the hex digests of the siblings before
    and after the node. ``fold`` leads from a leaf along its path to the root.
    """
    order = F.col("data")[key].asc_nulls_first()
    data = F.struct(F.col(key), *[c.alias(name) for name, c in (carried or {}).items()])
    rows = docs.select(
        F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.unhex(digest(*[field(F.col(c)) for c in fields])).alias("digest"), data.alias("data"),
    )
    leaves, levels, roots = climb(numbered(rows, [order, F.col("digest")]), width)
    # The roots of the groups are the leaves of one more tree, in the order of the groups.
    groups = roots.select(F.lit("").alias("tree"), "digest", F.struct(F.col("tree").alias("group"), "level").alias("data"))
    upper, upper_levels, top = climb(numbered(groups, [F.col("data.group")]), width)
    top = top.select("tree", "level", F.col("digest").alias("root"), F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path"))
    above = descend(upper, upper_levels, top, width)
    tops = cut_lineage(above.select(
        F.col("data.group").alias("tree"), F.col("data.level").alias("level"), F.col("digest").alias("subroot"), "root", "path"
    ))
    return descend(leaves, levels, tops, width).select(
        "data.*", _hex("digest").alias("leaf"), _hex("subroot").alias("subroot"), _hex("root").alias("root"), "path"
    )


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, checked against documents of which each third is tampered with:
    where 3 divides the id's CRC-32, A-Z in the text are lower case."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    changed = [field(lower_ascii(F.col(c)) if c == "text" else F.col(c)) for c in FIELDS]
    tampered = F.when(hit, F.unhex(digest(*changed)))
    rows = manifest(docs, carried={"tampered": tampered}).withColumn(
        "folded_root", fold(F.coalesce(_hex("tampered"), F.col("leaf")), F.col("path"))
    )
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
