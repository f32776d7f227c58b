"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The words of each source, its documents in hashed order, are cut into blocks of equal size. Every
source has an exact quota: all its blocks once for each full pass that its target holds, then
randomly permuted blocks, the last one cut to the word. A binary tree over the output shards splits
the quotas: each node draws how many blocks of each source go left from the multivariate
hypergeometric distribution, so shards differ as random draws without replacement do, while the sums
stay exact. A shard then takes its share of each source's permuted blocks, disjoint from all
others', and shuffles them within itself.

All of it is DataFrame functions on short rows; texts are read once, to count words. Running sums
go over three levels of hash buckets, so that a source with a third of all rows is never in one task.

Defined results: null text and text without words have size 0 and take nothing; a null source is
the last source; rows that repeat a document id, or have none, are documents of their own; draws depend on ids,
texts and seed only, so reruns agree. Equal rows are interchangeable. An empty table, or one
without words, gives targets of 0. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlight.llm.common import WORD, let, partitions, text_or_empty, word_count
from hearthlight.session import cut_lineage

#: Buckets of running sums hold about this many rows, and groups of buckets this many buckets.
FAN = 1024
_SLOTS = 1 << 31


@dataclass(frozen=True)
class Mix:
    """``documents``: doc_id, copy, size, source_size, target, taken, and shard and position of the
    first piece (null if nothing is taken). ``pieces``: shard, position, doc_id, copy, epoch, start,
    length (words of a document, in the shard's order)."""

    documents: DataFrame
    pieces: DataFrame


@dataclass(frozen=True)
class Settings:
    weights: tuple[int, ...] = (1, 2, 3)
    most_repeats: int = 3
    block_words: int = 1024
    shard_blocks: int = 2048
    seed: int = 17


def copy_number() -> Column:
    """Tells rows with one document id, or none, apart, the same way whenever they are read: by the
    hash of the text, and a number among rows that share it too."""
    number = F.row_number().over(
        Window.partitionBy("doc_id", "text_hash").orderBy("size", F.col("source").asc_nulls_last())
    )
    return F.struct(F.col("text_hash").alias("hash"), number.alias("number"))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a.doc_id.eqNullSafe(b.doc_id) & (a.copy == b.copy)


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "source", word_count(text_or_empty()).alias("size"),
        F.xxhash64(text_or_empty()).alias("text_hash"),
    )


def targets(sources: DataFrame, settings: Settings) -> DataFrame:
    """Adds sid (rank of the source) and target. One row a source, so one window task is enough."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in settings.weights])
    ranked = (
        sources.withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(weights, (F.col("sid") % len(settings.weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(settings.most_repeats)))
        .withColumn("limit", F.col("most") / F.col("weight"))
    )
    # In the order of most/weight, sources reach their limit one after another: a source is at its
    # limit if it lies below the share per weight that is left by those before it.
    order = Window.orderBy("limit", "sid")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    return (
        ranked.withColumn("share", left / weight)
        .withColumn("full", F.col("limit") <= F.col("share"))
        .withColumn("level", F.first(F.when(~F.col("full"), F.col("share")), ignorenulls=True).over(every))
        .withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("level")))
        .drop("weight", "most", "limit", "share", "full", "level")
    )


def running(rows: DataFrame, value: str, out: str, order: list[str]) -> DataFrame:
    """Adds the sum of ``value`` over the rows before this one in its group ``gid``.

    ``rows`` has gid, group_rows (about as many as the group has) and slot (a hash below 2^31, by
    which rows are ordered, then by ``order``).
    """
    fine = F.expr(f"slot * (1 + group_rows div {FAN}) div {_SLOTS}")
    rows = rows.withColumn("fine", fine).withColumn("coarse", F.expr(f"fine div {FAN}"))
    inner = Window.partitionBy("gid", "fine").orderBy("slot", *order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("gid", "coarse", "fine").agg(F.sum(value).alias("v"))
    in_coarse = Window.partitionBy("gid", "coarse").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    in_group = Window.partitionBy("gid").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    tops = sums.groupBy("gid", "coarse").agg(F.sum("v").alias("v")).select(
        "gid", "coarse", F.coalesce(F.sum("v").over(in_group), zero).alias("top")
    )
    offsets = sums.select(
        "gid", "coarse", "fine", F.coalesce(F.sum("v").over(in_coarse), zero).alias("mid")
    ).hint("merge").join(tops, ["gid", "coarse"]).select("gid", "fine", (F.col("mid") + F.col("top")).alias("offset"))
    # Rows may unfold from few: Spark's estimate of their size, by the file they come from, must not
    # lead to a broadcast.
    return (
        rows.withColumn("inner", F.coalesce(F.sum(value).over(inner), zero))
        .hint("merge").join(offsets, ["gid", "fine"])
        .withColumn(out, F.col("inner") + F.col("offset"))
        .drop("fine", "coarse", "inner", "offset")
    )


def _slot(seed: int, *parts: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 33)


def hypergeometric(population: Column, marked: Column, draws: Column, uniform: Column) -> Column:
    """How many of ``draws`` without replacement are marked, by inversion.

    Walks the probabilities within nine standard deviations of the mean; what lies beyond is less
    than a double can tell from zero. Needs population > 0.
    """
    def bounds(p: Column) -> Column:
        mean = p["n"] * p["k"] / p["all"]
        spread = F.sqrt(mean * (1 - p["k"] / p["all"]) * (p["all"] - p["n"]) / F.greatest(p["all"] - 1, F.lit(1.0)))
        reach = F.ceil(spread * 9).cast("double") + 10
        low = F.greatest(F.lit(0.0), p["n"] + p["k"] - p["all"], F.floor(mean - reach).cast("double"))
        high = F.least(p["k"], p["n"], F.ceil(mean + reach).cast("double"))
        return F.struct(
            p["all"].alias("all"), p["k"].alias("k"), p["n"].alias("n"), p["u"].alias("u"),
            low.cast("long").alias("low"), high.cast("long").alias("high"),
        )

    def following(p: Column, x: Column, weight: Column) -> Column:
        x = x.cast("double")
        return weight * (p["k"] - x) * (p["n"] - x) / ((x + 1) * (p["all"] - p["k"] - p["n"] + x + 1))

    def draw(p: Column) -> Column:
        values = F.sequence(p["low"], p["high"])
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("w"))
        step = lambda s, x: F.struct((s["sum"] + s["w"]).alias("sum"), following(p, x, s["w"]).alias("w"))
        total = F.aggregate(values, start, step, lambda s: s["sum"])

        def find(goal: Column) -> Column:
            first = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("w"), F.lit(-1).cast("long").alias("at"))
            return F.aggregate(
                values, first,
                lambda s, x: F.struct(
                    (s["sum"] + s["w"]).alias("sum"), following(p, x, s["w"]).alias("w"),
                    F.when((s["at"] < 0) & (s["sum"] + s["w"] >= goal), x).otherwise(s["at"]).alias("at"),
                ),
                lambda s: F.when(s["at"] < 0, p["high"]).otherwise(s["at"]),
            )
        return let(total * p["u"], find)

    given = F.struct(
        population.cast("double").alias("all"), marked.cast("double").alias("k"),
        draws.cast("double").alias("n"), uniform.alias("u"),
    )
    return let(let(given, bounds), draw)


def split_quotas(sources: DataFrame, shards: int, draws: int, seed: int) -> DataFrame:
    """shard, sid, first, quota: shard takes the source's draws first, first + 1, ... (quota of them)."""
    quotas = F.transform(
        F.sort_array(F.collect_list(F.struct("sid", "draws"))),
        lambda s: F.struct(s["sid"].alias("sid"), F.lit(0).cast("long").alias("first"), s["draws"].alias("quota")),
    )
    nodes = sources.agg(quotas.alias("quotas")).select(
        F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "quotas"
    )
    before = lambda shard: F.expr(f"{shard} * {draws}L div {shards}L")
    for level in range(max(0, (shards - 1).bit_length())):
        nodes = nodes.withColumn("mid", F.expr("(lo + hi + 1) div 2"))
        start = F.struct(
            (before("hi") - before("lo")).alias("population"), (before("mid") - before("lo")).alias("room"),
            F.array().cast("array<bigint>").alias("left"),
        )

        def step(acc: Column, part: Column) -> Column:
            uniform = (F.pmod(F.xxhash64(F.lit(seed), "lo", "hi", part["sid"]), F.lit(1 << 52)) + 0.5) / float(1 << 52)
            drawn = F.when(
                (acc["room"] > 0) & (part["quota"] > 0),
                hypergeometric(acc["population"], part["quota"], acc["room"], uniform),
            ).otherwise(F.lit(0).cast("long"))
            return let(drawn, lambda x: F.struct(
                (acc["population"] - part["quota"]).alias("population"), (acc["room"] - x).alias("room"),
                F.concat(acc["left"], F.array(x)).alias("left"),
            ))

        left = F.aggregate("quotas", start, step, lambda acc: acc["left"])
        part = lambda first, quota: lambda q, n: F.struct(
            q["sid"].alias("sid"), first(q, n).alias("first"), quota(q, n).alias("quota")
        )
        halves = F.array(
            F.struct(F.col("lo"), F.col("mid").alias("hi"), F.zip_with(
                "quotas", "left", part(lambda q, n: q["first"], lambda q, n: n)).alias("quotas")),
            F.struct(F.col("mid").alias("lo"), F.col("hi"), F.zip_with(
                "quotas", "left", part(lambda q, n: q["first"] + n, lambda q, n: q["quota"] - n)).alias("quotas")),
        )
        leaf = F.array(F.struct("lo", "hi", "quotas"))
        nodes = (
            nodes.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, left))
            .select(F.explode(F.when(F.col("left").isNull(), leaf).otherwise(halves)).alias("node"))
            .select("node.*")
        )
        if level % 4 == 3:  # the next levels start from written nodes, dealt over the cluster
            nodes = cut_lineage(nodes.repartition("lo"))
    return nodes.select(F.col("lo").alias("shard"), F.inline("quotas")).where("quota > 0")


def mix(docs: DataFrame, settings: Settings = Settings()) -> Mix:
    spark, words, seed = docs.sparkSession, settings.block_words, settings.seed
    rows = cut_lineage(sized(docs).withColumn("copy", copy_number()))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("group_rows"))
    sources = cut_lineage(
        targets(sums, settings)
        .withColumn("take", F.round("target").cast("long"))
        .withColumn("blocks", F.expr(f"(source_size + {words - 1}) div {words}"))
        .withColumn("passes", F.expr("if(source_size > 0, take div source_size, 0L)"))
        .withColumn("rest", F.expr("take - passes * source_size"))
        .withColumn("rest_blocks", F.expr(f"(rest + {words - 1}) div {words}"))
        .withColumn("draws", F.expr("passes * blocks + rest_blocks"))
    )
    draws = sources.agg(F.sum("draws")).first()[0] or 0
    shards = max(1, -(-draws // settings.shard_blocks))
    named = rows.join(sources, rows.source.eqNullSafe(sources.source)).drop(sources.source)

    # Which words of its source a document holds, and the blocks they lie in.
    placed = running(
        named.where("size > 0").select(
            F.col("sid").alias("gid"), "group_rows", "doc_id", "copy", "size",
            _slot(seed, F.lit("document"), "doc_id", "text_hash").alias("slot"),
        ),
        "size", "first", ["doc_id", "copy"],
    )
    held = placed.select(
        F.col("gid").alias("sid"), "doc_id", "copy", "first", "size",
        F.explode(F.expr(f"sequence(first div {words}, (first + size - 1) div {words})")).alias("block"),
    )

    # The draws of each source: its blocks in a new permutation for each pass, the short last block
    # at the end, so that the first n blocks of a pass hold exactly n times the words of a block.
    chunks = sources.where("draws > 0").select(
        "sid", "blocks", "source_size", "passes", "rest", "rest_blocks",
        F.explode(F.expr("sequence(0L, passes - if(rest = 0, 1, 0))")).alias("epoch"),
        F.expr("(blocks - 1) div 4096").alias("last_chunk"),
    ).withColumn("chunk", F.explode(F.expr("sequence(0L, last_chunk)"))).repartition(
        partitions(spark), "sid", "epoch", "chunk"
    )
    blocks = chunks.withColumn(
        "block", F.explode(F.expr("sequence(chunk * 4096, least(blocks, (chunk + 1) * 4096) - 1)"))
    ).drop("chunk", "last_chunk")
    short = F.expr(f"block = blocks - 1 and source_size % {words} != 0")
    ranked = running(
        blocks.where(~short).select(
            F.struct("sid", "epoch").alias("gid"), F.col("blocks").alias("group_rows"), "block", "blocks",
            "passes", "rest", "rest_blocks", F.lit(1).cast("long").alias("one"),
            _slot(seed, F.lit("block"), "sid", "epoch", "block").alias("slot"),
        ),
        "one", "rank", ["block"],
    ).select("gid.sid", "gid.epoch", "block", "blocks", "passes", "rest", "rest_blocks", "rank")
    last = blocks.where(short).select(
        "sid", "epoch", "block", "blocks", "passes", "rest", "rest_blocks",
        (F.col("blocks") - 1).alias("rank"),
    )
    drawn = ranked.unionByName(last).where("epoch < passes or rank < rest_blocks").select(
        "sid", "epoch", "block", F.expr("epoch * blocks + rank").alias("draw"),
        F.expr(f"if(epoch < passes, {words}L, least({words}L, rest - rank * {words}))").alias("limit"),
    )
    shares = split_quotas(sources.select("sid", "draws"), int(shards), int(draws), seed)
    # Few rows unfold into all draws, so they are dealt over the cluster first.
    dealt = shares.repartition(partitions(spark), "shard").select("shard", "sid", F.explode(F.expr("sequence(first, first + quota - 1)")).alias("draw"))
    taken = dealt.hint("merge").join(drawn, ["sid", "draw"])

    pieces = held.hint("merge").join(taken, ["sid", "block"]).select(
        "shard", "sid", "draw", "epoch", "doc_id", "copy", "first", "size",
        F.expr(f"greatest(first, block * {words})").alias("from"),
        F.expr(f"least(first + size, block * {words} + limit)").alias("to"),
    ).where("to > from").select(
        "shard", "sid", "draw", "doc_id", "copy", "epoch", F.expr("from - first").alias("start"),
        F.expr("to - from").alias("length"), "from",
    )
    pieces = cut_lineage(pieces)
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "sid", "draw"), "sid", "draw", "from")
    pieces = pieces.select(
        "shard", (F.row_number().over(shuffled) - 1).alias("position"), "doc_id", "copy", "epoch",
        "start", "length",
    )
    by_document = pieces.groupBy("doc_id", "copy").agg(
        F.sum("length").alias("taken"), F.min(F.struct("shard", "position")).alias("first")
    )
    documents = named.join(by_document, _same_row(named, by_document), "left").select(
        named.doc_id, named.copy, "size", "source_size", "target",
        F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first.shard", "first.position",
    )
    return Mix(documents, pieces)


def mixed_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: one row for each document and pass
    that takes words of it. A document that a pass takes whole keeps its text; of others, the words
    taken are joined by one space. ``n_chars``, if there, follows the text."""
    parts = (
        mix(docs, settings).pieces.groupBy("doc_id", "copy", "epoch")
        .agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("ranges"), F.sum("length").alias("words"))
    )
    # The document's own columns stay in a struct, whatever their names.
    key = docs.select(
        "doc_id", "source", "text", word_count(text_or_empty()).alias("size"),
        F.xxhash64(text_or_empty()).alias("text_hash"), F.struct("*").alias("row"),
    ).withColumn("copy", copy_number())
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = let(words, lambda w: F.array_join(F.flatten(F.transform(
        "ranges", lambda r: F.slice(w, (r["start"] + 1).cast("int"), r["length"].cast("int"))
    )), " "))
    out = key.join(parts, _same_row(key, parts)).withColumn(
        "text", F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(cut)
    )
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
