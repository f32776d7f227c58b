"""Document fingerprints by one-permutation MinHash.

Every shingle of five words is hashed once; its high bits choose one of 256 bins, which keeps its
least hash. A bin without a shingle probes other bins, in an order of its own, and copies the first
one that has one (optimal densification), so that bins agree with the probability of the shingle
sets' similarity. Of each bin the low four bits are stored, sixteen bins to a long; the share of
bins that agree by chance, one in sixteen, is taken out of the likeness.

All of it is built-in functions on arrays within a row.

Defined results: null text is empty; a text with fewer than five words has its whole sequence as
the one shingle; one without words has a fingerprint of its own, which is like itself and unlike
others; equal texts have equal fingerprints, however often and in whichever row they occur. Extra
columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlight.llm.common import let, partitions, text_or_empty
from hearthlight.session import cut_lineage

BINS, BITS, WORDS = 256, 4, 5
#: Bits of a hash below the bin number, of the 63 bits that are used.
_LOW = 63 - (BINS - 1).bit_length()
_EMPTY = (1 << _LOW) - 1
_PER_LONG = 64 // BITS
#: Probes before the remaining order is searched at once.
_PROBES = 6


def _shingle_hashes(words: Column) -> Column:
    def each(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)])

    n = F.size(words)
    return (
        F.when(n >= WORDS, F.transform(F.sequence(F.lit(0), n - WORDS), each))
        .when(n > 0, F.array(F.xxhash64(F.array_join(words, " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def _least_by_bin(hashes: Column) -> Column:
    """One value a bin, in order; all low bits are set where a bin is empty."""
    # Each bin gets its greatest value as a sentinel; after sorting, the first value of a bin is it
    # only if the bin has no other.
    sentinels = F.expr(f"transform(sequence(0L, {BINS - 1}L), b -> shiftleft(b, {_LOW}) + {_EMPTY}L)")
    every = F.sort_array(F.concat(
        F.transform(hashes, lambda h: F.shiftrightunsigned(h, 1)), sentinels
    ))
    return let(every, lambda s: F.filter(
        s, lambda h, i: (i == 0) | (F.shiftright(h, _LOW) != F.shiftright(F.get(s, i - 1), _LOW))
    ))


def _is_empty(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_EMPTY)) == _EMPTY


def _densified(bins: Column) -> Column:
    draw = random.Random(11)
    orders = [[draw.randrange(BINS) for _ in range(BINS)] for _ in range(_PROBES)]

    def fill(filled: Column) -> Column:
        def value(v: Column, i: Column) -> Column:
            tried = F.when(~_is_empty(v), v)
            for order in orders:
                other = F.get(bins, F.get(F.lit(order), i))
                tried = tried.when(~_is_empty(other), other)
            # The rest of the probe order: the filled bin with the least hash for this bin.
            found = F.array_min(F.transform(filled, lambda w: F.struct(
                F.xxhash64(i, F.shiftright(w, _LOW)).alias("rank"), w.alias("value")
            )))["value"]
            return tried.otherwise(F.coalesce(found, F.lit(_EMPTY)))

        return F.transform(bins, value)

    return let(F.filter(bins, lambda v: ~_is_empty(v)), fill)


def _packed(bins: Column) -> Column:
    low = F.lit((1 << BITS) - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)), lambda at: F.aggregate(
        F.slice(bins, at * _PER_LONG + 1, _PER_LONG), F.lit(0).cast("long"),
        lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v.bitwiseAND(low)),
    ))


def fingerprint(text: Column) -> Column:
    """Packed fingerprint: sixteen longs."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    hashes = let(words, _shingle_hashes)
    return let(let(let(hashes, _least_by_bin), _densified), _packed)


def as_hex(packed: Column) -> Column:
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of the shingle sets, 0 to 1."""
    ones = F.lit(int("1" * _PER_LONG, 16))

    def differing(x: Column) -> Column:
        spread = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(
            F.shiftrightunsigned(x, 3)
        )
        return F.bit_count(spread.bitwiseAND(ones))

    apart = F.aggregate(
        F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n
    )
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), (1 - apart / F.lit(float(BINS)) - chance) / (1 - chance))


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """The documents with ``fingerprint`` (packed)."""
    return docs.withColumn("fingerprint", fingerprint(text_or_empty()))


def next_ids(docs: DataFrame) -> DataFrame:
    """doc_id, next_id: the next lower id; after the lowest, the highest."""
    ids = docs.select("doc_id").distinct().repartitionByRange(partitions(docs.sparkSession), "doc_id")
    placed = cut_lineage(ids.withColumn("part", F.spark_partition_id()))
    # One row a range: the window over them is in one task, and reads as many rows as there were tasks.
    ends = placed.groupBy("part").agg(F.max("doc_id").alias("highest"))
    every = Window.partitionBy().orderBy("part")
    ends = ends.select("part", F.coalesce(
        F.lag("highest").over(every),
        F.max("highest").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    ).alias("below"))
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.desc("doc_id")))
    return placed.withColumn("inside", inside).join(ends, "part").select(
        "doc_id", F.coalesce("inside", "below").alias("next_id")
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, and that of its text with the last half of its characters
    replaced by the first ones of the next document (descending id; where an id is repeated, the
    row with the least hash of its text).

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    rows = with_fingerprint(texts)
    halves = texts.groupBy("doc_id").agg(F.max(F.expr("char_length(text) div 2")).alias("most"))
    wanted = halves.join(next_ids(docs), "doc_id").select(F.col("doc_id").alias("reader"), "next_id", "most")
    # Both joins read the rows dealt by id, so Spark deals and fingerprints them once. The choice
    # among rows of a repeated id comes after the join, where it does not change that exchange.
    one = F.row_number().over(Window.partitionBy("reader").orderBy("text_hash", "opening"))
    given = rows.join(wanted, F.col("doc_id") == F.col("next_id")).select(
        "reader", F.expr("substring(text, 1, most)").alias("opening"),
        F.xxhash64("text").alias("text_hash"), F.col("fingerprint").alias("next_fingerprint"),
    ).withColumn("copy", one).where("copy = 1").select(
        F.col("reader").alias("doc_id"), "opening", "next_fingerprint"
    )
    n = F.char_length("text")
    half = F.expr("char_length(text) div 2")
    edited = rows.join(given, "doc_id").select(
        "doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("opening", F.lit(1), half)).alias("edited"),
    )
    done = edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint",
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
    )
    return done.select(
        "doc_id", "n_chars", "edited_sha256", F.struct("fingerprint", "edited_fingerprint", "next_fingerprint").alias("p"),
    ).select(
        "doc_id", "n_chars", "edited_sha256", F.explode(F.array("p")).alias("p")
    ).select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("p.fingerprint")).alias("fingerprint"),
        as_hex(F.col("p.edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("p.fingerprint"), F.col("p.edited_fingerprint")).alias("near_edited"),
        likeness(F.col("p.fingerprint"), F.col("p.next_fingerprint")).alias("near_next"),
    )
