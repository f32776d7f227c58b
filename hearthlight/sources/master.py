"""The master dataset as a table that batches are appended to, with an index of its keys.

Each batch adds the rows whose key the master lacks, in one commit under the batch's id: a batch that
is sent again adds nothing, and of two batches at once the later one drops what the earlier has added.
A batch without new keys commits nothing.

Beside the rows lies a key index: the hash keys alone, in a folder for each hash prefix, and per prefix
a Bloom filter (bits in words of 64). A batch asks the filters first: a key with a bit missing is new.
Only for the others are keys read, and only in the folders of their prefixes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlight.operators.dedup import keep_first
from hearthlight.session import cut_lineage
from hearthlight.sources.commits import Commit, FolderTable

#: Hash functions of a filter, and bits a key at least.
PROBES, BITS = 6, 10
KEYS = "batch string, key string, prefix string"
FILTERS = "batch string, words bigint, prefix string, word bigint, bits bigint"


@dataclass(frozen=True)
class Appended:
    """Rows added, rows of the master after it, and whether this call has committed anything."""

    added_rows: int
    total_rows: int
    committed: bool


def _bits(key: Column, words: Column) -> Column:
    """Where a key's bits lie in a filter of so many words: (word, bit)."""
    probe = lambda i: F.pmod(F.xxhash64(F.lit(i), key), words * 64)
    return F.array(*[
        F.struct(F.floor(probe(i) / 64).alias("word"), F.pmod(probe(i), F.lit(64)).cast("int").alias("bit"))
        for i in range(PROBES)
    ])


class Master:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "text_hash", digits: int = 2):
        self.table, self.schema, self.key, self.digits = FolderTable(spark, root), schema, key, digits

    @property
    def spark(self) -> SparkSession:
        return self.table.spark

    # --- reading ----------------------------------------------------------------------------

    def rows(self) -> DataFrame:
        """All rows of committed batches."""
        return self._read(self.table.live(self.table.commits()))

    def _read(self, folders: list[str]) -> DataFrame:
        return self.table.read([f for f in folders if f.startswith("rows/")], self.schema)

    def total(self) -> int:
        return _total(self.table.commits())

    # --- index ------------------------------------------------------------------------------

    def _prefix(self, key: Column) -> Column:
        return F.substring(key, 1, self.digits)

    def _index(self, kind: str, schema: str, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        root = f"{self.table.root}/{kind}"
        return self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/batch={n}" for n in names])

    def _write_index(self, keys: DataFrame, n: int, name: str) -> int:
        """Writes the keys by prefix and their filters; returns the words of a filter."""
        words = 1
        while words * 64 * 16 ** self.digits < n * BITS:
            words *= 2
        keys = keys.select(F.col(self.key).alias("key")).withColumn("prefix", self._prefix(F.col("key")))
        keys.repartition("prefix").sortWithinPartitions("prefix", "key").write.partitionBy("prefix").parquet(
            f"{self.table.root}/keys/batch={name}"
        )
        bits = keys.select("prefix", F.inline(_bits(F.col("key"), F.lit(words))))
        bits.groupBy("prefix", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).select(
            F.lit(words).cast("long").alias("words"), "prefix", "word", "bits"
        ).write.parquet(f"{self.table.root}/filters/batch={name}")
        return words

    def maybe_known(self, keys: DataFrame, names: list[str], words: list[int]) -> DataFrame:
        """key, batch: the keys that a batch's filter may hold, and surely those that it does."""
        sizes = F.explode(F.array(*[F.lit(w).cast("long") for w in sorted(set(words))]))
        probes = keys.select("key", self._prefix(F.col("key")).alias("prefix"), sizes.alias("words")).select(
            "key", "prefix", "words", F.inline(_bits(F.col("key"), F.col("words")))
        )
        filters = self._index("filters", FILTERS, names)
        hit = F.expr("getbit(bits, bit)") == 1
        return (
            probes.join(filters, ["words", "prefix", "word"]).where(hit)
            .groupBy("key", "batch").agg(F.count("*").alias("n")).where(F.col("n") == PROBES).select("key", "batch")
        )

    def known(self, keys: DataFrame, folders: list[str] | None = None) -> DataFrame:
        """Of the distinct ``keys`` (column key), those that the master holds."""
        commits = self.table.commits()
        names = _batches(self.table.live(commits) if folders is None else folders)
        if not names:
            return keys.limit(0)
        sizes = {n: c.facts["words"][n] for c in commits for n in c.facts.get("words", {})}
        maybe = cut_lineage(self.maybe_known(keys, names, [sizes[n] for n in names]))
        # At most 16 ** digits prefixes, however many keys; Spark prunes all other folders.
        wanted = sorted(r.prefix for r in maybe.select(self._prefix(F.col("key")).alias("prefix")).distinct().collect())
        held = self._index("keys", KEYS, names).where(F.col("prefix").isin(wanted)).select("key")
        return maybe.select("key").distinct().join(held, "key", "left_semi")

    def unknown_rows(self, batch: DataFrame) -> DataFrame:
        """Rows of the batch whose key the master lacks; rows without a key are left out."""
        rows = batch.where(F.col(self.key).isNotNull())
        known = self.known(rows.select(F.col(self.key).alias("key")).distinct())
        return rows.join(known.withColumnRenamed("key", self.key), self.key, "left_anti")

    # --- writing ----------------------------------------------------------------------------

    def append(self, batch: DataFrame, name: str, order: Sequence, attempts: int = 20) -> Appended:
        """Adds the first row, in ``order``, of each key that the master lacks."""
        seen = self.table.commits()
        if any(c.name == name for c in seen):
            return Appended(0, _total(seen), False)
        columns = self.schema.fieldNames()
        if all(isinstance(o, str) for o in order):
            batch = batch.select(*dict.fromkeys([*columns, self.key, *order]))
        batch = cut_lineage(batch)  # read for its keys, then for its rows; other columns, as texts, stay behind
        fresh = keep_first(self.unknown_rows(batch), [self.key], order).select(*columns)
        folder, added = self._write_rows(fresh)
        for _ in range(attempts):
            if not added:
                return Appended(0, _total(seen), False)
            index = folder.removeprefix("rows/")
            words = self._write_index(self._read([folder]).select(self.key), added, index)
            total = _total(seen) + added
            if self.table.commit(len(seen), Commit(name, (folder,), (), {"total": total, "added": added, "words": {index: words}})):
                return Appended(added, total, True)
            now = self.table.commits()
            if any(c.name == name for c in now):
                return Appended(0, _total(now), False)
            # What others have committed since: their rows, if only moved by a compaction, do no harm.
            theirs = self.table.live(now[len(seen):])
            rows = self._read([folder])
            known = self.known(rows.select(F.col(self.key).alias("key")), theirs)
            folder, added = self._write_rows(rows.join(known.withColumnRenamed("key", self.key), self.key, "left_anti").select(*columns))
            seen = now
        raise RuntimeError("other writers were faster each time")

    def _write_rows(self, rows: DataFrame) -> tuple[str, int]:
        """Writes rows to a folder of their own and counts them on the way."""
        folder, seen = self.table.new_folder("rows"), Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.table.root}/{folder}")
        return folder, seen.get["n"]

    def compact(self) -> bool:
        """Joins all folders of rows, keys and filters into one of each."""
        commits = self.table.commits()
        old = self.table.live(commits)
        if len(old) < 2:
            return False
        folder, n = self._write_rows(self._read(old))
        index = folder.removeprefix("rows/")
        words = self._write_index(self._read([folder]).select(self.key), n, index)
        for _ in range(20):
            if self.table.commit(len(commits), Commit("compact", (folder,), tuple(old), {"total": _total(commits), "words": {index: words}})):
                return True
            commits = self.table.commits()
            if any(f not in self.table.live(commits) for f in old):
                return False
        raise RuntimeError("other writers were faster each time")


def _batches(folders: list[str]) -> list[str]:
    return [f.removeprefix("rows/") for f in folders if f.startswith("rows/")]


def _total(commits: list[Commit]) -> int:
    return next((c.facts["total"] for c in reversed(commits)), 0)
