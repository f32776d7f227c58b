"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Each document becomes its set of word shingles, a signature of 64 coordinates, a packed sketch of
   256 four-bit coordinates, and a hash of the whole set. Documents with equal sets are one class.
2. A class representative is posted under its rarest (coordinate, value) pairs. Two signatures that
   agree in at least ``agree`` of 64 coordinates share a pair within the first 65 - ``agree`` of
   both, in any order that is the same for all, so only that prefix is posted; pairs that no other
   document has count as the rarest and are not posted at all.
3. Within a list, collisions are counted on the sketches. Pairs that are already connected are
   skipped, so a list of n near copies gives n - 1 links, not n squared.
4. The links join documents into candidate groups. The texts of a group meet once more, full sets
   are compared, and again only pairs not yet connected are tried. What passes are true links;
   their components are the result.

Long lists and large groups are dealt into blocks, and a row meets its own block first. Then a few
heads of each part of a block meet in place of the whole part, which joins the parts of a family of
near copies. Only where parts of one list are still apart do their rows meet: those
outside the largest part with all others, those inside it with the rows outside (``joined``). So a
family moves its rows a few times, whatever its size, and no pair goes untried.

Both thresholds on counts lie about five standard deviations below what the least similar linked
pair is expected to have, so a link is missed with a probability below one in a million.

Defined results: a null text has no words; a text with fewer words than a shingle is one shingle; a
text without words has an empty set and is linked with nothing; rows that repeat a document id are
one document if their sets are equal, else the id's sets are linked with each other; a row without
an id is linked with nothing, and its component and ``kept`` are null; texts of any length are taken
whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlight.llm.components import connected
from hearthlight.llm.shingles import distinct, mixed, runs, shingle_hashes, words_of
from hearthlight.session import cut_lineage

_U = np.uint64
COORDINATES, SKETCH = 64, 256
_SEEDS = np.random.default_rng(29).integers(1, 1 << 63, SKETCH, dtype=np.uint64) | _U(1)
_NIBBLES = _U(0x1111111111111111)
#: Rows that stand for a part of a block.
HEADS = 8


@dataclass(frozen=True)
class Settings:
    """Documents are linked if ``100 * |A and B| >= percent * |A or B|`` on shingles of ``words``."""

    words: int = 3
    percent: int = 85
    #: Members of one block of a list, and of a group whose texts are compared.
    list_block: int = 2048
    text_block: int = 512

    @property
    def agree(self) -> int:
        """Coordinates of 64 in which linked documents agree."""
        return self._below(self.percent / 100, COORDINATES)

    @property
    def sketch_agree(self) -> int:
        p = self.percent / 100
        return self._below(p + (1 - p) / 16, SKETCH)

    @staticmethod
    def _below(p: float, n: int) -> int:
        return max(1, int(n * p - 5 * (n * p * (1 - p)) ** 0.5))


def text_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's set of shingle hashes starts, and all sets one after another."""
    owner, hashes = distinct(*shingle_hashes(words_of(column, lower=True), words))
    return np.searchsorted(owner, np.arange(len(column) + 1)), hashes


def _signatures(first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the coordinates (32 bits) and packed sketches of non-empty sets."""
    n = len(first) - 1
    values = np.zeros((n, COORDINATES), np.uint32)
    low = np.zeros((n, SKETCH // 16), _U)
    if n:
        for k in range(SKETCH):
            least = np.minimum.reduceat(hashes * _SEEDS[k], first[:-1])
            if k < COORDINATES:
                values[:, k] = least >> _U(32)
            # The low bits of a product depend on the low bits of its factors alone; those from the
            # middle do not.
            low[:, k // 16] |= ((least >> _U(20)) & _U(15)) << _U(4 * (k % 16))
    return values, low


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n_shingles, set_hash, signature (64 ints), sketch (binary); null for empty sets."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b in runs(column):
                first, hashes = text_sets(column.slice(a, b - a), settings.words)
                size = np.diff(first)
                full = np.flatnonzero(size)
                starts = np.append(first[:-1][full], len(hashes))
                values, low = _signatures(starts, hashes)
                spread = mixed(hashes)
                sums = np.zeros((len(full), 2), _U)
                if len(full):
                    sums[:, 0] = np.add.reduceat(spread, starts[:-1])
                    sums[:, 1] = np.add.reduceat(mixed(spread), starts[:-1])
                row = np.full(b - a, -1)
                row[full] = np.arange(len(full))
                get = lambda f: [f(i) if i >= 0 else None for i in row.tolist()]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), pa.array(size, pa.int64()),
                    pa.array(get(lambda i: sums[i].tobytes()), pa.binary()),  # noqa: B023
                    pa.array(get(lambda i: values[i].view(np.int32)), pa.list_(pa.int32())),  # noqa: B023
                    pa.array(get(lambda i: low[i].tobytes()), pa.binary()),  # noqa: B023
                ], ["doc_id", "n_shingles", "set_hash", "signature", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(
        work, "doc_id bigint, n_shingles bigint, set_hash binary, signature array<int>, sketch binary"
    )


def postings(classes: DataFrame, settings: Settings) -> DataFrame:
    """list, doc: the prefix of each document, rarest pairs first."""
    pairs = classes.select("doc", F.posexplode("signature").alias("coordinate", "value")).select(
        "doc", F.xxhash64("coordinate", "value").alias("list")
    )
    # Written first, so that both sides of the join are plain shuffles, which Spark can split where
    # a pair that a third of all documents have is hot.
    shared = cut_lineage(pairs.groupBy("list").agg(F.count("*").alias("n")).where("n > 1"))
    kept = COORDINATES + 1 - settings.agree
    held = pairs.join(shared, "list").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("n", "list"))).alias("at"))
    prefix = F.slice("at", F.lit(1), F.greatest(F.lit(0), F.size("at") - (COORDINATES - kept)))
    return held.select("doc", F.inline(prefix)).select("list", "doc", "n")


def _spread(seed: int, doc: str, blocks: Column) -> Column:
    """Which of ``blocks`` a row belongs to."""
    return F.pmod(F.xxhash64(F.lit(seed), doc), blocks)


def _blocks(rows: Column, block: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / block)).cast("long")


class Union:
    """Which members are connected, if those of one part are so from the start."""

    def __init__(self, parts: np.ndarray):
        self.label = np.unique(parts, return_inverse=True)[1].reshape(-1)

    def join(self, i: int, others: np.ndarray) -> list[int]:
        """Connects ``i`` with the others; one of each part that was apart."""
        mine = self.label[i]
        parts, at = np.unique(self.label[others], return_index=True)
        new = at[parts != mine]
        self.label[np.isin(self.label, parts)] = mine
        return others[new].tolist()

    def heads(self) -> Iterator[int]:
        """Up to ``HEADS`` members of each part, spread over it."""
        order = np.argsort(self.label, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(self.label[order])) + 1):
            yield from part[::-(-len(part) // HEADS)].tolist()


def spanning(
    union: Union, near: Callable[[int, np.ndarray], np.ndarray], side: np.ndarray | None = None
) -> Iterator[tuple[int, int]]:
    """Links that connect what ``near`` connects; it is asked for pairs not yet connected only, and,
    where members have a ``side``, for pairs across sides only."""
    todo = list(range(len(union.label) - 1, -1, -1))
    left = np.ones(len(union.label), bool)
    # Members just connected come next, so that a group closes round them and later questions shrink.
    while todo:
        i = todo.pop()
        if not left[i]:
            continue
        left[i] = False
        ask = (union.label != union.label[i]) & left
        if side is not None:
            ask &= side != side[i]
        others = np.flatnonzero(ask)
        if len(others) == 0:
            continue
        hit = others[near(i, others)]
        if len(hit):
            for j in union.join(i, hit):
                yield i, j
            todo.extend(hit.tolist())


def _found(group: pa.Table, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple]:
    """Of a group of rows, the links of parts to the least part they are connected with, and, if the
    list has more blocks, the heads of what they make up (list, head, least part)."""
    i, j, more = (group.column(c)[0].as_py() for c in ("i", "j", "more"))
    docs, part = group.column("doc").to_numpy(), group.column("part").to_numpy()
    union = Union(part)
    for _ in spanning(union, near, None if i == j else group.column("own").to_numpy()):
        pass
    least = np.full(len(docs), np.iinfo(np.int64).max)
    np.minimum.at(least, union.label, part)
    least = least[union.label]
    apart = np.unique(np.stack([part, least], 1)[part != least], axis=0)
    out = [(None, a, b) for a, b in apart.tolist()]
    if more:
        key = group.column("list")[0].as_py()
        out += [(key, int(docs[k]), int(least[k])) for k in union.heads()]
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _links(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["list", "a", "b"])


def candidate_links(lists: DataFrame, settings: Settings) -> DataFrame:
    """list, a, b: heads of parts (see ``_found``), and enough links between sketches to connect all that could be linked, by list."""
    least = settings.sketch_agree

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches, ["list", "i", "j"]):
            if group.num_rows > 1 or group.column("more")[0].as_py():
                low = np.frombuffer(b"".join(group.column("sketch").to_pylist()), _U).reshape(group.num_rows, -1)

                def near(i: int, others: np.ndarray) -> np.ndarray:
                    x = low[others] ^ low[i]  # noqa: B023
                    x |= x >> _U(2)
                    x |= x >> _U(1)
                    return SKETCH - np.bitwise_count(x & _NIBBLES).sum(1) >= least

                out += _found(group, near)
            if len(out) > 10_000:
                yield _links(out)
                out = []
        yield _links(out)

    return lists.mapInArrow(work, "list bigint, a bigint, b bigint")


def true_links(groups: DataFrame, settings: Settings) -> DataFrame:
    """list, a, b: heads of parts (see ``_found``), and enough links between full sets to connect all that are linked, by group."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches, ["list", "i", "j"]):
            if group.num_rows > 1 or group.column("more")[0].as_py():
                sets = [text_sets(c.slice(a, b - a), settings.words) for c in group.column("text").chunks for a, b in runs(c)]
                sizes = np.concatenate([np.diff(first) for first, _ in sets])
                # Shingles as numbers from 0, so that a set can be marked in an array.
                _, flat = np.unique(np.concatenate([hashes for _, hashes in sets]), return_inverse=True)
                first = np.append(0, sizes.cumsum())
                mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)

                def near(i: int, others: np.ndarray) -> np.ndarray:
                    own, theirs = sizes[i], sizes[others]  # noqa: B023
                    alike = 100 * np.minimum(own, theirs) >= settings.percent * np.maximum(own, theirs)
                    out = np.zeros(len(others), bool)
                    some = np.flatnonzero(alike & (theirs > 0))
                    if own == 0 or len(some) == 0:
                        return out
                    mark[flat[first[i]:first[i + 1]]] = True  # noqa: B023
                    n = theirs[some]
                    at = np.repeat(first[others[some]] - np.append(0, n.cumsum()[:-1]), n) + np.arange(n.sum())  # noqa: B023
                    common = np.add.reduceat(mark[flat[at]].astype(np.int64), np.append(0, n.cumsum()[:-1]))  # noqa: B023
                    mark[flat[first[i]:first[i + 1]]] = False  # noqa: B023
                    out[some] = 100 * common >= settings.percent * (own + n - common)
                    return out

                out += _found(group, near)
            if len(out) > 10_000:
                yield _links(out)
                out = []
        yield _links(out)

    return groups.mapInArrow(work, "list bigint, a bigint, b bigint")


def joined(
    rows: DataFrame, payload: DataFrame, links: Callable[[DataFrame], DataFrame], block: int,
    given: DataFrame | None = None,
) -> DataFrame:
    """node, root: the components of all links between rows of one list, and of those given.

    ``rows``: list, doc and n, the length of the list; read several times, so better written before.
    ``links`` gets blocks of rows (list, i, j, own, doc, part, more) with their payload.
    """
    name = payload.columns[1]

    some = ("list", "i", "j", "own", "doc", "part", "more")

    def linked(held: DataFrame) -> DataFrame:
        ordered = held.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j", "doc")
        return cut_lineage(links(ordered.select(*some, name)))

    def alone(members: DataFrame, seed: int) -> DataFrame:
        """Every row in its own block, of about ``n`` rows of its list."""
        blocks = _blocks(F.col("n"), block)
        own = _spread(seed, "doc", blocks)
        return members.select(
            "list", "doc", "part", own.alias("own"), own.alias("i"), own.alias("j"), (blocks > 1).alias("more")
        )

    # Merged at every size: a broadcast, while the rows are few, would make small inputs tell nothing
    # of the shuffle that large ones need.
    held = alone(rows.withColumn("part", F.col("doc")), 3).join(payload.hint("merge"), "doc")
    if not rows.where(F.col("n") > block).isEmpty():
        # Rows of several blocks meet again; their payload is not fetched from the whole table twice.
        held = cut_lineage(held)
    kept = held.where("more").select("list", "doc", name)

    def meet(dealt: DataFrame) -> DataFrame:
        return linked(dealt.select(*some).join(kept, ["list", "doc"]))

    found = linked(held)
    all_links, heads = found.select("a", "b"), found.where("list is not null")
    if given is not None:
        all_links = all_links.unionByName(given)
    n = heads.count()
    if n == 0:
        return connected(all_links)
    # Heads meet in place of their parts, until those of a list are one block or no longer fewer.
    for turn in range(8):
        sizes = heads.groupBy("list").agg(F.count("*").alias("n"))
        heads = heads.select("list", F.col("a").alias("doc"), F.col("b").alias("part"))
        found = meet(alone(heads.join(sizes, "list"), 5 + turn))
        all_links = all_links.unionByName(found.select("a", "b"))
        heads = found.where("list is not null")
        before, n = n, heads.count()
        if 2 * n > before or n == 0:
            break
    roots = cut_lineage(connected(all_links))
    # What is still apart: rows outside the largest part of their list meet all that are not of theirs.
    placed = cut_lineage(
        rows.where(F.col("n") > block).select("list", "doc").join(roots.withColumnRenamed("node", "doc"), "doc", "left")
        .select("list", "doc", F.coalesce("root", "doc").alias("part"))
    )
    largest = cut_lineage(
        placed.groupBy("list", "part").agg(F.count("*").alias("n")).groupBy("list").agg(
            F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts"),
        ).where("parts > 1").select(
            "list", F.col("most.part").alias("top"), _blocks(F.col("most.n"), block).alias("inner"),
            _blocks(F.col("n") - F.col("most.n"), block).alias("outer"),
        )
    )
    if largest.isEmpty():
        return roots
    rest = placed.join(largest, "list").withColumn("more", F.lit(False)).withColumn("own", F.when(
        F.col("part") == F.col("top"), _spread(3, "doc", F.col("inner"))
    ).otherwise(F.col("inner") + _spread(3, "doc", F.col("outer"))))
    start = F.when(F.col("part") == F.col("top"), F.col("inner")).otherwise(0).cast("long")
    pairs = F.transform(F.sequence(start, F.col("inner") + F.col("outer") - 1), lambda x: F.struct(
        F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")
    ))
    last = meet(rest.select("*", F.inline(pairs))).select("a", "b")
    return roots if last.isEmpty() else connected(roots.toDF("a", "b").unionByName(last))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    signed = cut_lineage(signatures(docs, settings))
    full = signed.where("n_shingles > 0")
    # Classes of equal sets, each under its least document.
    classes = cut_lineage(full.groupBy("set_hash", "n_shingles").agg(F.min("doc_id").alias("doc")))
    member = cut_lineage(
        full.select("doc_id", "set_hash", "n_shingles").join(classes, ["set_hash", "n_shingles"])
        .select("doc_id", "set_hash", "n_shingles", "doc")
    )
    heads = cut_lineage(full.join(
        member.where("doc_id = doc").select("doc_id", "set_hash").distinct(), ["doc_id", "set_hash"]
    ).dropDuplicates(["doc_id", "set_hash"]).select(F.col("doc_id").alias("doc"), "signature", "sketch"))
    lists = cut_lineage(postings(heads.select("doc", "signature"), settings))
    candidates = cut_lineage(joined(
        lists, heads.select("doc", "sketch"), lambda rows: candidate_links(rows, settings), settings.list_block
    ))
    sizes = candidates.groupBy("root").agg(F.count("*").alias("n"))
    grouped = candidates.join(sizes, "root").select(F.col("root").alias("list"), F.col("node").alias("doc"), "n")
    # Rows of one id that differ belong together, as do those of a class.
    same = member.where("doc_id != doc").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    roots = joined(
        grouped, docs.select(F.col("doc_id").alias("doc"), "text"), lambda rows: true_links(rows, settings),
        settings.text_block, same,
    )
    rows = signed.select("doc_id", "n_shingles")
    return rows.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"),
    ).withColumn("kept", F.col("component_id") == F.col("doc_id"))
