"""Best-fit packing of documents into token sequences, with a fixed number of open bins.

Each task packs its share of the pieces online: a piece goes into the open bin with the least free
space that holds it. Open bins stand in stacks by free space, and a bitset over the free spaces
finds the best one without a search. When all bins are taken and none fits, the fullest is closed.
A task reads its pieces in blocks and places the long ones of a block first. Memory is one block
and the open bins, whatever the input.

Defined results: a null text is empty and becomes the end id alone; a document longer than a
sequence is cut into full sequences, of which the first may be shorter; rows that repeat a document
are packed like any others, under the same id; ties between bins go to the one used last; extra
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlight.llm.tokens import default_tokenizer, encoded
from hearthlight.session import cut_lineage

SEQUENCE = 2048
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class OpenBins:
    """Best fit among at most ``limit`` open bins of ``capacity``."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.stacks: dict[int, list[int]] = defaultdict(list)
        self.mask = self.open = self.made = 0

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        number = stack.pop()
        if not stack:
            self.mask &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Number of the bin, and the offset in it."""
        fitting = self.mask >> length
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + length
            number = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        rest = free - length
        if rest:
            self.stacks[rest].append(number)
            self.mask |= 1 << rest
            self.open += 1
        return number, self.capacity - free


def cut(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces."""
    head = tokens % capacity
    starts = [0, *range(head, tokens, capacity)] if head else list(range(0, tokens, capacity))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], tokens], strict=True)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = batch.column("text").to_pylist()
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded(tokenizer, texts), strict=True):
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
    return docs.select("doc_id", "text").mapInArrow(work, _PIECES)


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = SEQUENCE, open_bins: int = 8192,
    block: int = 16384, task_pieces: int = 65536,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut_lineage(
        token_pieces(docs, tokenizer or default_tokenizer(), capacity)
        .withColumn("spread", F.monotonically_increasing_id())
    )
    tasks = max(1, -(-pieces.count() // task_pieces))
    dealt = pieces.repartition(tasks, F.xxhash64("spread")).sortWithinPartitions(
        F.xxhash64("doc_id", "piece"), "doc_id", "piece", "start", "ids_crc32"
    ).drop("spread")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 32

        def placed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = table.column("length").to_numpy()
            numbers, offsets = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
            for i in np.argsort(-lengths, kind="stable").tolist():
                numbers[i], offsets[i] = bins.place(int(lengths[i]))
            return (
                table.append_column("sequence_id", pa.array(numbers + first))
                .append_column("offset", pa.array(offsets)).to_batches()[0]
            )

        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if rows and rows + part.num_rows > block:
                    yield placed(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield placed(held)

    return dealt.mapInArrow(work, _PIECES + ", sequence_id bigint, offset bigint")
