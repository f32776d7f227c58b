"""Token files: one compressed frame a document, under a shared dictionary.

A folder holds three tables, which Spark's own writers commit, so a lost task leaves nothing behind
and any store that Spark reaches will do:

- ``dictionary``: one zstandard dictionary, trained on the serialized ids of a bounded sample, and
  its SHA-256.
- ``segments``: rows of some megabytes. ``payload`` is the frames of consecutive documents, each
  compressed by itself; ``offsets`` is where they start, with ``doc_ids`` and ``counts`` beside
  them; ``first_doc`` and ``last_doc`` let a reader skip segments, and ``dictionary`` is the hash
  of the dictionary they need.
- ``shards``: for each shard, a range of document ids, how many ids lie before it.

Ids are little-endian unsigned 32-bit integers; documents are in ascending order of id.

Defined results: a null text is empty and becomes the end id alone; rows that repeat a document id
follow each other, ordered by text; an empty table gives an empty folder that reads as no rows; a
sample too small to train a dictionary is used as it is. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthlight.llm.common import hash_sample, partitions
from hearthlight.llm.tokens import default_tokenizer, encoded

#: Documents that train the dictionary, bytes of each that count, and the dictionary's size.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 1 << 15, 112_640
#: Compression level of frames.
LEVEL = 3
#: A segment is closed at so many bytes or documents.
SEGMENT_BYTES, SEGMENT_DOCS = 4 << 20, 4096
_SEGMENTS = (
    "shard int, segment int, first_doc bigint, last_doc bigint, tokens bigint, doc_ids array<bigint>, "
    "counts array<bigint>, offsets array<bigint>, payload binary, dictionary string"
)


def train_dictionary(docs: DataFrame, tokenizer: str, sample: int = SAMPLE) -> bytes:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x[:SAMPLE_BYTES] for x in encoded(tokenizer, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    chosen = hash_sample(docs.select("doc_id", "text"), sample, "doc_id").select("text")
    samples = sorted(bytes(r.ids) for r in chosen.mapInArrow(work, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short
        return b"".join(samples)[:DICTIONARY_BYTES]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, sample: int = SAMPLE) -> None:
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    trained = train_dictionary(docs, tokenizer, sample)
    name = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(name, bytearray(trained))], "name string, content binary").coalesce(1).write.parquet(
        f"{folder}/dictionary"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        shard, segment = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        counts: list[int] = []
        frames: list[bytes] = []
        offsets = [0]

        def flush() -> pa.RecordBatch:
            nonlocal segment
            row = [shard, segment, ids[0], ids[-1], sum(counts), list(ids), list(counts), list(offsets), b"".join(frames), name]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.string()]
            out = pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip(row, kinds, strict=True)],
                [c.split()[0] for c in _SEGMENTS.split(", ")],
            )
            segment += 1
            for kept in (ids, counts, frames):
                kept.clear()
            offsets[:] = [0]
            return out

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for doc, raw in zip(batch.column("doc_id").to_pylist(), encoded(tokenizer, texts), strict=True):
                frame = packer.compress(raw)
                ids.append(doc)
                counts.append(len(raw) // 4)
                frames.append(frame)
                offsets.append(offsets[-1] + len(frame))
                if offsets[-1] >= SEGMENT_BYTES or len(ids) >= SEGMENT_DOCS:
                    yield flush()
        if ids:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions(
        "doc_id", "text"
    )
    ordered.mapInArrow(work, _SEGMENTS).write.option("compression", "none").parquet(f"{folder}/segments")
    sums = spark.read.parquet(f"{folder}/segments").groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    # One row a shard, so a single window task reads no more than the number of write tasks.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums.select(
        "shard", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")).alias("first")
    ).coalesce(1).write.parquet(f"{folder}/shards")


def read_segments(
    spark: SparkSession, folder: str, segments: DataFrame, wanted: tuple[int, ...] = (), with_ids: bool = True
) -> DataFrame:
    """doc_id, shard, segment, before (ids of the segment before it), n_tokens, ids (binary, null if
    not asked for) and ids_crc32, of all documents or the wanted ones."""
    stored = spark.read.parquet(f"{folder}/dictionary").first()
    trained, name = bytes(stored.content), stored.name
    if hashlib.sha256(trained).hexdigest() != name:
        raise ValueError("the dictionary is damaged")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        unpacker, only = zstandard.ZstdDecompressor(dict_data=shared), set(wanted)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError("a segment needs another dictionary")
                payload, offsets = memoryview(row["payload"]), row["offsets"]
                before, docs = 0, []
                for i, (doc, n) in enumerate(zip(row["doc_ids"], row["counts"], strict=True)):
                    if not only or doc in only:
                        raw = unpacker.decompress(payload[offsets[i]:offsets[i + 1]])
                        shown = raw if with_ids else None
                        docs.append((doc, row["shard"], row["segment"], before, n, shown, zlib.crc32(raw)))
                        if len(raw) != 4 * n:
                            raise ValueError("a frame is damaged")
                    before += n
                for at in range(0, len(docs), 512):
                    columns = list(zip(*docs[at:at + 512], strict=True))
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                        ["doc_id", "shard", "segment", "before", "n_tokens", "ids", "ids_crc32"],
                    )
    return segments.mapInArrow(
        work, "doc_id bigint, shard int, segment int, before bigint, n_tokens bigint, ids binary, ids_crc32 bigint"
    )


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """All documents from the files: doc_id, start, n_tokens, ids_crc32, and ids if asked for."""
    segments = spark.read.parquet(f"{folder}/segments")
    rows = read_segments(spark, folder, segments, with_ids=with_ids)
    in_shard = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    index = segments.select("shard", "segment", "tokens").withColumn(
        "earlier", F.coalesce(F.sum("tokens").over(in_shard), zero)
    ).join(spark.read.parquet(f"{folder}/shards").select("shard", "first"), "shard").select(
        "shard", "segment", (F.col("first") + F.col("earlier")).alias("base")
    )
    return rows.join(index, ["shard", "segment"]).select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []),
    )


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Single documents: only segments that may hold them are read, only their frames unpacked."""
    hit = F.lit(False)
    for doc in doc_ids:
        hit = hit | ((F.col("first_doc") <= doc) & (F.col("last_doc") >= doc))
    segments = spark.read.parquet(f"{folder}/segments").where(hit)
    return read_segments(spark, folder, segments, tuple(doc_ids)).select("doc_id", "n_tokens", "ids")
