"""Repeated passages by prefix-partitioned suffix trees.

The word suffixes of all documents are split by their first words into groups that fit in memory,
and each group's suffix tree is built by one task: suffixes sorted, with the longest common prefixes
of neighbours. Cutting that tree at a depth gives its internal nodes there; those with suffixes of
two documents are repeats.

Only suffixes that a repeat of ``window`` words must contain are built. Of each window's runs of
``PREFIX`` words the one with the least hash marks a suffix, so equal windows mark the same place;
marks whose prefix stands in one document only are dropped before any text is moved. A marked suffix
carries the words before it as well, and a second tree over those, read backwards, tells how far a
repeat extends to the left. A window that begins r words before the mark is repeated if two suffixes
share a node at depth ``window - r`` of the first tree and one at depth r of the second.

Groups larger than ``GROUP`` suffixes take longer prefixes, up to the whole window: there each
window is a group of its own, of which an aggregate keeps the least document.

Defined results: a null text has no words; documents shorter than a window keep all their words;
rows that repeat a document id are the same document, so they do not repeat each other, and are
judged one by one, each by its own text; a row without an id keeps all its words; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlight.llm.common import text_or_empty
from hearthlight.llm.near import _groups
from hearthlight.llm.shingles import _BASE, _power, mixed, runs, words_of
from hearthlight.session import cut_lineage

_U = np.uint64
WINDOW, PREFIX = 50, 16
#: Suffixes of one group that a task holds at most, and that it works on at a time.
GROUP, CHUNK = 100_000, 20_000


def marks(hashes: np.ndarray, owner: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the marked suffixes, and the hash of each one's first ``prefix`` words."""
    n, span = len(hashes), window - prefix + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    sums = np.zeros(n + 1, _U)
    np.cumsum(hashes * _power("up", _BASE, n + 1)[:n], out=sums[1:])
    m = n - prefix + 1
    heads = mixed((sums[prefix:] - sums[:m]) * _power("down", pow(_BASE, -1, 1 << 64), n + 1)[:m])
    # The place in the low bits: the least value of a span tells where it stands, and of equal
    # hashes the first one in the span is taken, in either copy of a window.
    bits = _U(max(24, int(m).bit_length()))
    least = ((heads >> bits) << bits) | np.arange(m, dtype=_U)
    width = 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    inside = owner[:n - window + 1] == owner[window - 1:]
    at = np.unique((least[inside] & ((_U(1) << bits) - _U(1))).astype(np.int64))
    return at, heads[at]


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text and tag: a hash of the text where an id has several texts, otherwise 0."""
    texts, own = docs.select("doc_id", text_or_empty().alias("text")), F.xxhash64("text")
    several = cut_lineage(
        texts.groupBy("doc_id").agg(F.min(own).alias("low"), F.max(own).alias("high"))
        .where("low < high").select("doc_id", F.lit(True).alias("several"))
    )
    if several.isEmpty():
        return texts.withColumn("tag", F.lit(0).cast("long"))
    return texts.join(several, "doc_id", "left").select(
        "doc_id", "text", F.when(F.col("several"), own).otherwise(0).alias("tag")
    )


def marked_suffixes(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids, tags = batch.column("text"), batch.column("doc_id"), batch.column("tag")
            for a, b in runs(column):
                words = words_of(column.slice(a, b - a))
                owner = words.owner
                at, heads = marks(words.hashes, owner, window, prefix)
                rows = pa.array(owner[at])
                yield pa.RecordBatch.from_arrays([
                    pa.array(heads.view(np.int64)), ids.slice(a, b - a).take(rows), tags.slice(a, b - a).take(rows),
                    pa.array((at - words.first[owner[at]]).astype(np.int32)),
                ], ["head", "doc_id", "tag", "at"])

    return docs.select("doc_id", "tag", "text").mapInArrow(work, "head bigint, doc_id bigint, tag bigint, at int")


def with_contexts(rows: DataFrame, window: int, prefix: int) -> DataFrame:
    """One row a suffix: head, doc_id, tag, at, n, before (words of the context before the suffix), key
    (hash of the context) and the context, once a task for each."""
    reach = window - prefix

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string())
        names = ["head", "doc_id", "tag", "at", "n", "before", "key", "context"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                doc, tag, words = batch.column("doc_id")[k].as_py(), batch.column("tag")[k].as_py(), (batch.column("text")[k].as_py() or "").encode().split()
                for m in batch.column("marks")[k].as_py():
                    at, before = m["at"], min(m["at"], reach)
                    context = b" ".join(words[at - before:at + window])
                    key = xxhash.xxh64_intdigest(context, seed=before) - (1 << 63)
                    first = (m["head"], key) not in seen
                    if first:
                        seen.add((m["head"], key))
                    out.append((m["head"], doc, tag, at, m["n"], before, key, context.decode() if first else None))
                if len(out) >= CHUNK:
                    yield batch_of(out)
                    out = []
                if len(seen) > 500_000:
                    seen.clear()
            yield batch_of(out)

    return rows.select("doc_id", "tag", "text", "marks").mapInArrow(
        work, "head bigint, doc_id bigint, tag bigint, at int, n bigint, before int, key bigint, context string"
    )


def _matrices(contexts: pa.Array, before: np.ndarray, window: int, reach: int) -> tuple[np.ndarray, ...]:
    """Words from the mark on, words before it (nearest first), and how many of each there are."""
    words = words_of(contexts)
    n, first, counts = len(before), words.first, words.counts
    right, left = np.zeros((n, window), _U), np.zeros((n, reach), _U)
    after = np.minimum(counts - before, window)
    for d in range(window):
        some = np.flatnonzero(after > d)
        right[some, d] = words.hashes[first[some] + before[some] + d]
    for r in range(reach):
        some = np.flatnonzero(before > r)
        left[some, r] = words.hashes[first[some] + before[some] - 1 - r]
    return right, left, after


def _tree(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix tree: the sorted order, and the common prefix of each suffix with the one before."""
    order = np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))
    common = np.zeros(len(rows), np.int64)
    if len(rows) > 1 and rows.shape[1]:
        apart = rows[order[1:]] != rows[order[:-1]]
        common[1:] = np.where(apart.any(1), apart.argmax(1), rows.shape[1])
    return order, common


def _nodes(tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """The node of each suffix at a depth."""
    order, common = tree
    starts = common < depth
    starts[:1] = False
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(starts)
    return out


def repeated(heads: np.ndarray, docs: np.ndarray, contexts: pa.Array, before: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct contexts, in ascending order of their least documents: which windows stand in a
    lesser document, and which there are at all, as bits (bit r: begins r words before the mark)."""
    reach = window - prefix
    right, left, after = _matrices(contexts, before, window, reach)
    forward = _tree(np.hstack([heads.view(_U)[:, None], right]))
    backward = _tree(left)
    lesser, there = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    for r in range(reach + 1):
        valid = np.flatnonzero((before >= r) & (after >= window - r))
        if len(valid) == 0:
            continue
        node = _nodes(forward, 1 + window - r)[valid] * (len(docs) + 1) + _nodes(backward, r)[valid]
        _, least, member = np.unique(node, return_index=True, return_inverse=True)
        there[valid] |= 1 << r
        lesser[valid] |= np.where(docs[valid[least]][member] < docs[valid], 1 << r, 0)
    return lesser, there


def tree_repeats(suffixes: DataFrame, window: int, prefix: int) -> DataFrame:
    """doc_id, tag, at, windows (bits), of marked suffixes that lie in a repeat."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(groups: list[pa.Table]) -> pa.RecordBatch:
            table = pa.concat_tables(groups).combine_chunks()
            head, key, doc = (table.column(c).to_numpy() for c in ("head", "key", "doc_id"))
            full = table.column("context").is_valid().to_numpy()
            # Contexts in the order of their least documents; each is given by one of its rows.
            _, which = np.unique(np.stack([head, key], 1), axis=0, return_inverse=True)
            which = which.reshape(-1)
            least = np.full(which.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, which, doc)
            source = np.zeros(len(least), np.int64)
            source[which[full]] = np.flatnonzero(full)
            order = np.argsort(least, kind="stable")
            rows = source[order]
            text = table.column("context").combine_chunks()
            lesser, there = np.zeros(len(least), np.int64), np.zeros(len(least), np.int64)
            lesser[order], there[order] = repeated(
                head[rows], least[order], text.take(pa.array(rows)), table.column("before").to_numpy()[rows].astype(np.int64), window, prefix
            )
            bits = np.where(doc > least[which], there[which], lesser[which])
            hit = np.flatnonzero(bits)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc[hit]), *(table.column(c).combine_chunks().take(pa.array(hit)) for c in ("tag", "at")), pa.array(bits[hit])],
                ["doc_id", "tag", "at", "windows"],
            )

        held, n = [], 0
        for group in _groups(batches, ["head"]):
            held.append(group)
            n += group.num_rows
            if n >= CHUNK:
                yield solve(held)
                held, n = [], 0
        if held:
            yield solve(held)

    return suffixes.mapInArrow(work, "doc_id bigint, tag bigint, at int, windows bigint")


def window_repeats(suffixes: DataFrame, window: int, prefix: int) -> DataFrame:
    """The same for groups of any size: the prefix is the whole window. Equal contexts are one, so
    that a passage in very many documents, or one word said over and over, is cut up once."""
    reach = window - prefix

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for head, key, least, before, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = context.encode().split()
                for r in range(min(before, reach) + 1):
                    own = words[before - r:before - r + window]
                    if len(own) == window:
                        rows.append((head, key, least, xxhash.xxh64_intdigest(b" ".join(own)) - (1 << 63), 1 << r))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["head", "key", "least", "content", "bit"]
            )

    suffixes = cut_lineage(suffixes)
    contexts = suffixes.groupBy("head", "key").agg(
        F.min("doc_id").alias("least"), F.max("before").alias("before"), F.max("context").alias("context")
    )
    windows = cut_lineage(contexts.select("head", "key", "least", "before", "context").mapInArrow(
        work, "head bigint, key bigint, least bigint, content bigint, bit bigint"
    ))
    first = windows.groupBy("head", "content").agg(F.min("least").alias("first"))
    bits = cut_lineage(windows.join(first, ["head", "content"]).groupBy("head", "key", "least").agg(
        F.bit_or("bit").alias("there"),
        F.bit_or(F.when(F.col("first") < F.col("least"), F.col("bit")).otherwise(0)).alias("lesser"),
    ))
    return suffixes.select("head", "key", "doc_id", "tag", "at").join(bits, ["head", "key"]).select(
        "doc_id", "tag", "at", F.when(F.col("doc_id") > F.col("least"), F.col("there")).otherwise(F.col("lesser")).alias("windows")
    ).where("windows != 0")


def without_repeats(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of texts and their repeats (doc_id, text,
    repeats: array of at and windows)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            repeats = batch.column("repeats").to_pylist()
            for doc, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), repeats, strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if found:
                    change = np.zeros(n + 1, np.int64)
                    starts = {f["at"] - r for f in found for r in range(f["windows"].bit_length()) if f["windows"] >> r & 1}
                    for s in starts:
                        change[s] += 1
                        change[s + window] -= 1
                    kept = np.flatnonzero(np.cumsum(change[:n]) == 0)
                    words = [words[i] for i in kept.tolist()]
                joined = b" ".join(words)
                out.append((doc, n, n - len(words), hashlib.sha256(joined).hexdigest(), joined.decode()))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return rows.select("doc_id", "text", "repeats").mapInArrow(
        work, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: every word is removed that lies in a
    window which also stands in a document with a lesser id."""
    texts = tagged(docs)
    suffixes = cut_lineage(marked_suffixes(texts, window, prefix))
    # Written first, so that both sides of the join are plain shuffles, which Spark can split where
    # a prefix is hot.
    shared = cut_lineage(suffixes.groupBy("head").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")
    ).where("low < high").select("head", "n"))
    marked = cut_lineage(suffixes.join(shared, "head"))

    def contexts(some: DataFrame) -> DataFrame:
        by_document = some.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("head", "at", "n")).alias("marks"))
        return with_contexts(texts.join(by_document, ["doc_id", "tag"]), window, prefix)

    found = tree_repeats(
        contexts(marked.where(F.col("n") <= group)).repartition("head").sortWithinPartitions("head", "doc_id", "at"),
        window, prefix,
    )
    large = marked.where(F.col("n") > group)
    if not large.isEmpty():
        found = found.unionByName(window_repeats(contexts(large), window, prefix))
    repeats = found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "windows")).alias("repeats"))
    return without_repeats(texts.join(repeats, ["doc_id", "tag"], "left"), window)

