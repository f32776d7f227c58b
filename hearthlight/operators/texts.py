"""Rows and their texts apart, so that rules read a text once, however many rows hold it.

Forum texts repeat: spam is posted again, greetings are alike, posts are quoted whole. Rows travel through joins
without their text, with its digest; what rules find in a text follows by that digest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlight.session import cut_lineage

KEY = "text_key"
PARTS = 4  # of the texts, a core


Read = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Apart:
    """``rows``: all columns but the text, and ``text_key``. ``texts``: each distinct text once, with its
    ``text_key`` and the least id that holds it.

    With ``read`` (see ``split``) texts lie nowhere: each use of ``texts`` reads them from where they come, and ``first``
    holds the id to read for each ``text_key``. Then texts take no disk but that of the join that brings them."""

    rows: DataFrame
    texts: DataFrame
    text: str
    key: str = "interaction_id"
    first: DataFrame | None = None
    read: Read | None = None

    def judged(self, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows with the columns that ``work`` adds to ``text_key`` and text.

        Texts are dealt out in a few parts a core: as they were staged, files are about as many as cores or
        one or two more, and the rules on the last of them would run alone. ``read`` deals out what it returns."""
        texts = self.texts.select(KEY, self.text)
        if self.read is None:
            texts = texts.repartition(PARTS * texts.sparkSession.sparkContext.defaultParallelism, KEY)
        return self.rows.join(cut_lineage(work(texts).drop(self.text)), KEY)

    def where(self, condition: str | Column) -> Apart:
        """Some of the rows, and the texts that they hold."""
        rows = self.rows.where(condition)
        if self.read is not None:
            return _read_anew(rows, _first(rows, self.key), self.text, self.key, self.read)
        return Apart(rows, self.of(rows), self.text, self.key)

    def of(self, keys: DataFrame) -> DataFrame:
        """``texts`` with a ``text_key`` of ``keys``."""
        if self.read is None:
            return self.texts.join(keys.select(KEY), KEY, "left_semi")
        return _texts(self.first.join(keys.select(KEY), KEY, "left_semi"), self.text, self.key, self.read)

    def with_texts(self, rows: DataFrame, name: str) -> DataFrame:
        """Some of the rows, which carry ``text_key``, with their text as ``name``; null becomes ''.

        With ``read`` the rows go where their texts are read, so texts do not move once more."""
        if self.read is None:
            return rows.join(self.texts.select(KEY, F.coalesce(self.text, F.lit("")).alias(name)), KEY)
        held = self.read(rows.select(self.key, F.struct(*rows.columns).alias("_row")))
        return held.select("_row.*", F.coalesce(self.text, F.lit("")).alias(name))


def _digest(text: str) -> Column:
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"").cast("binary")).alias(KEY)


def _first(rows: DataFrame, key: str) -> DataFrame:
    return cut_lineage(rows.groupBy(KEY).agg(F.min(key).alias(key)))


def _texts(first: DataFrame, text: str, key: str, read: Read) -> DataFrame:
    return read(first.select(key)).select(_digest(text), text, key)


def _read_anew(rows: DataFrame, first: DataFrame, text: str, key: str, read: Read) -> Apart:
    return Apart(rows, _texts(first, text, key, read), text, key, first, read)


def split(df: DataFrame, text: str = "content", key: str = "interaction_id", read: Read | None = None) -> Apart:
    """Reads ``df`` for the rows with their digests, which are staged, and again for one row a distinct text.

    The digest is SHA-256 of the bytes, null has one of its own. Only digests and ids are grouped, so texts move
    at most once each; ids that are null or not unique are no harm.

    Texts are read again for the least ids only. Spark filters ``df`` by them without moving it as long as it
    can broadcast them; beyond that, all rows move with their texts. Where a join brings the texts, ``read``
    avoids that: it gets a frame of ids (column ``key``) and returns the rows of ``df`` that have one, and can
    leave out the others before the texts come. It deals the rows out in some parts a core. Further columns of the ids
    come along. With ``read``, texts are not staged but read at each use; only where ids are null or not unique they
    are, as an id does not name a text then.
    """
    rows = cut_lineage(df.select(*[c for c in df.columns if c != text], _digest(text)))
    first = _first(rows, key)
    if read is not None and rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(
            F.col(key).isNull() | (F.col("n") > 1)).isEmpty():
        return _read_anew(rows, first, text, key, read)
    ids = first.select(F.col(key).alias("_first"))
    held = df.select(key, text).join(ids, F.col(key).eqNullSafe(F.col("_first")), "left_semi")
    texts = held.select(_digest(text), text).dropDuplicates([KEY]).join(first, KEY)
    return Apart(rows, cut_lineage(texts), text, key)
