"""The operators as stages of the corpus pipeline: documents in, documents out.

Both dedup stages choose rows, not ids: of rows that are repeated whole one stays, texts that share
an id are judged one by one, and rows without an id are documents like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlight.llm.common import DOCUMENT, table
from hearthlight.llm.exact import exact_duplicates
from hearthlight.llm.mixing import mixed_documents
from hearthlight.llm.near import Settings, near_duplicates
from hearthlight.llm.packing import pack
from hearthlight.llm.toxicity import THRESHOLD, score_texts, train, training_rows
from hearthlight.session import cut_lineage

#: Near duplicates in the pipeline: five words to a shingle, a similarity of 0.8 or more.
NEAR = Settings(words=5, percent=80)


def _documents(rows: DataFrame) -> DataFrame:
    return rows.select(*DOCUMENT)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a score of the threshold or more."""
    model = train(*training_rows(docs, table(spark, sf_dir, "labels")))
    return _documents(score_texts(_documents(docs), model).where(F.col("score") < THRESHOLD))


def numbered(docs: DataFrame, nulls_first: bool = False) -> DataFrame:
    """The documents with ``row``, a number of each row's own, in the order of the ids: the id
    itself, unless some row has none or shares it. Rows of one id follow by hashes of what they hold."""
    docs = _documents(docs)
    shared = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if shared.isEmpty():
        return docs.withColumn("row", F.col("doc_id"))
    by_id = F.asc_nulls_first("doc_id") if nulls_first else F.asc_nulls_last("doc_id")
    ordered = docs.orderBy(by_id, F.xxhash64("text"), F.xxhash64("lang", "source"), "n_chars")
    return cut_lineage(ordered.withColumn("row", F.monotonically_increasing_id()))


def _by_row(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("row").alias("doc_id"), "text")


def _kept(docs: DataFrame, judged: DataFrame) -> DataFrame:
    kept = judged.where("kept").select(F.col("doc_id").alias("row"))
    return _documents(docs.join(kept, "row", "left_semi"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the last one by id, null being the least."""
    docs = numbered(docs, nulls_first=True)
    return _kept(docs, exact_duplicates(_by_row(docs)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group of near duplicates by id, null being the greatest."""
    docs = numbered(docs)
    return _kept(docs, near_duplicates(_by_row(docs), NEAR))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, and parts of documents, that the mix takes; repeats are rows of their own."""
    docs = numbered(docs).withColumnsRenamed({"doc_id": "own_id", "row": "doc_id"})
    return _documents(mixed_documents(docs).drop("doc_id").withColumnRenamed("own_id", "doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in token sequences."""
    return pack(docs)
