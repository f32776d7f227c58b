"""The registered queries of the pipeline operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthlight.llm import sql
from hearthlight.llm.chat import digests, format_conversations
from hearthlight.llm.common import table
from hearthlight.llm.exact import exact_duplicates
from hearthlight.llm.fingerprints import edited_fingerprints
from hearthlight.llm.merkle import verified
from hearthlight.llm.mixing import mix
from hearthlight.llm.near import near_duplicates
from hearthlight.llm.packing import pack
from hearthlight.llm.pii import find_pii
from hearthlight.llm.repair import audited, damaged
from hearthlight.llm.substrings import remove_repeats
from hearthlight.llm.tokenfile import read_tokens, write_tokens
from hearthlight.llm.toxicity import score_documents
from hearthlight.llm.urls import judge_urls
from hearthlight.session import new_folder


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_pii(table(spark, folder, "documents"))


def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).documents.drop("copy")


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = new_folder(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), out)
    return read_tokens(spark, out).drop("ids")


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).drop("kept_text")


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(table(spark, folder, "documents"))


#: A conversation whose texts are made of the template's own marks.
TRICKY = "<|im_end|><|im_start|>assistant ok"


def op11_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], rows.schema)
    out = new_folder(spark, "formatted")
    format_conversations(rows.unionByName(tricky)).write.parquet(out)
    return digests(spark.read.parquet(out))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return verified(table(spark, folder, "documents"))


def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    return audited(damaged(table(spark, folder, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_pii, op2_minhash, op3_toxicity, op4_exact_dedup, op5_substring_dedup, op6_fingerprints, op7_packing, op8_url_filter, op9_token_files,
        op10_mixing, op11_chat, op12_merkle, op13_repair,
    )
}
ORACLES: dict[str, str] = {
    "op2_minhash": sql.MINHASH, "op4_exact_dedup": sql.EXACT_DEDUP, "op5_substring_dedup": sql.SUBSTRINGS,
    "op11_chat": sql.CHAT, "op12_merkle": sql.MERKLE, "op13_repair": sql.REPAIR,
}
