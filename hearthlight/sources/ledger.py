"""A ledger of requests to a reviewer or scorer that lies outside, keyed by what is asked.

Equal prompts are one request, whoever asks them. A request goes out again until it has an answer that
is no error, or until it has been tried often enough. Requests go out in slices of their hash, each
committed when it is answered, so a run that stops in the middle goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlight.functions import verdicts
from hearthlight.operators.dedup import keep_first
from hearthlight.session import cut_lineage
from hearthlight.sources.commits import FolderTable

Answer = Callable[[DataFrame], DataFrame]


class Ledger:
    """``kind`` is the type of an answer: text of a reviewer, or a struct of scores. Text that
    starts like an error, and null, is no answer."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string"):
        self.table, self.kind = FolderTable(spark, path), kind
        self.schema = f"request string, answer {kind}, failed boolean, attempt int"

    def _failed(self):
        empty = F.col("answer").isNull()
        return empty | verdicts.is_error("answer") if self.kind == "string" else empty

    def states(self) -> DataFrame:
        """The answer of each request, or its last failure."""
        order = ["failed", F.desc("attempt"), F.xxhash64("answer")]
        return keep_first(self.table.rows(self.schema), ["request"], order)

    def pending(self, asked: DataFrame, attempts: int) -> DataFrame:
        """request, attempt: distinct requests that are to go out."""
        done = self.states().select("request", "failed", F.col("attempt").alias("before"))
        return asked.select("request").distinct().join(done, "request", "left").where(
            F.col("failed").isNull() | (F.col("failed") & (F.col("before") < attempts))
        ).select("request", (F.coalesce("before", F.lit(0)) + 1).alias("attempt"))

    def ask(self, prompts: DataFrame, answer: Answer, slices: int = 16, attempts: int = 3,
            fetch: Answer | None = None) -> int:
        """Sends what is pending, slice by slice, and returns the number of requests sent.

        ``prompts`` has a column ``prompt``; ``answer`` adds ``answer`` to request and prompt. Hashes say what is pending;
        only prompts that go out are staged. With ``fetch``, ``prompts`` has the hashes alone (``request``), and
        ``fetch`` returns request and prompt for a frame of them.
        """
        if fetch is None:
            asked = prompts.select(F.sha2("prompt", 256).alias("request"), "prompt").where("prompt is not null")
            fetch = lambda wanted: keep_first(
                asked.join(wanted, "request", "left_semi"), ["request"], ["request"])
            prompts = asked
        pending = cut_lineage(self.pending(prompts, attempts))
        if pending.isEmpty():
            return 0
        outbox = cut_lineage(fetch(pending.select("request")).select("request", "prompt"))
        run, sent = len(self.table.commits()), 0
        for part in range(slices):
            share = F.conv(F.substring("request", 1, 4), 16, 10).cast("int") % slices == part
            mine = pending.where(share)
            if mine.isEmpty():
                continue
            rows = cut_lineage(answer(outbox.where(share)).select("request", "answer").join(mine, "request", "right"))
            sent += rows.count()
            self.table.add(rows.select("request", "answer", self._failed().alias("failed"), "attempt"), f"{run}:{part}")
        return sent

    def answers(self, prompts: DataFrame, error: str = "ERROR: Timeout") -> DataFrame:
        """The prompts' rows with ``answer``; text answers that are missing are an error text. Rows may have
        ``request`` instead of the prompt."""
        found = self.states().select(F.col("request").alias("_request"), "answer")
        asked = F.col("request") if "prompt" not in prompts.columns else F.sha2("prompt", 256)
        rows = prompts.withColumn("_request", asked).join(found, "_request", "left").drop("_request")
        return rows.withColumn("answer", F.coalesce("answer", F.lit(error))) if self.kind == "string" else rows

    def compact(self) -> bool:
        def reduced(rows: DataFrame) -> DataFrame:
            return keep_first(rows, ["request"], ["failed", F.desc("attempt"), F.xxhash64("answer")])
        return self.table.compact(self.schema, reduced)
