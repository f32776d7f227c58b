"""Plug-in point for an emotion scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlight.functions import scores as S
from hearthlight.functions.text import explode_chunks
from hearthlight.labels import LABELS
from hearthlight.operators.texts import KEY, Apart, split
from hearthlight.session import cut_lineage
from hearthlight.sources.ledger import Ledger

Scorer = Callable[[list[str]], list[dict[str, float]]]


def score_texts(df: DataFrame, scorer: Scorer, content: str = "content",
                key: str = "interaction_id", batch: int = 32) -> DataFrame:
    """Run ``scorer`` over all texts and return key, 28 scores and ``failed_chunks``.

    Long texts are split into overlapping word windows and pooled by maximum. ``scorer`` takes a
    list of texts and returns one label-to-score mapping per text. A batch that fails is retried
    text by text; a text that still fails gets zeros and counts in ``failed_chunks``.
    """
    labels = list(LABELS)

    def one(texts: list[str]) -> list[dict[str, float] | None]:
        try:
            return scorer(texts)
        except Exception:
            return [None] if len(texts) == 1 else [one([t])[0] for t in texts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["chunk"].tolist()
            rows: list[dict[str, float] | None] = []
            for start in range(0, len(texts), batch):
                rows += one(texts[start:start + batch])
            out = pd.DataFrame([r or {} for r in rows], index=frame.index).reindex(columns=labels)
            out = out.astype("float64").fillna(0.0)
            out.insert(0, key, frame[key])
            out["failed"] = [int(r is None) for r in rows]
            yield out

    kind = dict(df.dtypes)[key]
    shape = f"{key} {kind}, " + ", ".join(f"{label} double" for label in labels) + ", failed int"
    pieces = explode_chunks(df.select(key, content), content).select(key, "chunk")
    return S.max_pool(pieces.mapInPandas(run, shape), key, failed_chunks=F.sum("failed"))


def score_with_memo(df: DataFrame | Apart, scorer: Scorer, ledger: Ledger, content: str = "content",
                    key: str = "interaction_id", batch: int = 32, slices: int = 16) -> DataFrame:
    """As ``score_texts``, but equal texts reach the scorer once, and texts of earlier runs not at
    all. The ledger holds ``SCORES``; texts with failed chunks are sent again next time. Rows may come parted
    from their texts already."""
    apart = df if isinstance(df, Apart) else split(df.select(key, content), content, key)
    # A text's key is its hash, so what to ask is known without reading texts; null is asked as ''.
    request = F.when(F.length(KEY) == 0, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(KEY))).alias("request")
    asked = cut_lineage(apart.rows.select(KEY, request).groupBy("request").agg(F.max(KEY).alias(KEY)))  # of '' and null, ''

    def fetch(wanted: DataFrame) -> DataFrame:
        texts = apart.of(asked.join(wanted, "request", "left_semi"))
        prompt = F.coalesce(apart.text, F.lit(""))
        return texts.select(F.sha2(prompt, 256).alias("request"), prompt.alias("prompt"))

    def answer(requests: DataFrame) -> DataFrame:
        scored = score_texts(requests, scorer, "prompt", "request", batch)
        whole = F.struct(*LABELS, "failed_chunks")
        return scored.select("request", F.when(F.col("failed_chunks") == 0, whole).alias("answer"))

    ledger.ask(asked, answer, slices, fetch=fetch)
    found = ledger.answers(asked.select("request"))
    rows = apart.rows.select(key, request).join(found, "request")
    return rows.select(
        key, *[F.coalesce(F.col("answer")[label], F.lit(0.0)).alias(label) for label in LABELS],
        F.col("answer").isNull().alias("failed"))


SCORES = "struct<" + ", ".join(f"{label}: double" for label in LABELS) + ", failed_chunks: bigint>"
