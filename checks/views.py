"""Input views derived from the test tables, once for Spark and once as SQL for the oracle.

The expressions are shared where both engines read them the same way. Texts are used whole.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlight.labels import LABELS, NEGATIVE
from hearthlight.operators import distress, fraud, texts
from hearthlight.session import cut_lineage, new_folder
from hearthlight.sources import buckets

STAFF_DOMAIN = "staff.example.org"

PHRASES = (
    "''", "' dm me on whatsapp for a gift card'", "' claim your prize now at http://bit.ly/x'",
    "' email me at a.b@example.com'", "' i need help, we are struggling with rent'",
    "' is this a scam? beware'", "' Text SHOP to 85023 now to claim discount'",
    "' i mentor families and i help with moves'",
    "' <b>thank you</b> &amp; congratulations'",
)


def _case(key: str, values) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {key} {cases} ELSE {values[-1]} END"


def _text(value: str) -> str:
    return f"CAST({value} AS VARCHAR(20))"


INTERACTION_COLUMNS = {
    "interaction_id": "e.event_id",
    "activity_date": "e.ts",
    "user_id": "e.user_id",
    "activity_type": "CASE WHEN e.event_type = 'view' THEN 'Original Post' ELSE 'Comment' END",
    "content": f"concat(coalesce(x.text, ''), {_case('e.event_id % 9', PHRASES)})",
    "community_name": "x.source",
    "commenter_name": (
        f"CASE WHEN e.user_id % 25 = 0 THEN concat('Moderator ', {_text('e.user_id')}) "
        f"ELSE concat('Member ', {_text('e.user_id')}) END"
    ),
    "commenter_email": (
        f"CASE WHEN e.user_id % 40 = 0 THEN concat('u', {_text('e.user_id')}, '@{STAFF_DOMAIN}') "
        "WHEN e.user_id % 17 = 0 THEN NULL "
        f"ELSE concat('u', {_text('e.user_id')}, '@example.com') END"
    ),
}
FORUM_COLUMNS = {
    "interaction_id": "interaction_id",
    "forum_title": "CASE WHEN interaction_id % 50 = 0 THEN NULL "
                   f"ELSE concat('Topic ', {_text('interaction_id % 300')}) END",
    "forum_content": "CASE WHEN interaction_id % 60 = 0 THEN NULL "
                     "ELSE content END",
    "forum_created_at": "activity_date",
    "discussion_id": "CASE WHEN interaction_id % 31 = 0 THEN NULL ELSE interaction_id % 4000 END",
    "discussion_content": "CASE WHEN interaction_id % 37 = 0 THEN '   ' ELSE content END",
    "discussion_created_at": "activity_date",
    "community_name": "community_name",
    "commenter_name": "commenter_name",
    "commenter_email": "commenter_email",
}


def _score(i: int, label: str) -> str:
    base = f"(((event_id * 7919 + {(i + 1) * 104729}) % 1000) / CAST(1000 AS DOUBLE))"
    grown = (
        " * (CAST(1 + floor((extract(day FROM ts) - 1) / 7.0) AS DOUBLE) / CAST(5 AS DOUBLE))"
        if label in NEGATIVE else ""
    )
    return " * ".join([base] * 4) + grown


SCORE_COLUMNS = {"interaction_id": "event_id"} | {
    label: _score(i, label) for i, label in enumerate(LABELS)
}


def _answer(scam: str, confidence: str, indicators: str, action: str) -> str:
    return (
        f'{{"reasoning":"r","is_scam":{scam},"confidence":{confidence},'
        f'"indicators":{indicators},"recommended_action":"{action}"}}'
    )


FENCE = "```"
VERDICT_COLUMNS = {
    "interaction_id": "event_id",
    "scam_raw": _case("event_id % 7", (
        "'ERROR: 503'", "'not json'",
        "'" + _answer("true", "0.92", '["gift card","whatsapp"]', "block") + "'",
        "'" + _answer("true", "0.70", '["won"]', "flag_for_review") + "'",
        "'" + _answer("true", "0.70", '["giveaway","telegram"]', "block") + "'",
        "'" + _answer("false", "0.10", "[]", "allow") + "'",
        "concat('" + FENCE + "', 'json "
        + _answer("true", "0.88", '["zelle"]', "flag_for_review") + " ', '" + FENCE + "')",
    )),
    "context_raw": _case("event_id % 2", (
        """'{"context_verdict":"context_pass","pattern":"relocation","reasoning":"r"}'""",
        """'{"context_verdict":"context_fail","pattern":"predatory","reasoning":"r"}'""",
    )),
    "sanity_raw": _case("event_id % 5", (
        "'REASONING: r **VERDICT: True**'", "'VERDICT: False'", "'true'", "'unclear'",
        "'ERROR: 429'",
    )),
}
ACCOUNT_COLUMNS = {
    "interaction_id": "event_id", "account_days_old": "event_id % 30",
    "user_post_count": "1 + user_id % 3",
}
TRUTH_COLUMNS = {
    "interaction_id": "event_id", "expected_scam": "event_id % 9 IN (1, 2, 6)",
    "category": f"concat('cat_', {_text('event_id % 9')})",
}


def _teacher_value(i: int) -> str:
    digits = (
        f"CASE WHEN (event_id * 7 + {i * 13}) % 9 = 0 THEN (event_id * 31 + {i * 17}) % 100 "
        f"ELSE (event_id + {i}) % 5 END"
    )
    return f"lpad({_text(digits)}, 2, '0')"


TEACHER_COLUMNS = {
    "interaction_id": "event_id",
    "teacher_raw": (
        "CASE WHEN event_id % 11 = 0 THEN 'ERROR: 429' WHEN event_id % 13 = 0 THEN 'bad' ELSE "
        "concat('{\"reasoning\":\"r\"', "
        + ", ".join(
            f"',\"{label}\":0.', {_teacher_value(i)}" for i, label in enumerate(LABELS)
            if label != "desire")
        + ", ',\"desire\":\"none\"}') END"
    ),
}
FEEDBACK_COLUMNS = {
    "flag_index": "event_id % 997", "ts": "ts", "interaction_id": "event_id",
    "verdict": _case("event_id % 4", (
        "'CONFIRMED_SCAM'", "'FALSE_POSITIVE'", "'NEEDS_HUMAN_REVIEW'",
        "'CONFIRMED_SCAM (was suppressed)'")),
    "commenter_name": f"concat('Member ', {_text('user_id')})",
    "confidence": "(event_id % 100) / CAST(100 AS DOUBLE)",
    "comment_preview": f"concat('note ', {_text('event_id')})",
}
DOCUMENT_COLUMNS = {
    "row_no": "doc_id", "text": "text",
    "label_a": "CAST(doc_id % 30 AS INT)", "label_b": "CAST((doc_id * 7 + 3) % 28 AS INT)",
    "label_code": "CAST(doc_id % 9 AS INT)",
    "has_labels": "doc_id % 5 <> 0",
    "emotion_no": "CAST(doc_id % 34 AS INT)",
}

PROJECTIONS = {
    "scores": (SCORE_COLUMNS, "events", ""),
    "verdicts": (VERDICT_COLUMNS, "events", "event_id % 10 <> 9"),  # some rows have no answer
    "answers": (VERDICT_COLUMNS, "events", ""),
    "accounts": (ACCOUNT_COLUMNS, "events", ""),
    "truth": (TRUTH_COLUMNS, "events", ""),
    "teacher": (TEACHER_COLUMNS, "events", ""),
    "feedback": (FEEDBACK_COLUMNS, "events", ""),
    "external": (DOCUMENT_COLUMNS, "documents", ""),
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


class Views:
    """The views as Spark frames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in PROJECTIONS:
            columns, source, condition = PROJECTIONS[name]
            rows = self.table(source)
            rows = rows.filter(condition) if condition else rows
            return rows.selectExpr(*[f"{expr} AS {n}" for n, expr in columns.items()])
        raise AttributeError(name)

    @property
    def interactions(self) -> DataFrame:
        return self._interactions(self.table("events"))

    def interactions_of(self, ids: DataFrame) -> DataFrame:
        """The interactions with these ids; others are left out before they get their text. Columns that come with
        the ids are kept; those rows are staged, so that Spark knows how many they are before a text moves."""
        ids = ids.withColumnRenamed("interaction_id", "event_id")
        carried = [c for c in ids.columns if c != "event_id"]
        if not carried:
            return self._interactions(self.table("events").join(ids, "event_id", "left_semi"))
        needed = self.table("events").drop("props", "value").join(ids, "event_id")
        return self._interactions(cut_lineage(needed), carried)

    def _interactions(self, events: DataFrame, carried: list[str] | None = None) -> DataFrame:
        documents = self.table("documents").select("doc_id", "text", "source")
        events = events.selectExpr("*", f"event_id % {documents.count()} AS doc")
        if carried is None:
            # Both sides are dealt out in some parts a core: the rules run where the join brings the texts.
            cores = self.spark.sparkContext.defaultParallelism
            parts = max(texts.PARTS * cores, documents.rdd.getNumPartitions())
            documents, events = documents.repartition(parts, "doc_id"), events.repartition(parts, "doc")
        rows = events.alias("e").join(documents.alias("x"), F.col("x.doc_id") == F.col("e.doc"))
        return rows.selectExpr(*[f"{expr} AS {n}" for n, expr in INTERACTION_COLUMNS.items()], *(carried or []))

    @cached_property
    def parted(self) -> texts.Apart:
        """The interactions without their texts, and each text once."""
        return texts.split(self.interactions, read=self.interactions_of)

    @cached_property
    def screened(self) -> DataFrame:
        """The interactions with what the fraud rules read from their texts."""
        return self.parted.judged(fraud.screen)

    @cached_property
    def signalled(self) -> DataFrame:
        """The interactions with what the distress rules read from their texts."""
        return self.parted.judged(distress.with_text_signals)

    @property
    def forum(self) -> DataFrame:
        return self.interactions.selectExpr(
            *[f"{expr} AS {n}" for n, expr in FORUM_COLUMNS.items()])

    def forum_of(self, ids: DataFrame) -> DataFrame:
        """The forum rows with these ids, and the columns that come with the ids."""
        carried = [c for c in ids.columns if c != "interaction_id"]
        return self.interactions_of(ids).selectExpr(
            *[f"{expr} AS {n}" for n, expr in FORUM_COLUMNS.items()], *carried)


class BucketedViews(Views):
    """The views that a cascade joins, stored in buckets by their key first; interactions as screened."""

    def __init__(self, views: Views, names: tuple[str, ...], buckets: int = 16):
        super().__init__(views.spark, views.folder)
        self._stored = {n: buckets_of(views, n, buckets) for n in (
            "screened" if name == "interactions" else name for name in names)}

    def __getattribute__(self, name: str):
        stored = object.__getattribute__(self, "__dict__").get("_stored", {})
        return stored[name] if name in stored else super().__getattribute__(name)


def buckets_of(views: Views, name: str, n: int) -> DataFrame:
    path = new_folder(views.spark, f"bucketed_{name}")
    return buckets.store(getattr(views, name), path.rsplit("/", 1)[-1].replace("-", "_"), path, n)


def oracle_views() -> dict[str, tuple[tuple[str, ...], str]]:
    """Name to (views it reads, SQL)."""
    out = {
        name: ((), f"SELECT {_select(columns)} FROM {source}"
               + (f" WHERE {condition}" if condition else ""))
        for name, (columns, source, condition) in PROJECTIONS.items()
    }
    out["interactions"] = ((), (
        f"SELECT {_select(INTERACTION_COLUMNS)} FROM events e "
        "CROSS JOIN (SELECT count(*) AS c FROM documents) n "
        "JOIN documents x ON x.doc_id = e.event_id % n.c"
    ))
    out["forum"] = (("interactions",), f"SELECT {_select(FORUM_COLUMNS)} FROM interactions")
    return out
