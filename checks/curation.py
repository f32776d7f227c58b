"""Queries over sampling, training data, evaluation jobs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import oracle as O
from checks.inputs import COUNSEL, EXACT_OUT, STAFF, counsel_rows, indexed_rows, report_rows
from checks.inputs import _EXACT, _INDEXED, _NAMES, REPORT_NAMED
from checks.registry import check
from checks.relations import MEMBERS, members
from checks.reports import BENCH, _CATEGORY, _R3, audited, benchmark, misses_sql
from checks.rules_checks import DISAGREE, master_rows, pairs, taught, training_rows
from checks.views import Views
from hearthlight import labels as L
from hearthlight import rules as R
from hearthlight.functions import text as T
from hearthlight.functions import weeks as W
from hearthlight.operators import dedup, distress, evaluation, fraud, metrics, sampling, training
from hearthlight.session import cut_lineage, new_folder
from hearthlight.sources import sinks
from hearthlight.sources.commits import FolderTable
from hearthlight.streaming import jobs as streams

SIZE = 300
_PLAN = list(R.SAMPLING_PLAN)


@check("i1_bucket_allocation", "WITH t AS (SELECT DISTINCT user_id AS total FROM events), p AS (SELECT * FROM (VALUES "
       + ", ".join(f"({O.q(n)}, {s}::DOUBLE, {i})" for i, (n, s) in enumerate(_PLAN)) + """) AS x(bucket, share, place)),
g AS (SELECT total, bucket, share, place, CAST(floor(total * share) AS BIGINT) AS base, total * share - floor(total * share)
  AS rest FROM t, p), r AS (SELECT *, row_number() OVER (PARTITION BY total ORDER BY rest DESC, share DESC, place) AS rn,
  total - sum(base) OVER (PARTITION BY total) AS spare FROM g)
SELECT total, bucket, base + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS target FROM r""")
def _(v):
    totals = v.table("events").select(F.col("user_id").alias("total")).distinct()
    return sampling.bucket_target_table(totals, "total")


def _sample_sql(total: int) -> str:
    """The buckets are filled one after the other, each from what the earlier ones left."""
    targets = sampling.bucket_targets(total)
    parts = [f"keyed AS (SELECT *, {O.draw('text_hash')} AS dk FROM masks)"]
    taken: list[str] = []

    def left() -> str:
        if not taken:
            return ""
        used = " UNION ALL ".join(f"SELECT text_hash FROM {x}" for x in taken)
        return f" AND text_hash NOT IN ({used})"
    for i, (name, _) in enumerate(_PLAN):
        parts.append(f"b{i} AS (SELECT text_hash, {O.q(name)} AS sampler_bucket FROM keyed WHERE m{i + 1}{left()} "
                     f"ORDER BY dk, text_hash LIMIT {targets[name]})")
        taken.append(f"b{i}")
    union = " UNION ALL ".join(f"SELECT * FROM {x}" for x in taken)
    parts.append(f"got AS ({union})")
    parts.append("fill AS (SELECT text_hash, 'random_fill' AS sampler_bucket FROM (SELECT *, row_number() OVER (ORDER BY dk, "
                 f"text_hash) AS fill_no FROM keyed WHERE true{left()}) WHERE fill_no <= {total} - (SELECT count(*) FROM got))")
    return "WITH " + ", ".join(parts) + " SELECT text_hash, sampler_bucket FROM got UNION ALL SELECT * FROM fill"


@check("i2_stratified_sample", _sample_sql(2000), ("masks",))
def _(v):
    masked = sampling.with_bucket_masks(cut_lineage(training_rows(v)))
    return sampling.stratified_sample(masked, 2000, "text_hash").select("text_hash", "sampler_bucket")


@check("i3_training_sample", _sample_sql(SIZE), ("masks",))
def _(v):
    return sampling.draw_training_sample(v.parted, v.scores, SIZE, master_rows(v)).select(
        "text_hash", "sampler_bucket")


@check("i4_teacher_labels", "SELECT interaction_id, valid, CASE WHEN valid THEN " + O.active("t_")
       + " END AS labels, round(t_sadness, 6) AS sadness, round(t_desire, 6) AS desire FROM taught", ("taught",))
def _(v):
    rows = taught(v)
    return rows.select("interaction_id", "valid", F.when(F.col("valid"), F.col("labels")).alias("labels"),
                       F.round("sadness", 6).alias("sadness"), F.round("desire", 6).alias("desire"))


@check("i5_uniform_sample", f"SELECT event_id FROM events ORDER BY {O.draw('event_id')}, event_id LIMIT 500")
def _(v):
    return sampling.uniform_sample(v.table("events"), 500, "event_id").select("event_id")


@check("i6_miss_audit", f"WITH {misses_sql(50)} SELECT interaction_id, commenter_name, missed FROM audited",
       ("routed", "verdicts"))
def _(v):
    return audited(v, 50).select("interaction_id", "commenter_name", "missed")


def exact(v):
    return training.exact_indexed(indexed_rows(v), L.LABELS)


_RARE = f"""rare_long AS ({' UNION ALL '.join(f"SELECT row_no, h, {O.q(x)} AS label FROM final WHERE {x} > 0"
                                             for x in L.RARE_SUPPLEMENT)}), picked AS (SELECT DISTINCT row_no FROM (SELECT
  *, row_number() OVER (PARTITION BY label ORDER BY row_no) AS k FROM rare_long) WHERE k <= 20)"""


@check("i7_rare_supplement", _INDEXED + _EXACT + ", " + _RARE + f"""SELECT row_no, h AS text_hash, {_NAMES} AS labels,
  'external_go_rare' AS sampler_bucket, 0.55::DOUBLE AS sample_weight FROM final WHERE row_no IN (SELECT row_no FROM picked)""",
       ("external",))
def _(v):
    return training.rare_supplement(exact(v), 20).select(*EXACT_OUT)


@check("i8_external_preview", _INDEXED + _EXACT + ", " + _RARE + f""", m AS (SELECT row_no, {O.clean(O.clean('text'))} AS c
  FROM external WHERE label_code BETWEEN 1 AND 7), mapped AS (SELECT *, {O.text_hash('c')} AS h FROM m WHERE length(c) >= 12),
both_rows AS (SELECT row_no, h, 'go_emotions_rare' AS source_dataset, 0.55::DOUBLE AS sample_weight, 0 AS r FROM final WHERE
  row_no IN (SELECT row_no FROM picked) UNION ALL SELECT min(row_no), h, 'isear', 0.75::DOUBLE, 1 FROM mapped GROUP BY h),
known AS (SELECT {O.text_hash('text')} AS h FROM external WHERE label_a < 5),
chosen AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY r, row_no) AS rn FROM both_rows)
SELECT row_no, h AS text_hash, source_dataset, sample_weight FROM chosen WHERE rn = 1 AND h NOT IN (SELECT h FROM known)""",
       ("external",))
def _(v):
    known = v.external.filter("label_a < 5").select(T.text_hash("text").alias("text_hash"))
    rows = training.external_preview(
        training.rare_supplement(exact(v), 20), training.mapped_reports(report_rows(v)), known)
    return rows.select("row_no", "text_hash", "source_dataset", "sample_weight")


@check("i9_external_finalize", f"""WITH c AS (SELECT row_no, {O.clean('text')} AS text FROM external), k AS (SELECT *,
  {O.text_hash('text')} AS text_hash FROM c WHERE length(text) >= 12) SELECT min(row_no) AS row_no, text_hash FROM k
  GROUP BY text_hash""", ("external",))
def _(v):
    return training.finalize_external(v.external.select("row_no", "text")).select("row_no", "text_hash")


@check("i10_external_selection", f"""WITH {COUNSEL}, known AS (SELECT {O.text_hash('text')} AS h FROM conversations WHERE
  turn = 0) SELECT row_no, text_hash FROM counsel WHERE length(text) >= 12 AND text_hash NOT IN (SELECT h FROM known)
  ORDER BY {O.draw('text_hash')}, text_hash LIMIT 300""")
def _(v):
    known = v.table("conversations").filter("turn = 0").select(T.text_hash("text").alias("text_hash"))
    return training.external_selection(training.unlabeled_candidates(counsel_rows(v)), known).select(
        "row_no", "text_hash")


@check("i11_benchmark_report", f"WITH {BENCH} SELECT interaction_id, category, y AS expected_scam, p AS tier1_flag, c AS "
       "cascade_flag FROM bench", ("scan", "truth", "routed"))
def _(v):
    return benchmark(v).select("interaction_id", "category", "expected_scam", "tier1_flag", "cascade_flag")


@check("i12_model_report", f"""WITH sampled AS (SELECT interaction_id FROM pool ORDER BY {O.draw('interaction_id')},
  interaction_id LIMIT 1000), mine AS (SELECT * FROM pairs WHERE interaction_id IN (SELECT interaction_id FROM sampled)) """
       + " UNION ALL ".join(
           f"SELECT {O.q(x.title())} AS emotion, count(*) FILTER (WHERE t_{x} >= {t} AND {x} >= {t}) AS tp, count(*) FILTER "
           f"(WHERE t_{x} < {t} AND {x} >= {t}) AS fp, count(*) FILTER (WHERE t_{x} >= {t} AND {x} < {t}) AS fn FROM mine"
           for x, t in ((x, f"{L.DEFAULT_THRESHOLDS[x]!r}::DOUBLE") for x in L.LABELS)), ("pool", "pairs"))
def _(v):
    confusion = metrics.label_confusion(pairs(v, size=1000))
    return confusion.select(F.initcap("label").alias("emotion"), "tp", "fp", "fn")


@check("i13_ground_truth", f"""WITH {MEMBERS} SELECT interaction_id, CASE WHEN in_truth AND in_confirmed THEN 'true_positive'
  WHEN in_confirmed THEN 'false_positive' ELSE 'false_negative' END AS outcome, in_truth AND NOT in_tier1 AS tier1_missed
  FROM members WHERE in_truth OR in_confirmed""", ("truth", "vsource"))
def _(v):
    return evaluation.set_outcome(members(v))


@check("i13_reviewer_truth", f"""SELECT i.interaction_id, CAST(CASE WHEN {O.staff()} THEN false WHEN v.sanity_raw LIKE
  'VERDICT: True%' THEN true WHEN v.sanity_raw LIKE 'VERDICT: False%' THEN false END AS VARCHAR) AS truth
  FROM interactions i LEFT JOIN verdicts v USING (interaction_id)""", ("interactions", "verdicts"))
def _(v):
    return evaluation.reviewer_truth(v.interactions, v.verdicts, STAFF).select(
        "interaction_id", F.col("truth").cast("string"))


@check("i14_capped_sample", "WITH " + REPORT_NAMED + _EXACT + ", " + f"""cap_long AS ({' UNION ALL '.join(
    f"SELECT row_no, {O.q(x)} AS label FROM final WHERE {x} > 0" for x in L.LABELS)}), capped AS (SELECT DISTINCT row_no FROM
  (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_no) AS k FROM cap_long) WHERE k <= 40)
SELECT row_no, h AS text_hash FROM final WHERE row_no IN (SELECT row_no FROM capped) ORDER BY {O.draw('h')}, h LIMIT 200""",
       ("external",))
def _(v):
    return training.capped_sample(training.mapped_reports(report_rows(v)), 200, 10).select(
        "row_no", "text_hash")


# --- streams ------------------------------------------------------------------------------------------


def _source(v: Views, frame, name: str):
    """A folder of parquet files, read back as a stream."""
    path = new_folder(v.spark, name)
    frame.write.parquet(path)
    return v.spark.readStream.schema(v.spark.read.parquet(path).schema).parquet(path)


def _late_source(v: Views, rows):
    """Newest rows first, a quarter of them a batch."""
    path, parts = new_folder(v.spark, "late"), 4
    cut = F.pmod(F.weekofyear("activity_date"), F.lit(parts))
    for part in range(parts - 1, -1, -1):
        rows.filter(cut == part).write.mode("append").parquet(path)
    written = v.spark.read.parquet(path)
    files = -(-len(written.inputFiles()) // parts)
    return v.spark.readStream.schema(written.schema).option("maxFilesPerTrigger", files).parquet(path)


def _run(writer, v: Views) -> None:
    query = writer.option("checkpointLocation", new_folder(v.spark, "progress")).trigger(
        availableNow=True).start()
    query.awaitTermination()


@check("j1_stream_flags", "SELECT interaction_id, CAST(heuristic_score AS BIGINT) AS heuristic_score, severity_level FROM cand",
       ("cand",))
def _(v):
    stream = streams.flag_stream(_source(v, v.interactions, "interactions"), STAFF)
    path = new_folder(v.spark, "flags")
    out = stream.select("interaction_id", F.col("heuristic_score").cast("bigint"), "severity_level")
    _run(out.writeStream.format("parquet").option("path", path), v)
    return v.spark.read.parquet(path)


_WEEKLY = f"""SELECT {O.week_key('h.monday')} AS week_key, n.c AS interactions, round(h.health, 2) AS
  health_score FROM health h JOIN (SELECT {O.monday('ts')} AS monday, count(*) AS c FROM events GROUP BY 1) n USING (monday)"""


def _scored(v: Views):
    return v.table("events").select(F.col("event_id").alias("interaction_id"),
                                    F.col("ts").cast("timestamp").alias("activity_date")).join(
        v.scores, "interaction_id")


@check("j2_stream_weekly_health", _WEEKLY, ("health",))
def _(v):
    path = new_folder(v.spark, "weekly")
    _run(streams.log_weekly(_late_source(v, _scored(v)), path), v)
    return streams.read_weekly(v.spark.read.parquet(path)).select(
        "week_key", "interactions", "health_score")


@check("j2_event_time_weeks", _WEEKLY, ("health",))
def _(v):
    cells, weeks = new_folder(v.spark, "cells"), new_folder(v.spark, "weeks")
    _run(streams.upsert_weeks(_late_source(v, _scored(v)), cells, weeks, "base"), v)
    return sinks.Snapshots(v.spark, weeks).read().select(
        "week_key", F.col("comment_count").alias("interactions"), F.col("score").alias("health_score"))


_LATEST = """SELECT interaction_id, discussion_id FROM (SELECT *, row_number() OVER (PARTITION BY
  discussion_id ORDER BY discussion_created_at DESC, interaction_id DESC) AS rn FROM forum WHERE discussion_id IS NOT NULL)
  WHERE rn = 1"""


@check("j3_stream_latest", _LATEST, ("forum",))
def _(v):
    rows = v.forum.filter("discussion_id IS NOT NULL").select(
        "interaction_id", "discussion_id", "discussion_created_at")
    path = new_folder(v.spark, "latest")
    _run(streams.latest_comments(_source(v, rows, "comments"), path), v)
    return streams.read_latest(v.spark.read.parquet(path)).select("interaction_id", "discussion_id")


@check("j3_keyed_latest", _LATEST, ("forum",))
def _(v):
    rows = v.forum.filter("discussion_id IS NOT NULL").select(
        "interaction_id", "discussion_id", "discussion_created_at")
    path = new_folder(v.spark, "latest")
    _run(streams.keep_latest(_source(v, rows, "comments").select("*"), path), v)
    latest = streams.latest_discussions(FolderTable(v.spark, path), rows.schema)
    return latest.select("interaction_id", "discussion_id")
