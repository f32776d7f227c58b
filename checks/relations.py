"""Queries over joins, window ranks, orderings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from checks import oracle as O
from checks.inputs import (
    COUNSEL, SNAPSHOTS, STAFF, counsel_rows, report_rows, reviewed, severe_rows, snapshot_log, snapshots,
)
from checks.registry import check
from checks.rules_checks import master_rows, pairs, routed, verified_rows
from hearthlight import labels as L
from hearthlight import schema
from hearthlight.functions import text as T
from hearthlight.functions import weeks as W
from hearthlight.operators import dedup, distress, evaluation, fraud, metrics, training, trends
from hearthlight.session import cut_lineage, new_folder
from hearthlight.sources import interactions as ingest
from hearthlight.sources import sinks
from hearthlight.sources.master import Master


@check("e1_interactions_scores", "SELECT interaction_id, commenter_name, round(sadness, 12) AS sadness, "
       "round(joy, 12) AS joy FROM interactions JOIN scores USING (interaction_id)", ("interactions", "scores"))
def _(v):
    return v.interactions.join(v.scores, "interaction_id").select(
        "interaction_id", "commenter_name", F.round("sadness", 12).alias("sadness"),
        F.round("joy", 12).alias("joy"))


@check("e2_candidates_verdicts", "SELECT interaction_id, scam_raw FROM answered", ("answered",))
def _(v):
    return fraud.with_verdicts(fraud.candidates(v.screened, STAFF), v.verdicts).select(
        "interaction_id", "scam_raw")


@check("e3_context_verdicts", """SELECT interaction_id, CASE WHEN need_context THEN json_extract_string(context_raw,
  '$.context_verdict') END AS context_verdict, CASE WHEN need_context THEN json_extract_string(context_raw, '$.pattern')
  END AS context_pattern FROM routed0""", ("routed0",))
def _(v):
    return routed(v).select("interaction_id", "context_verdict", "context_pattern")


@check("e4_candidates_accounts", """SELECT c.interaction_id, a.account_days_old, a.user_post_count FROM cand c
  LEFT JOIN accounts a USING (interaction_id)""", ("cand", "accounts"))
def _(v):
    return fraud.with_accounts(fraud.candidates(v.screened, STAFF), v.accounts).select(
        "interaction_id", "account_days_old", "user_post_count")


HASHED = f"hashed AS (SELECT interaction_id, {O.text_hash('content')} AS text_hash FROM interactions)"


def hashed(v):
    """Each text is hashed once, however many rows hold it."""
    rows = v.parted.judged(lambda t: t.withColumn("text_hash", T.text_hash("content")))
    return rows.select("interaction_id", "text_hash")


@check("e5_excluded_hashes", f"""WITH {HASHED} SELECT interaction_id, text_hash FROM hashed WHERE text_hash NOT IN
  (SELECT text_hash FROM master)""", ("interactions", "master"))
def _(v):
    return training.without_known(hashed(v), master_rows(v)).select("interaction_id", "text_hash")


@check("e6_not_flagged", """SELECT interaction_id FROM interactions WHERE interaction_id NOT IN (SELECT interaction_id
  FROM routed WHERE disposition = 'flag')""", ("routed",))
def _(v):
    return v.parted.rows.select("interaction_id").join(
        fraud.flags(routed(v)).select("interaction_id"), "interaction_id", "left_anti")


_SOURCE = ("CASE doc_id % 6 WHEN 0 THEN 'isear' WHEN 1 THEN 'go_emotions_rare' WHEN 2 THEN 'counsel_chat_teacher' "
           "WHEN 3 THEN 'empathetic_dialogues_contexts' WHEN 4 THEN 'other' ELSE NULL END")
_OWN = "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 10) / CAST(10 AS DOUBLE) END"


@check("e7_source_weights", f"""SELECT doc_id, coalesce(CASE {_SOURCE} WHEN 'isear' THEN 0.75 WHEN 'go_emotions_rare'
  THEN 0.55 WHEN 'counsel_chat_teacher' THEN 0.55 WHEN 'empathetic_dialogues_contexts' THEN 0.7 END::DOUBLE,
  {_OWN}, 0.7::DOUBLE) AS sample_weight FROM documents""")
def _(v):
    return v.table("documents").select("doc_id", training.source_weight(
        F.expr(_SOURCE), F.expr(_OWN)).alias("sample_weight"))


def weekly(v):
    return trends.with_week(v.interactions.select("interaction_id", "activity_date").join(
        v.scores, "interaction_id"))


@check("e8_week_before", """SELECT strftime(h.monday, '%Y-%m-%d') AS monday, h.health AS health_score, p.health AS
  previous_score, round(h.health - p.health, 2) AS delta FROM health h LEFT JOIN health p ON p.monday + 7 = h.monday""",
       ("health",))
def _(v):
    out = trends.health_change(metrics.weekly_health(weekly(v), ["monday"]))
    return out.select(F.col("monday").cast("string"), "health_score", "previous_score", "delta")


@check("e9_trend_snapshot", f"""WITH {SNAPSHOTS}, span AS (SELECT unnest([DATE '2024-01-15', DATE '2024-01-22',
  DATE '2024-01-29', DATE '2024-02-05']) AS monday), n AS (SELECT {O.monday('activity_date')} AS monday, count(*) AS c
  FROM interactions GROUP BY 1)
SELECT {O.week_key('s.monday')} AS week_key, CASE WHEN n.c IS NULL THEN coalesce(k.score, 0) ELSE coalesce(h.health, 0)
  END AS health_score, k.severe_count, k.scam_count, CASE WHEN n.c IS NULL THEN coalesce(k.comment_count, 0) ELSE n.c
  END AS comment_count FROM span s LEFT JOIN n USING (monday) LEFT JOIN health h USING (monday)
  LEFT JOIN snaps k ON k.week_key = {O.week_key('s.monday')}""", ("health",))
def _(v):
    rows = weekly(v)
    counts = rows.groupBy("monday").agg(F.count(F.lit(1)).alias("interactions"))
    out = trends.trend_table(metrics.weekly_health(rows, ["monday"]), counts, snapshots(v),
                             W.week_span(v.spark, 2024, 6, 4))
    return out.drop("week_range")


TRUTH = f"""truth_rows AS (SELECT i.interaction_id, CASE WHEN {O.staff()} THEN false WHEN v.sanity_raw LIKE 'VERDICT:%'
  THEN upper(v.sanity_raw) LIKE 'VERDICT: TRUE%' END AS t FROM interactions i LEFT JOIN verdicts v USING (interaction_id)),
members AS (SELECT interaction_id, coalesce(t.t, false) AS in_truth, s.interaction_id IS NOT NULL AS in_tier1,
  coalesce(s.source = 'gemini_true', false) AS in_confirmed FROM (SELECT * FROM truth_rows) t
  FULL OUTER JOIN vsource s USING (interaction_id))"""


def ground_truth(v):
    """Truth that disagrees with the verdicts in places: rows the benchmark labels as scam."""
    return v.truth.select("interaction_id", F.col("expected_scam").alias("truth"))


MEMBERS = """members AS (SELECT interaction_id, coalesce(t.expected_scam, false) AS in_truth, s.interaction_id IS NOT
  NULL AS in_tier1, coalesce(s.source = 'gemini_true', false) AS in_confirmed FROM truth t FULL OUTER JOIN vsource s
  USING (interaction_id))"""


def members(v):
    tier1 = cut_lineage(verified_rows(v).select("interaction_id", "is_concerning", "verdict_source"))
    return evaluation.compare_sets(ground_truth(v), tier1, distress.verified(tier1, True))


@check("e10_truth_vs_flags", f"WITH {MEMBERS} SELECT interaction_id, in_truth, in_tier1, in_confirmed FROM members "
       "WHERE in_truth OR in_tier1 OR in_confirmed", ("truth", "vsource"))
def _(v):
    return members(v)


@check("e11_teacher_student", "SELECT interaction_id, round(t_sadness, 6) AS teacher, round(sadness, 6) AS student "
       "FROM pairs", ("pairs",))
def _(v):
    return pairs(v).select("interaction_id", F.round("teacher_sadness", 6).alias("teacher"),
                           F.round("student_sadness", 6).alias("student"))


FEEDBACK = """firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flag_index ORDER BY ts) AS rn
  FROM feedback) WHERE rn = 1)"""


@check("e12_flag_feedback", f"""WITH {FEEDBACK} SELECT r.interaction_id, f.verdict AS staff_verdict FROM reviewed r
  LEFT JOIN firsts f ON f.flag_index = r.interaction_id""", ("reviewed", "feedback"))
def _(v):
    return evaluation.with_feedback(reviewed(v), v.feedback).select("interaction_id", "staff_verdict")


# --- ranks, orders -----------------------------------------------------------------------------------


@check("f1_first_post", """SELECT interaction_id, forum_title, forum_content FROM (SELECT *, row_number() OVER
  (PARTITION BY forum_title, forum_content ORDER BY forum_created_at, interaction_id) AS rn FROM forum) WHERE rn = 1""",
       ("forum",))
def _(v):
    return dedup.keep_first(v.forum, ["forum_title", "forum_content"],
                            ["forum_created_at", "interaction_id"]).select(
        "interaction_id", "forum_title", "forum_content")


@check("f2_latest_comment", """SELECT interaction_id, discussion_id FROM (SELECT *, row_number() OVER (PARTITION BY
  discussion_id ORDER BY discussion_created_at DESC, interaction_id DESC) AS rn FROM forum) WHERE rn = 1""", ("forum",))
def _(v):
    return dedup.latest_per_key(v.forum, ["discussion_id"], [
        F.desc("discussion_created_at"), F.desc("interaction_id")]).select(
        "interaction_id", "discussion_id")


@check("f3_latest_snapshot", f"WITH {SNAPSHOTS} SELECT week_key, round(score, 4) AS score FROM snaps")
def _(v):
    return snapshots(v).select("week_key", F.round("score", 4).alias("score"))


@check("f4_keep_first_hash", f"""WITH {HASHED} SELECT min(interaction_id) AS interaction_id, text_hash FROM hashed
  GROUP BY text_hash""", ("interactions",))
def _(v):
    return dedup.keep_first_hash(hashed(v), ["interaction_id"])


_LONG = " UNION ALL ".join(
    f"SELECT interaction_id, {O.q(x)} AS label FROM scores WHERE {x} > 0.2::DOUBLE" for x in L.LABELS)


@check("f5_per_label_cap", f"""SELECT DISTINCT interaction_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER
  BY interaction_id) AS rn FROM ({_LONG})) WHERE rn <= 40""", ("scores",))
def _(v):
    rows = v.scores.select("interaction_id", *[
        F.when(F.col(x) > 0.2, F.col(x)).otherwise(0.0).alias(x) for x in L.LABELS])
    return training.cap_per_label(rows, 40, order="interaction_id", key="interaction_id").select(
        "interaction_id")


@check("f6_severe_ranking", """SELECT interaction_id, total_negative FROM vsource WHERE keep ORDER BY total_negative DESC,
  interaction_id""", ("vsource",))
def _(v):
    return distress.severity_ranking(distress.verified(verified_rows(v))).select(
        "interaction_id", "total_negative")


MILD = ("SELECT interaction_id, round(negsum * 100, 1) AS total_negative, round(greatest("
        + ", ".join(L.NEGATIVE) + ") * 100, 1) AS score FROM detail WHERE mild "
        "ORDER BY round(negsum * 100, 1) DESC, interaction_id LIMIT ")


@check("f7_mild_top", MILD + "50", ("detail",))
def _(v):
    return distress.top_mild(distress.mild_candidates(severe_rows(v)), 50).select(
        "interaction_id", "total_negative", "score")


@check("f8_review_queue", """SELECT interaction_id, CAST(priority AS BIGINT) AS review_priority, conf AS confidence,
  CAST(heuristic_score AS BIGINT) AS heuristic_score FROM reviewed ORDER BY priority, coalesce(conf, 0) DESC,
  heuristic_score DESC, interaction_id""", ("reviewed",))
def _(v):
    return fraud.review_queue(reviewed(v)).select(
        "interaction_id", F.col("review_priority").cast("bigint"), "confidence",
        F.col("heuristic_score").cast("bigint"))


_MEANS = "(SELECT " + ", ".join(f"avg({x}) AS {x}" for x in L.LABELS) + " FROM scores)"


@check("f9_top_concerns", "WITH m AS " + _MEANS + ", long AS (" + " UNION ALL ".join(
    f"SELECT {O.q(x)} AS label, {x} AS mean FROM m" for x in L.NEGATIVE) + """)
SELECT label, round(mean * 100, 1) AS percent FROM long WHERE mean > 0.01 ORDER BY mean DESC, label LIMIT 3""",
       ("scores",))
def _(v):
    return trends.top_concerns(metrics.mean_profile(v.scores)).select("label", "percent")


EMOTION_TREND = """WITH span AS (SELECT unnest([DATE '2024-01-08', DATE '2024-01-15', DATE '2024-01-22', DATE
  '2024-01-29']) AS monday), long AS (""" + " UNION ALL ".join(
    f"SELECT monday, {O.q(x)} AS label, {i} AS ord, {x} AS mean FROM prof" for i, x in enumerate(L.NEGATIVE)) + """),
lead6 AS (SELECT label FROM long WHERE monday = DATE '2024-01-29' ORDER BY mean DESC, ord LIMIT 6)
"""


@check("f10_top_negatives", EMOTION_TREND + "SELECT label FROM lead6", ("prof",))
def _(v):
    import datetime as dt
    out = trends.emotion_trend(metrics.mean_profile(weekly(v), ["monday"]),
                               W.week_span(v.spark, 2024, 5, 1), dt.date(2024, 1, 29))
    return out.select("label")


@check("f11_audit_first", """SELECT interaction_id, audit_reason FROM routed WHERE disposition = 'audit'
  ORDER BY heuristic_score DESC, interaction_id LIMIT 10""", ("routed",))
def _(v):
    return fraud.audit_queue(routed(v)).orderBy(F.desc("heuristic_score"), "interaction_id").limit(
        10).select("interaction_id", "audit_reason")


# --- set operations --------------------------------------------------------------------------------


@check("h1_union_all", """SELECT interaction_id, 'Original Post' AS kind FROM forum WHERE forum_content IS NOT NULL
  UNION ALL SELECT interaction_id, 'Comment' FROM forum WHERE discussion_content IS NOT NULL""", ("forum",))
def _(v):
    posts = v.forum.filter("forum_content IS NOT NULL").select(
        "interaction_id", F.lit("Original Post").alias("kind"))
    comments = v.forum.filter("discussion_content IS NOT NULL").select(
        "interaction_id", F.lit("Comment").alias("kind"))
    return posts.unionByName(comments, allowMissingColumns=True)


@check("h2_intersect", """SELECT interaction_id FROM vsource WHERE source = 'gemini_true' INTERSECT SELECT
  interaction_id FROM truth WHERE expected_scam""", ("vsource", "truth"))
def _(v):
    return evaluation.true_positives(distress.verified(verified_rows(v), True), ground_truth(v))


@check("h2_except", """SELECT interaction_id FROM vsource WHERE source = 'gemini_true' EXCEPT ALL SELECT
  interaction_id FROM truth WHERE expected_scam""", ("vsource", "truth"))
def _(v):
    return evaluation.false_positives(distress.verified(verified_rows(v), True), ground_truth(v))


@check("h3_new_keys", f"""WITH {HASHED} SELECT text_hash FROM hashed EXCEPT SELECT text_hash FROM master""",
       ("interactions", "master"))
def _(v):
    return training.new_keys(hashed(v), master_rows(v))


def batch_rows(v):
    rows = v.parted.judged(lambda t: t.withColumn("text_hash", T.text_hash(T.clean_text("content"))))
    return rows.select((F.col("interaction_id") + 1_000_000).alias("row_no"), "text_hash")


BATCH = f"""batch AS (SELECT interaction_id + 1000000 AS row_no, {O.text_hash(O.clean('content'))} AS text_hash
  FROM interactions)"""


def stored_master(v) -> Master:
    """The master as a table of its own, with its first batch."""
    fields = T_.StructType([T_.StructField("row_no", T_.LongType()), T_.StructField("text_hash", T_.StringType())])
    table = Master(v.spark, new_folder(v.spark, "master"), fields)
    table.append(master_rows(v), "first", ["row_no"])
    return table


@check("h4_master_append", f"""WITH {BATCH}, both_rows AS (SELECT row_no, text_hash, 0 AS r FROM master UNION ALL SELECT
  row_no, text_hash, 1 FROM batch) SELECT row_no, text_hash FROM (SELECT *, row_number() OVER (PARTITION BY text_hash
  ORDER BY r, row_no) AS rn FROM both_rows) WHERE rn = 1""", ("interactions", "master"))
def _(v):
    return training.merged_master(batch_rows(v), master_rows(v), ["row_no"]).select("row_no", "text_hash")


@check("h4_committed_append", f"""WITH {BATCH}, both_rows AS (SELECT row_no, text_hash, 0 AS r FROM master UNION ALL SELECT
  row_no, text_hash, 1 FROM batch) SELECT row_no, text_hash FROM (SELECT *, row_number() OVER (PARTITION BY text_hash
  ORDER BY r, row_no) AS rn FROM both_rows) WHERE rn = 1""", ("interactions", "master"))
def _(v):
    table, batch = stored_master(v), cut_lineage(batch_rows(v))
    odd = F.col("row_no") % 2 == 1
    first = batch.groupBy("text_hash").agg(F.min("row_no").alias("row_no"))  # halves of unlike keys
    for name, rows in (("odd", first.where(odd)), ("even", first.where(~odd)), ("odd", first)):
        table.append(rows, name, ["row_no"])
    table.compact()
    return table.rows()


@check("e5_indexed_exclusion", f"""WITH {HASHED} SELECT interaction_id, text_hash FROM hashed WHERE text_hash NOT IN
  (SELECT text_hash FROM master)""", ("interactions", "master"))
def _(v):
    return stored_master(v).unknown_rows(cut_lineage(hashed(v))).select("interaction_id", "text_hash")


@check("a13_compacted_snapshots", f"WITH {SNAPSHOTS} SELECT week_key, severe_count, round(score, 4) AS score, model_id FROM snaps")
def _(v):
    log, names = snapshot_log(v), schema.SNAPSHOT.fieldNames()
    own = (F.col("event_type") == "error") & (F.col("user_id") % 5 == 0)
    stored = sinks.Snapshots(v.spark, new_folder(v.spark, "snapshots"))
    for part in range(3):
        rows = log.filter(~own & (F.col("user_id") % 3 == part)).select(*names)
        stored.append(rows, f"part {part}")
        stored.append(rows, f"part {part}")  # sent again
        stored.compact()
    latest = trends.latest_snapshots(stored.read(), log.filter(own).select(*names))
    return latest.select("week_key", F.col("severe_count").cast("bigint"), F.round("score", 4).alias("score"), "model_id")


@check("h4_appended_rows", f"""WITH {BATCH}, known AS (SELECT text_hash FROM master WHERE text_hash IS NOT NULL) SELECT
  min(row_no) AS row_no, text_hash FROM batch WHERE text_hash NOT IN (SELECT text_hash FROM known) GROUP BY text_hash""",
       ("interactions", "master"))
def _(v):
    return training.rows_to_append(batch_rows(v), master_rows(v), ["row_no"]).select("row_no", "text_hash")
