"""Queries over aggregates and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import oracle as O
from checks.inputs import STAFF, reviewed, severe_rows
from checks.registry import check
from checks.relations import (
    BATCH, EMOTION_TREND, MEMBERS, _MEANS, batch_rows, members, stored_master, weekly,
)
from checks.rules_checks import master_rows, pairs, routed, taught, training_rows, verified_rows
from checks.views import Views
from hearthlight import labels as L
from hearthlight.functions import verdicts as V
from hearthlight.functions import weeks as W
from hearthlight.operators import distress, evaluation, fraud, metrics, sampling, training, trends
from hearthlight.plans import jobs
from hearthlight.session import cut_lineage


def by_week(df):
    return df.withColumn("monday", F.col("monday").cast("string"))


_DAY = "strftime(monday, '%Y-%m-%d') AS monday"


@check("g1_mean_profile", f"SELECT {_DAY}, " + ", ".join(f"round({x}, 6) AS {x}" for x in L.LABELS)
       + " FROM prof", ("prof",))
def _(v):
    rows = metrics.mean_profile(weekly(v), ["monday"])
    return by_week(rows.select("monday", *[F.round(x, 6).alias(x) for x in L.LABELS]))


@check("g2_health_score", f"SELECT {_DAY}, health AS health_score FROM health", ("health",))
def _(v):
    return by_week(metrics.weekly_health(weekly(v), ["monday"]))


def detailed(v):
    return trends.with_week(severe_rows(v))


@check("g3_negative_dominant", f"""SELECT {_DAY}, count(*) FILTER (WHERE top_score > 0 AND list_contains([{', '.join(
    map(O.q, L.NEGATIVE))}], top_label)) AS negative_dominant FROM (SELECT {O.monday('e.ts')} AS monday,
  {O.first_max(L.LABELS)} AS top_label, {O.greatest(L.LABELS)} AS top_score FROM scores s JOIN events e ON
  e.event_id = s.interaction_id) GROUP BY 1""", ("scores",))
def _(v):
    return by_week(weekly(v).groupBy("monday").agg(
        metrics.count_true(metrics.is_negative_dominant()).alias("negative_dominant")))


@check("g4_mild_count", f"SELECT {_DAY}, count(*) FILTER (WHERE mild) AS mild_candidates FROM wk GROUP BY 1", ("wk",))
def _(v):
    return by_week(metrics.weekly_counts(detailed(v), ["monday"]).select("monday", "mild_candidates"))


@check("g5_severe_count", f"SELECT {_DAY}, count(*) FILTER (WHERE severe) AS severe_candidates, count(*) AS interactions "
       "FROM wk GROUP BY 1", ("wk",))
def _(v):
    return by_week(metrics.weekly_counts(detailed(v), ["monday"]).select(
        "monday", "severe_candidates", "interactions"))


@check("g6_tier1_count", f"SELECT {O.week_key('activity_date')} AS week_key, severity_level, count(*) AS escalated "
       "FROM cand GROUP BY 1, 2", ("cand",))
def _(v):
    return jobs.escalations(v.screened, STAFF)


@check("g7_activity_counts", """SELECT community_name, count(*) FILTER (WHERE activity_type = 'Original Post') AS posts,
  count(*) FILTER (WHERE activity_type = 'Comment') AS comments, count(*) AS total FROM interactions GROUP BY 1""",
       ("interactions",))
def _(v):
    return metrics.activity_counts(v.interactions, ["community_name"])


def benchmark(v: Views):
    rows = v.screened
    items = rows.join(v.truth, "interaction_id").select(
        "interaction_id", "category", "expected_scam", "heuristic_score", "matched_terms")
    flagged = fraud.flags(fraud.cascade(rows, v.verdicts, v.accounts, staff=STAFF))
    return evaluation.benchmark_rows(items, flagged, "interaction_id")


BENCH = """bench AS (SELECT s.interaction_id, t.category, t.expected_scam AS y, s.heuristic_score >= 10 OR s.short AS p,
  coalesce(r.disposition = 'flag', false) AS c FROM scan s JOIN truth t USING (interaction_id) LEFT JOIN routed r
  USING (interaction_id))"""


def _metrics_sql(pred: str) -> str:
    def rate(top, bottom):
        return f"CASE WHEN {bottom} = 0 THEN 0 ELSE ({top}) / ({bottom})::DOUBLE END"
    rates = {
        "precision": rate("tp", "(tp + fp)"), "recall": rate("tp", "(tp + fn)"),
        "specificity": rate("tn", "(tn + fp)"), "accuracy": rate("tp + tn", "total"),
        "false_positive_rate": rate("fp", "(tn + fp)"),
    }
    cols = ", ".join(f"round({e}, 6) AS {n}, round(100 * {e}, 1) AS {n}_pct" for n, e in rates.items())
    return f"""SELECT total, tp + fn AS scam_examples, tn + fp AS legit_examples, tp, fp, tn, fn, {cols} FROM (SELECT
  count(*) AS total, count(*) FILTER (WHERE y AND {pred}) AS tp, count(*) FILTER (WHERE NOT y AND {pred}) AS fp,
  count(*) FILTER (WHERE NOT y AND NOT {pred}) AS tn, count(*) FILTER (WHERE y AND NOT {pred}) AS fn FROM bench)"""


def _rounded(df):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


@check("g8_binary_metrics", f"WITH {BENCH} " + _metrics_sql("p"), ("scan", "truth", "routed"))
def _(v):
    return _rounded(metrics.binary_metrics(benchmark(v), "expected_scam", "tier1_flag"))


_CATEGORY = f"""WITH {BENCH} SELECT category, count(*) AS examples, count(*) FILTER (WHERE y) AS scams, count(*) FILTER
  (WHERE NOT y) AS legit, count(*) FILTER (WHERE y AND p) AS tier1_hits, count(*) FILTER (WHERE NOT y AND p) AS tier1_fp,
  count(*) FILTER (WHERE y AND c) AS cascade_hits, count(*) FILTER (WHERE NOT y AND c) AS cascade_fp
  FROM bench GROUP BY 1"""


@check("g9_category_summary", _CATEGORY, ("scan", "truth", "routed"))
def _(v):
    return metrics.category_summary(benchmark(v))


_R3 = "CASE WHEN {b} = 0 THEN 0 ELSE round({t} / ({b})::DOUBLE, 3) END"
REPORT = f"""report AS (SELECT label, concat(upper(label[1]), label[2:]) AS emotion, threshold, tp + fn AS support, tp + fp
  AS predicted, {_R3.format(t='tp', b='(tp + fp)')} AS precision, {_R3.format(t='tp', b='(tp + fn)')} AS recall,
  {_R3.format(t='2 * tp', b='(2 * tp + fp + fn)')} AS f1 FROM conf)"""


@check("g10_label_report", f"WITH {REPORT} SELECT emotion, threshold, support, predicted, precision, recall, f1 FROM report",
       ("conf",))
def _(v):
    return metrics.label_report(metrics.label_confusion(pairs(v)))


AGREEMENT = """tot AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
  CAST(sum(tn) AS BIGINT) AS tn FROM conf),
m AS (SELECT *, tp + fp + fn + tn AS n, (2.0::DOUBLE * tp / (2 * tp + fp + fn) + 2.0::DOUBLE * tn / (2 * tn + fp + fn)) / 2
  AS f, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS po, ((tp + fn) / (tp + fp + fn + tn)::DOUBLE) * ((tp + fp) /
  (tp + fp + fn + tn)::DOUBLE) + ((tn + fp) / (tp + fp + fn + tn)::DOUBLE) * ((tn + fn) / (tp + fp + fn + tn)::DOUBLE) AS pe
  FROM tot)"""


@check("g11_global_agreement", f"""WITH {AGREEMENT} SELECT tp, fp, fn, tn, n AS decisions, round(f, 6) AS macro_f1,
  round((po - pe) / (1 - pe), 6) AS kappa, round(1.96 * sqrt(f * (1 - f) / n), 6) AS ci_margin FROM m""", ("conf",))
def _(v):
    return _rounded(metrics.global_agreement(metrics.label_confusion(pairs(v))))


@check("g12_watchlist_f1", f"WITH {REPORT} SELECT round(avg(f1), 3) AS watchlist_macro_f1 FROM report WHERE label IN ("
       + ", ".join(map(O.q, L.WATCHLIST)) + ")", ("conf",))
def _(v):
    return metrics.watchlist_f1(metrics.label_report(metrics.label_confusion(pairs(v))))


@check("g13_support_triage", f"""WITH t AS (SELECT d.severe AS s, CASE WHEN NOT starts_with(v.sanity_raw, 'ERROR:') THEN
  {O.boolean_verdict('v.sanity_raw')} END AS y FROM detail d JOIN pairs p USING (interaction_id) LEFT JOIN verdicts v USING
  (interaction_id)), c AS (SELECT count(*) FILTER (WHERE y AND s) AS tp, count(*) FILTER (WHERE NOT y AND s) AS fp, count(*)
  FILTER (WHERE y AND NOT s) AS fn, count(*) FILTER (WHERE NOT y AND NOT s) AS tn FROM t WHERE y IS NOT NULL)
SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round(fp / greatest(tn + fp, 1)::DOUBLE, 6) AS benign_fp_rate FROM c""",
       ("detail", "pairs", "verdicts"))
def _(v):
    decided = evaluation.triage_pairs(pairs(v, distress.with_text_signals), v.verdicts)
    return _rounded(metrics.triage_metrics(decided, "teacher_support", "student_support"))


@check("g14_value_counts", "SELECT source AS community_name, lang, count(*) AS rows FROM documents GROUP BY 1, 2")
def _(v):
    rows = v.table("documents").withColumnRenamed("source", "community_name")
    return metrics.value_counts(rows, "lang", ["community_name"])


@check("g14_label_positives", " UNION ALL ".join(
    f"SELECT {O.q(x)} AS label, count(*) FILTER (WHERE {x} >= 0.5::DOUBLE) AS rows FROM scores" for x in L.RARE_SUPPLEMENT),
       ("scores",))
def _(v):
    marks = v.scores.select(*[F.when(F.col(x) >= 0.5, 1).otherwise(0).alias(x) for x in L.RARE_SUPPLEMENT])
    return metrics.label_positives(marks, L.RARE_SUPPLEMENT)


@check("g15_reason_histogram", """SELECT flag AS reason_flag, count(*) AS rows FROM (SELECT unnest(string_split(flags, '|'))
  AS flag FROM severe) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""", ("severe",))
def _(v):
    return metrics.reason_histogram(distress.severe_candidates(severe_rows(v), STAFF))


@check("g16_entropy_quantile", f"SELECT round(quantile_cont({O.entropy()}, 0.75), 6) AS quantile FROM scores", ("scores",))
def _(v):
    from hearthlight.functions import scores as S
    rows = v.scores.select(S.entropy().alias("entropy"))
    out = metrics.exact_quantile(rows, "entropy", 0.75, 0.0, sampling.MAX_ENTROPY + 1e-6)
    return out.select(F.round("quantile", 6).alias("quantile"))


MISSES = f"""passed AS (SELECT * FROM interactions WHERE interaction_id NOT IN (SELECT interaction_id FROM routed WHERE
  disposition = 'flag')), drawn AS (SELECT * FROM passed ORDER BY {O.draw('interaction_id')}, interaction_id LIMIT {{n}}),
audited AS (SELECT d.interaction_id, d.commenter_name, coalesce(trim(d.content) <> '' AND NOT starts_with(v.scam_raw, 'ERROR:')
  AND CAST(json_extract_string(CASE WHEN contains(v.scam_raw, '{{{{') THEN {O.json_body('v.scam_raw').replace('{', '{{').replace('}', '}}')}
  END, '$.is_scam') AS BOOLEAN) AND CAST(json_extract_string(CASE WHEN contains(v.scam_raw, '{{{{') THEN
  {O.json_body('v.scam_raw').replace('{', '{{').replace('}', '}}')} END, '$.confidence') AS DOUBLE) >= 0.8::DOUBLE, false) AS missed
  FROM drawn d LEFT JOIN verdicts v USING (interaction_id))"""


def misses_sql(n: int) -> str:
    return MISSES.replace("{n}", str(n)).replace("{{", "{").replace("}}", "}").replace("{{", "{").replace("}}", "}")


def flagged_ids(v):
    return cut_lineage(fraud.flags(routed(v)).select("interaction_id"))


def audited(v, n: int, flagged=None):
    sample = evaluation.miss_sample(v.interactions, flagged_ids(v) if flagged is None else flagged, n)
    return evaluation.missed_scams(sample, v.verdicts)


@check("g17_miss_rate", f"""WITH {misses_sql(500)} SELECT count(*) AS sample_size, count(*) FILTER (WHERE missed) AS
  false_negatives_detected, round(100 * count(*) FILTER (WHERE missed) / greatest(count(*), 1)::DOUBLE, 2) AS
  false_negative_rate, (SELECT count(*) FROM passed) AS passed_total, NOT EXISTS (SELECT * FROM drawn JOIN verdicts USING
  (interaction_id) WHERE trim(content) <> '' AND starts_with(scam_raw, 'ERROR:')) AS reviewer_available FROM audited""",
       ("routed", "verdicts"))
def _(v):
    flagged = flagged_ids(v)
    passed = v.parted.rows.select("interaction_id").join(flagged, "interaction_id", "left_anti")
    return evaluation.miss_stats(audited(v, 500, flagged), passed.agg(F.count(F.lit(1))).scalar())


@check("g18_feedback_precision", """SELECT confirmed, false_positives, needs_review, round(confirmed / greatest(confirmed +
  false_positives, 1)::DOUBLE, 6) AS precision FROM (SELECT count(*) FILTER (WHERE verdict = 'CONFIRMED_SCAM') AS confirmed,
  count(*) FILTER (WHERE verdict = 'FALSE_POSITIVE') AS false_positives, count(*) FILTER (WHERE verdict =
  'NEEDS_HUMAN_REVIEW') AS needs_review FROM feedback)""", ("feedback",))
def _(v):
    return _rounded(metrics.feedback_precision(v.feedback))


SET_METRICS = f"""WITH {MEMBERS}, c AS (SELECT count(*) FILTER (WHERE in_truth) AS truth_count, count(*) FILTER (WHERE
  in_tier1) AS tier1_count, count(*) FILTER (WHERE in_confirmed) AS verified_count, count(*) FILTER (WHERE in_truth AND
  in_confirmed) AS tp, count(*) FILTER (WHERE in_confirmed AND NOT in_truth) AS fp, count(*) FILTER (WHERE in_truth AND NOT
  in_confirmed) AS fn, count(*) FILTER (WHERE in_truth AND NOT in_tier1) AS tier1_missed FROM members),
d AS (SELECT *, tp / greatest(verified_count, 1)::DOUBLE AS p, tp / greatest(truth_count, 1)::DOUBLE AS r FROM c)
SELECT truth_count, tier1_count, verified_count, tp, fp, fn, tier1_missed, round(p, 4) AS precision, round(r, 4) AS recall,
  round(2 * p * r / greatest(p + r, 1e-9), 4) AS f1 FROM d"""


@check("g19_set_metrics", SET_METRICS, ("truth", "vsource"))
def _(v):
    return evaluation.set_metrics(members(v))


_ADDED = f"""WITH {BATCH}, fresh AS (SELECT DISTINCT text_hash FROM batch WHERE text_hash NOT IN (SELECT
  text_hash FROM master)) SELECT (SELECT count(*) FROM fresh) AS added_rows, (SELECT count(*) FROM fresh) + (SELECT
  count(DISTINCT text_hash) FROM master) AS total_rows, (SELECT count(*) FROM fresh) AS new_key_count"""


@check("g20_append_stats", _ADDED, ("interactions", "master"))
def _(v):
    return training.append_stats(batch_rows(v), master_rows(v))


@check("g20_committed_stats", _ADDED, ("interactions", "master"))
def _(v):
    done = stored_master(v).append(batch_rows(v), "week", ["row_no"])
    return v.spark.createDataFrame(
        [(done.added_rows, done.total_rows, done.added_rows)], "added_rows bigint, total_rows bigint, new_key_count bigint")


SUMMARY = f"""WITH counts AS (SELECT monday, count(*) AS interactions, count(*) FILTER (WHERE mild) AS mild_candidates,
  count(*) FILTER (WHERE top_score > 0 AND list_contains([{', '.join(map(O.q, L.NEGATIVE))}], top_label)) AS negative_dominant
  FROM wk GROUP BY 1), fraud AS (SELECT {O.monday('activity_date')} AS monday, count(*) AS fraud_flags FROM routed WHERE
  disposition = 'flag' GROUP BY 1), sv AS (SELECT {O.monday('activity_date')} AS monday, count(*) AS severe_verified FROM vsource
  WHERE source = 'gemini_true' GROUP BY 1), long AS (""" + " UNION ALL ".join(
    f"SELECT monday, {O.q(x)} AS label, {x} AS mean FROM prof" for x in L.NEGATIVE) + f"""), tops AS (SELECT monday,
  string_agg(concat(label, ' ', CAST(round(mean * 100, 1) AS VARCHAR), '%'), ', ' ORDER BY mean DESC, label) AS top_concerns FROM
  (SELECT *, row_number() OVER (PARTITION BY monday ORDER BY mean DESC, label) AS rn FROM long WHERE mean > 0.01) WHERE rn <= 3
  GROUP BY 1)
SELECT {O.week_key('h.monday')} AS week_key, h.health AS health_score, p.health AS previous_score, round(h.health - p.health, 2)
  AS delta, coalesce(c.interactions, 0) AS interactions, coalesce(f.fraud_flags, 0) AS fraud_flags, t.top_concerns,
  coalesce(sv.severe_verified, 0) AS severe_verified, coalesce(c.mild_candidates, 0) AS mild_candidates,
  coalesce(c.negative_dominant, 0) AS negative_dominant FROM health h LEFT JOIN health p ON p.monday + 7 = h.monday LEFT JOIN
  counts c ON c.monday = h.monday LEFT JOIN fraud f ON f.monday = h.monday LEFT JOIN sv ON sv.monday = h.monday LEFT JOIN tops t
  ON t.monday = h.monday"""


@check("g21_weekly_summary", SUMMARY, ("wk", "routed", "vsource", "health"))
def _(v):
    rows = detailed(v)
    dates = v.table("events").select(F.col("event_id").alias("interaction_id"),
                                     W.monday_of("ts").alias("monday"))

    def count(df, name):
        return df.select("interaction_id").join(dates, "interaction_id").groupBy("monday").agg(
            F.count(F.lit(1)).alias(name))
    profile = cut_lineage(metrics.mean_profile(weekly(v), ["monday"]))
    return trends.weekly_summary(
        profile, metrics.profile_health(profile, ["monday"]),
        metrics.weekly_counts(rows, ["monday"]), count(fraud.flags(routed(v)), "fraud_flags"),
        count(distress.verified(verified_rows(v), True), "severe_verified"))


@check("g22_emotion_trend", EMOTION_TREND + """SELECT concat('Week ', weekofyear(s.monday)) AS week, label,
  round(coalesce(mean, 0) * 100, 1) AS percent FROM (SELECT * FROM span CROSS JOIN lead6) s LEFT JOIN long USING (monday, label)""",
       ("prof",))
def _(v):
    out = trends.emotion_trend(metrics.mean_profile(weekly(v), ["monday"]), W.week_span(v.spark, 2024, 5, 4),
                               dt.date(2024, 1, 29))
    return out.drop("monday")


@check("g23_profile_table", "WITH m AS " + _MEANS + ", top AS (SELECT greatest(0.12, 1.25 * "
       + O.greatest([x for x in L.LABELS if x != "neutral"]) + ") AS s FROM m) " + " UNION ALL ".join(
    f"SELECT {O.q(x)} AS label, {O.q('neutral' if x == 'neutral' else 'negative' if x in L.NEGATIVE else 'positive')} AS "
    f"label_group, round({x}, 6) AS mean, round(s, 6) AS scale_max FROM m, top" for x in L.LABELS), ("scores",))
def _(v):
    return _rounded(trends.profile_table(metrics.mean_profile(v.scores)))


@check("g24_severity_counts", "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE priority = {i + 1}) AS {n}" for i, n in enumerate(("critical", "high", "medium", "low")))
       + " FROM reviewed", ("reviewed",))
def _(v):
    return metrics.severity_counts(reviewed(v))


@check("g25_action_histogram", "SELECT action AS recommended_action, gate AS tier3_verdict, count(*) AS rows FROM routed "
       "WHERE status = 'OK' GROUP BY 1, 2", ("routed",))
def _(v):
    return metrics.value_counts(routed(v).filter("llm_status = 'OK'"), "tier3_verdict", ["recommended_action"])


@check("g26_miss_history", f"""SELECT concat('W', week, '/', year) AS label, year, week, round(value, 4) AS false_negative_rate,
  false_negatives_detected, sample_size, scam_flags FROM (SELECT isoyear(ts) AS year, weekofyear(ts) AS week, value, event_id % 5
  AS false_negatives_detected, 50 AS sample_size, user_id AS scam_flags, row_number() OVER (PARTITION BY isoyear(ts),
  weekofyear(ts) ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1""")
def _(v):
    log = v.table("events").select(
        W.iso_year("ts").alias("year"), W.iso_week("ts").alias("week"), F.col("value").alias("false_negative_rate"),
        (F.col("event_id") % 5).alias("false_negatives_detected"), F.lit(50).alias("sample_size"),
        F.col("user_id").alias("scam_flags"), F.col("ts").alias("updated_at"))
    out = trends.miss_rate_history(log)
    return out.select("label", F.col("year").cast("bigint"), F.col("week").cast("bigint"),
                      F.round("false_negative_rate", 4).alias("false_negative_rate"), "false_negatives_detected",
                      F.col("sample_size"), "scam_flags")
