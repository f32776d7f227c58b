"""Queries over sources, sinks and text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import oracle as O
from checks.registry import check
from checks.views import STAFF_DOMAIN, Views
from hearthlight import labels as L
from hearthlight import rules as R
from hearthlight.functions import matching as M
from hearthlight.functions import text as T
from hearthlight.functions import verdicts as V
from hearthlight.functions import weeks as W
from hearthlight.operators import distress, fraud, training, trends
from hearthlight.session import new_folder
from hearthlight.sources import interactions as ingest
from hearthlight.sources import prompts, sinks, tables
from hearthlight.sources.weekstore import WeekStore

STAFF = fraud.StaffPolicy(domains=(STAFF_DOMAIN,))


def piped(name: str):
    return F.array_join(name, "|").alias(name)


def micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def answered(v: Views) -> DataFrame:
    return v.verdicts


# --- sources ----------------------------------------------------------------------------------

_WINDOW = """
posts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('week', forum_created_at),
      forum_title, forum_content ORDER BY forum_created_at, interaction_id) AS rn
    FROM forum WHERE forum_content IS NOT NULL AND forum_created_at >= TIMESTAMP '{a}'
      AND forum_created_at < TIMESTAMP '{b}') WHERE rn = 1),
comments AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('week', discussion_created_at),
      discussion_id ORDER BY discussion_created_at DESC, interaction_id DESC) AS rn
    FROM forum WHERE discussion_id IS NOT NULL AND trim(discussion_content) <> ''
      AND discussion_created_at >= TIMESTAMP '{a}' AND discussion_created_at < TIMESTAMP '{b}')
  WHERE rn = 1),
both_kinds AS (
  SELECT interaction_id * 2 AS interaction_id, 'Original Post' AS activity_type,
    forum_created_at AS activity_date,
    concat(coalesce(forum_title, ''), ' - ', coalesce(forum_content, '')) AS content,
    community_name, commenter_name, commenter_email FROM posts
  UNION ALL
  SELECT interaction_id * 2 + 1, 'Comment', discussion_created_at, discussion_content,
    community_name, commenter_name, commenter_email FROM comments)
"""


@check("a1_weekly_interactions", "WITH " + _WINDOW.format(a="2024-01-15", b="2024-01-22") + f"""
SELECT interaction_id, activity_type, epoch_us(activity_date) AS activity_us,
  {O.clean('content')} AS content, community_name, commenter_name, commenter_email
FROM both_kinds""", ("forum",))
def _(v):
    return ingest.weekly_interactions(v.forum, 2024, 3, v.forum_of).withColumn(
        "activity_us", micros("activity_date")).drop("activity_date")


@check("a2_rolling_window", "WITH " + _WINDOW.format(a="2024-01-08", b="2024-02-05") + f"""
SELECT interaction_id, {O.clean('content')} AS content,
  {O.week_label('activity_date')} AS scam_scan_week,
  CAST(date_diff('day', date_trunc('week', activity_date), DATE '2024-01-29') / 7 AS BIGINT)
    AS scam_scan_offset FROM both_kinds""", ("forum",))
def _(v):
    return ingest.interaction_window(v.forum, 2024, 5, 4, v.forum_of).select(
        "interaction_id", "content", "scam_scan_week",
        F.col("scam_scan_offset").cast("bigint").alias("scam_scan_offset"))


@check("a3_training_history", "WITH " + _WINDOW.format(a="2023-11-13", b="2024-02-05") + f"""
SELECT {O.week_label('activity_date')} AS scam_scan_week, count(*) AS interactions,
  count(*) FILTER (WHERE activity_type = 'Comment') AS comments,
  CAST(sum(length({O.clean('content')})) AS BIGINT) AS chars FROM both_kinds GROUP BY 1""",
       ("forum",))
def _(v):
    return ingest.training_history(v.forum, 2024, 5, 12, v.forum_of).groupBy("scam_scan_week").agg(
        F.count(F.lit(1)).alias("interactions"),
        F.count_if(F.col("activity_type") == "Comment").alias("comments"),
        F.sum(F.length("content")).alias("chars"))


@check("a3_stored_history", "WITH " + _WINDOW.format(a="2023-11-13", b="2024-02-05") + f"""
SELECT interaction_id, {O.week_label('activity_date')} AS scam_scan_week, sha256({O.clean('content')}) AS content_sha,
  CAST(date_diff('day', date_trunc('week', activity_date), DATE '2024-01-29') / 7 AS BIGINT) AS scam_scan_offset
FROM both_kinds""", ("forum",))
def _(v):
    store, forum = WeekStore(v.spark, new_folder(v.spark, "weeks")), v.forum
    store.refresh(forum.filter("interaction_id % 3 = 0"), 2024, 4, 6, v.forum_of)  # rows that came early
    store.refresh(forum, 2024, 4, 6, v.forum_of)
    store.catch_up(forum, 2024, 5, 12, v.forum_of)
    return store.history(2024, 5, 12).select(
        "interaction_id", "scam_scan_week", F.sha2("content", 256).alias("content_sha"),
        F.col("scam_scan_offset").cast("bigint").alias("scam_scan_offset"))


def corpus_frame(v: Views) -> DataFrame:
    return v.interactions.select("interaction_id", "content").join(v.truth, "interaction_id").select(
        F.concat(F.lit("item_"), F.col("interaction_id").cast("string")).alias("id"),
        F.when(F.col("expected_scam"), "scam").otherwise("legit").alias("label"), "category",
        F.col("content").alias("text"), F.lit("view").alias("source_name"),
        F.lit("").alias("source_url"))


@check("a4_benchmark_corpus", """
SELECT concat('item_', interaction_id) AS id, CASE WHEN expected_scam THEN 'scam' ELSE 'legit' END
  AS label, expected_scam, category, sha256(content) AS text_sha, 'view' AS source_name
FROM interactions JOIN truth USING (interaction_id)""", ("interactions", "truth"))
def _(v):
    path = new_folder(v.spark, "corpus")
    corpus_frame(v).write.json(path)
    items = tables.corpus_items(tables.read_corpus(v.spark, path, json_lines=True))
    return items.select("id", "label", "expected_scam", "category",
                        F.sha2("text", 256).alias("text_sha"), "source_name")


@check("a4_numbered_lines", """SELECT concat('item_', interaction_id) AS id, row_number() OVER (ORDER BY interaction_id) - 1
  AS row_index FROM interactions JOIN truth USING (interaction_id) WHERE interaction_id % 10 <> 3""", ("interactions", "truth"))
def _(v):
    path = new_folder(v.spark, "corpus")
    rows = corpus_frame(v).withColumn("n", F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")).filter("n % 10 <> 3")
    rows.orderBy("n").drop("n").write.json(path)
    return tables.read_corpus(v.spark, path, json_lines=True).select("id", "row_index")


_THRESHOLDS = (
    "concat('{\"sadness\": 0.', lpad(CAST(event_id % 100 AS VARCHAR(20)), 2, '0'), "
    "', \"anger\": \"bad\", \"bogus\": 0.5, \"fear\": 1.5, \"joy\": -', "
    "CAST(event_id % 7 AS VARCHAR(20)), '}')"
)


@check("a5_threshold_map", "WITH maps AS (SELECT " + _THRESHOLDS + """ AS m FROM events),
long AS (""" + " UNION ALL ".join(
    f"SELECT {O.q(x)} AS label, round(least(greatest(coalesce(TRY_CAST(json_extract_string(m, "
    f"'$.{x}') AS DOUBLE), {L.DEFAULT_THRESHOLDS[x]}), 0.01), 0.95), 2) AS threshold FROM maps"
    for x in L.LABELS) + """)
SELECT label, threshold, count(*) AS maps FROM long GROUP BY 1, 2""")
def _(v):
    raw = v.table("events").selectExpr(_THRESHOLDS + " AS thresholds_json")
    return tables.threshold_table(raw).groupBy("label", "threshold").agg(
        F.count(F.lit(1)).alias("maps"))


@check("a6_master_read", f"""SELECT row_no, {O.text_hash('text')} AS text_hash FROM external""",
       ("external",))
def _(v):
    path = new_folder(v.spark, "master")
    sinks.write_csv(v.external.select("row_no", "text"), path)
    return tables.read_master(v.spark, path, "row_no bigint, text string").select(
        "row_no", "text_hash")


def indexed_rows(v: Views) -> DataFrame:
    labels = F.when(F.col("has_labels"), F.array("label_a", "label_b"))
    return v.external.withColumn("labels", labels)


_EXACT = f"""
kept AS (SELECT *, {O.clean(O.clean('text'))} AS c FROM wide WHERE {O.plus(L.LABELS)} > 0),
hashed AS (SELECT *, {O.text_hash('c')} AS h FROM kept WHERE length(c) >= 12),
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY row_no) AS rn
  FROM hashed) WHERE rn = 1)
"""
_NAMES = "concat_ws(', ', " + ", ".join(f"CASE WHEN {x} > 0 THEN {O.q(x)} END" for x in L.LABELS) + ")"
_INDEXED = "WITH wide AS (SELECT row_no, text, " + ", ".join(
    f"CAST(has_labels AND (label_a = {i} OR label_b = {i}) AS INT) AS {x}"
    for i, x in enumerate(L.LABELS)) + " FROM external), "
EXACT_OUT = ("row_no", "text_hash", "labels", "sampler_bucket", "sample_weight")


@check("a7_external_exact_indexed", _INDEXED + _EXACT + f"""
SELECT row_no, h AS text_hash, {_NAMES} AS labels, 'external_exact' AS sampler_bucket,
  1.0::DOUBLE AS sample_weight FROM final""", ("external",))
def _(v):
    return training.exact_indexed(indexed_rows(v), L.LABELS).select(*EXACT_OUT)


@check("a7_external_exact_wide", "WITH wide AS (SELECT i.interaction_id AS row_no, content AS text, "
       + ", ".join(f"CAST({x} >= 0.9::DOUBLE AS INT) AS {x}" for x in L.LABELS)
       + " FROM interactions i JOIN scores s USING (interaction_id)), " + _EXACT + f"""
SELECT row_no, h AS text_hash, {_NAMES} AS labels, 'external_exact' AS sampler_bucket,
  1.0::DOUBLE AS sample_weight FROM final""", ("interactions", "scores"))
def _(v):
    rows = v.parted.judged(training.external_hash).join(v.scores, "interaction_id").select(
        F.col("interaction_id").alias("row_no"), "text_hash",
        *[(F.col(x) >= 0.9).cast("int").alias(x) for x in L.LABELS])
    return training.exact_wide(rows).select(*EXACT_OUT)


def _mapped_sql(mapping) -> str:
    cols = []
    for e in L.LABELS:
        cases = " ".join(f"WHEN {O.q(k)} THEN {w[e]}" for k, w in mapping.items() if e in w)
        cols.append(f"CAST({f'CASE lab {cases} ELSE 0 END' if cases else '0'} AS DOUBLE) AS {e}")
    return ", ".join(cols)


_DIALOGUE_NAMES = "CASE emotion_no " + " ".join(
    f"WHEN {i} THEN {O.q(' ' + n.title())}" for i, n in enumerate(R.DIALOGUE_LABEL_MAP)
) + " ELSE 'unknown' END"
_MAPPED_WEIGHTS = O.plus(f"{x} * {i + 1}" for i, x in enumerate(L.LABELS))


def _weights_checksum():
    total = F.lit(0.0)
    for i, x in enumerate(L.LABELS):
        total = total + F.col(x) * (i + 1)
    return F.round(total, 6).alias("weights")


def dialogue_rows(v: Views) -> DataFrame:
    return v.external.select("row_no", F.col("text").alias("context"),
                             F.expr(_DIALOGUE_NAMES).alias("emotion"))


def report_rows(v: Views) -> DataFrame:
    return v.external.select("row_no", F.col("text").alias("SIT"),
                             F.col("label_code").alias("EMOT"))


_MAPPED_OUT = f"""SELECT row_no, h AS text_hash, lab AS external_label, {_NAMES} AS labels,
  sample_weight, mapping_confidence, round({_MAPPED_WEIGHTS}, 6) AS weights FROM final"""


@check("a8_external_mapped_dialogues", f"""WITH named AS (SELECT row_no, text,
  lower(trim({_DIALOGUE_NAMES})) AS lab, 0.7::DOUBLE AS sample_weight, 'medium' AS mapping_confidence
  FROM external), wide AS (SELECT *, {_mapped_sql(R.DIALOGUE_LABEL_MAP)} FROM named
  WHERE lab <> 'unknown'), """ + _EXACT + _MAPPED_OUT, ("external",))
def _(v):
    return training.mapped_dialogues(dialogue_rows(v)).select(
        "row_no", "text_hash", "external_label", "labels", "sample_weight", "mapping_confidence",
        _weights_checksum())


_CODES = "CASE label_code " + " ".join(
    f"WHEN {k} THEN {O.q(n)}" for k, n in R.REPORT_LABEL_CODES.items()) + " END"
REPORT_NAMED = f"""named AS (SELECT row_no, text, {_CODES} AS lab FROM external),
  weighted AS (SELECT *, CASE WHEN lab IN ('shame', 'guilt') THEN 0.7::DOUBLE ELSE 0.85::DOUBLE END
    AS sample_weight, CASE WHEN lab IN ('shame', 'guilt') THEN 'medium' ELSE 'high' END
    AS mapping_confidence FROM named WHERE lab IS NOT NULL),
  wide AS (SELECT *, {_mapped_sql(R.REPORT_LABEL_MAP)} FROM weighted), """


@check("a8_external_mapped_reports", "WITH " + REPORT_NAMED + _EXACT + _MAPPED_OUT, ("external",))
def _(v):
    return training.mapped_reports(report_rows(v)).select(
        "row_no", "text_hash", "external_label", "labels", "sample_weight", "mapping_confidence",
        _weights_checksum())


def counsel_rows(v: Views) -> DataFrame:
    turn = v.table("conversations")
    return turn.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_no"),
        F.when(F.col("role") == "user", F.col("text")).alias("questionText"),
        F.when(F.col("role") != "user", F.col("text")).alias("answerText"))


COUNSEL = f"""long AS (
  SELECT conv_id * 1000 + turn AS row_no, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS column_no,
    {O.clean('text')} AS text FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL),
hashed AS (SELECT *, {O.text_hash('text')} AS text_hash FROM long WHERE length(text) >= 20),
counsel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_hash
  ORDER BY column_no, row_no) AS rn FROM hashed) WHERE rn = 1)"""


@check("a9_unlabeled_candidates", f"WITH {COUNSEL} SELECT row_no, text_hash, text, "
       "0.5::DOUBLE AS sample_weight FROM counsel")
def _(v):
    return training.unlabeled_candidates(counsel_rows(v)).select(
        "row_no", "text_hash", "text", "sample_weight")


@check("a10_verdict_table", """SELECT i.interaction_id, coalesce(v.scam_raw, 'ERROR: Timeout') AS
  scam_raw FROM events e JOIN (SELECT event_id AS interaction_id FROM events) i ON
  e.event_id = i.interaction_id LEFT JOIN verdicts v USING (interaction_id)""", ("verdicts",))
def _(v):
    rows = v.table("events").select(F.col("event_id").alias("interaction_id"))
    return fraud.with_verdicts(rows, v.verdicts)


def severe_rows(v: Views) -> DataFrame:
    joined = v.signalled.join(v.scores, "interaction_id")
    return distress.mild_details(distress.severe_details(joined))


_CONTEXT_LINE = (
    "concat('dominant_emotion=', emotion, '; dominant_score=', CAST(score100 AS VARCHAR), "
    "'%; cumulative_negative_load=', CAST(total_negative AS VARCHAR), "
    "' pts; avg_negative_intensity=', CAST(avg100 AS VARCHAR), '%; reason_flags=', "
    "CASE WHEN flags = '' THEN 'none' ELSE replace(flags, '|', ', ') END, '; rare_hints=', "
    "CASE WHEN hints = '' THEN 'none' ELSE replace(hints, '|', ', ') END, "
    "'; support_need_hits=', CAST(n_hits AS VARCHAR))"
)


@check("a11_need_prompts", f"""SELECT interaction_id, {_CONTEXT_LINE} AS model_context,
  sha256(concat({O.q(prompts.NEED_PROMPT)}, '"', content, '"',
  {O.q(chr(10) * 2 + 'Model signals (advisory, do not rely on them alone):' + chr(10))},
  {_CONTEXT_LINE})) AS prompt_sha FROM severe""", ("severe",))
def _(v):
    rows = v.parted.with_texts(distress.severe_candidates(severe_rows(v), STAFF), "comment")
    return prompts.need_prompts(rows).select(
        "interaction_id", "model_context", F.sha2("prompt", 256).alias("prompt_sha"))


@check("a11_scam_prompts", f"""SELECT interaction_id, sha256(concat({O.q(prompts.SCAM_PROMPT)}, '"',
  content, '"')) AS prompt_sha FROM cand""", ("cand",))
def _(v):
    path = new_folder(v.spark, "prompts")
    prompts.write_prompts(prompts.scam_prompts(
        v.parted.with_texts(fraud.candidates(v.screened, STAFF), "comment")), path)
    return v.spark.read.parquet(path).select(
        "interaction_id", F.sha2("prompt", 256).alias("prompt_sha"))


@check("a12_csv_sink", """SELECT interaction_id, member AS commenter_name,
  CAST(heuristic_score AS BIGINT) AS heuristic_score, replace(matched_terms, '|', ', ') AS
  matched_terms, severity_level FROM cand""", ("cand",))
def _(v):
    path = new_folder(v.spark, "csv")
    sinks.write_csv(fraud.candidates(v.screened, STAFF).select(
        "interaction_id", "commenter_name", "heuristic_score", "matched_terms",
        "severity_level"), path)
    return v.spark.read.csv(path, header=True, escape='"', emptyValue="", schema=(
        "interaction_id bigint, commenter_name string, heuristic_score bigint, "
        "matched_terms string, severity_level string")).fillna("", ["matched_terms"])


def snapshot_log(v: Views) -> DataFrame:
    return v.table("events").select(
        W.week_key("ts").alias("week_key"), (F.col("event_id") % 11).alias("severe_count"),
        (F.col("event_id") % 7).alias("scam_count"), F.col("user_id").alias("comment_count"),
        F.col("value").alias("score"), F.concat(F.lit("m"), "event_type").alias("model_id"),
        F.col("ts").cast("timestamp").alias("updated_at"), "event_type", "user_id")


SNAPSHOTS = f"""logged AS (SELECT {O.week_key('ts')} AS week_key, event_id % 11 AS severe_count,
  event_id % 7 AS scam_count, user_id AS comment_count, value AS score, concat('m', event_type) AS
  model_id, ts AS updated_at, CASE WHEN event_type = 'error' AND user_id % 5 = 0 THEN 1 ELSE 0 END
  AS in_session FROM events),
snaps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY week_key ORDER BY in_session DESC,
  updated_at DESC) AS rn FROM logged) WHERE rn = 1)"""


def snapshots(v: Views) -> DataFrame:
    log = snapshot_log(v)
    own = (F.col("event_type") == "error") & (F.col("user_id") % 5 == 0)
    keep = ("week_key", "severe_count", "scam_count", "comment_count", "score", "model_id",
            "updated_at")
    return trends.latest_snapshots(log.filter(~own).select(*keep), log.filter(own).select(*keep))


@check("a13_snapshot_upsert", f"""WITH {SNAPSHOTS} SELECT week_key, severe_count, scam_count,
  comment_count, round(score, 4) AS score, model_id, epoch_us(updated_at) AS updated_us FROM snaps""")
def _(v):
    path = new_folder(v.spark, "snapshots")
    sinks.append_snapshot(snapshots(v), path)
    return sinks.read_snapshots(v.spark, path).select(
        "week_key", "severe_count", "scam_count", "comment_count",
        F.round("score", 4).alias("score"), "model_id", micros("updated_at").alias("updated_us"))


@check("a14_report_sink", """SELECT CAST(isoyear(ts) AS BIGINT) AS year, CAST(weekofyear(ts) AS BIGINT)
  AS week, count(*) AS total_comments, count(*) FILTER (WHERE expected_scam) AS truth_count
  FROM events JOIN truth ON event_id = interaction_id GROUP BY 1, 2""", ("truth",))
def _(v):
    path = new_folder(v.spark, "reports")
    rows = v.table("events").withColumnRenamed("event_id", "interaction_id").join(
        v.truth, "interaction_id")
    sinks.write_report(rows.groupBy(
        W.iso_year("ts").alias("year"), W.iso_week("ts").alias("week")).agg(
        F.count(F.lit(1)).alias("total_comments"),
        F.count_if("expected_scam").alias("truth_count")), path)
    return v.spark.read.schema(
        "year bigint, week bigint, total_comments bigint, truth_count bigint").json(path)


def reviewed(v: Views) -> DataFrame:
    routed = fraud.cascade(v.screened, v.verdicts, v.accounts, staff=STAFF)
    return fraud.review_severity(fraud.flags(routed))


@check("a15_critical_alert", """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY community
  ORDER BY coalesce(conf, 0) DESC, heuristic_score DESC, interaction_id) AS rn, count(*) OVER (PARTITION
  BY community) AS n, array_to_string(string_split(inds, '|')[1:4], ', ') AS names
  FROM reviewed WHERE priority = 1)
SELECT community AS community_name, CAST(max(n) AS BIGINT) AS critical_flags,
  string_agg(concat(member, ' (', community, ') conf=', CASE WHEN conf IS NULL THEN 'N/A' ELSE
  printf('%.2f', conf) END, ' indicators: ', CASE WHEN names = '' THEN 'N/A' ELSE names END), chr(10)
  ORDER BY rn) AS lines, CAST(greatest(max(n) - 5, 0) AS BIGINT) AS overflow
FROM ranked WHERE rn <= 5 GROUP BY community""", ("reviewed",))
def _(v):
    out = sinks.critical_alert(reviewed(v), ["community_name"])
    return out.withColumn("overflow", F.col("overflow").cast("bigint"))


def _escaped(value: str) -> str:
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = f"replace({value}, {O.q(char)}, {O.q(ref)})"
    return value


@check("a15_severe_alert", f"""SELECT interaction_id, {_escaped('commenter_name')} AS commenter_name,
  emotion, sha256({_escaped('content')}) AS comment_sha, score100 AS score, total_negative
  FROM vsource WHERE keep""", ("vsource",))
def _(v):
    rows = v.parted.with_texts(distress.verified(distress.verify(
        distress.severe_candidates(severe_rows(v), STAFF), v.verdicts)), "comment")
    return sinks.severe_alert(rows).select(
        "interaction_id", "commenter_name", "emotion", F.sha2("comment", 256).alias("comment_sha"),
        "score", "total_negative")


@check("a16_benchmark_adapter", """SELECT interaction_id, sha256(content) AS content_sha,
  concat('benchmark-user-', interaction_id) AS commenter_name, concat('benchmark', interaction_id,
  '@example.com') AS commenter_email, category AS community_name
  FROM interactions JOIN truth USING (interaction_id)""", ("interactions", "truth"))
def _(v):
    items = v.interactions.join(v.truth, "interaction_id").select(
        "interaction_id", F.col("content").alias("text"), "category")
    return tables.corpus_interactions(items, "interaction_id").select(
        "interaction_id", F.sha2("content", 256).alias("content_sha"), "commenter_name",
        "commenter_email", "community_name")


# --- text columns -------------------------------------------------------------------------------

_TEXTS = """SELECT 'd' AS kind, doc_id AS id, text AS body FROM documents UNION ALL
  SELECT 'p', page_id, html FROM pages UNION ALL
  SELECT 'c', conv_id * 1000 + turn, text FROM conversations"""


def texts(v: Views) -> DataFrame:
    return v.table("documents").select(
        F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body")
    ).unionAll(v.table("pages").select(F.lit("p"), "page_id", "html")).unionAll(
        v.table("conversations").select(
            F.lit("c"), F.col("conv_id") * 1000 + F.col("turn"), "text"))


def _text_query(name: str, sql_expr: str, column, out: str = "value"):
    @check(name, f"SELECT kind, id, {sql_expr} AS {out} FROM ({_TEXTS})")
    def _(v):
        return texts(v).select("kind", "id", column(F.col("body")).alias(out))


_text_query("b1_clean_text", O.clean("body"), T.clean_text)
_text_query("b2_normalize_training_text", O.norm("body"), T.normalize_training_text)
_text_query("b3_text_hash", O.text_hash("body"), T.text_hash)
_text_query("b24_char_length", f"CAST(length({O.clean('body')}) AS BIGINT)",
            lambda c: F.length(T.clean_text(c)).cast("bigint"))
_text_query("b7_contact_email", f"coalesce(nullif(regexp_extract(body, {O.q(R.EMAIL)}, 0, 'i'), ''), 'N/A')",
            T.contact_email)
_text_query("b12_rare_hints", O._hints(O.norm("body"), R.RARE_HINTS),
            lambda c: F.array_join(distress.hint_labels(T.normalize_training_text(c)), "|"))
_text_query("b13_conflict_signal", O.any_match(f"lower({O.clean('body')})", R.CONFLICT),
            lambda c: distress.conflict_signal(T.clean_text(c)))
_text_query("b21_preview", "concat(left(body, 80), CASE WHEN length(body) > 80 THEN '...' ELSE '' END)",
            lambda c: T.preview(c, 80))
_text_query("b21_char_cap", "left(body, 2500)", T.cap_chars)
_text_query("b25_html_escape", _escaped("body"), T.escape_html)


@check("b4_viable_text", f"""WITH cleaned AS (SELECT kind, id, {O.clean('body')} AS c FROM ({_TEXTS}) UNION ALL
  SELECT 's', event_id, concat(event_type, CASE event_id % 4 WHEN 0 THEN ' help' WHEN 1 THEN ' 12' WHEN 2
  THEN '!' ELSE ' Thanks a lot' END) FROM events) SELECT kind, id, {O.viable('c')} AS viable FROM cleaned""")
def _(v):
    short = v.table("events").select(
        F.lit("s").alias("kind"), F.col("event_id").alias("id"),
        F.expr("concat(event_type, CASE event_id % 4 WHEN 0 THEN ' help' WHEN 1 THEN ' 12' "
               "WHEN 2 THEN '!' ELSE ' Thanks a lot' END)").alias("body"))
    return texts(v).unionAll(short).select(
        "kind", "id", T.clean_text("body").alias("c")).select(
        "kind", "id", T.is_viable_training_text("c").alias("viable"))


_RAW_ID = ("CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ' NaN ' WHEN 2 THEN '   ' WHEN 3 THEN 'null' "
           "WHEN 4 THEN concat('  ', event_type, ' ') ELSE event_type END")


@check("b5_normalize_identity", f"SELECT event_id, {O.identity(_RAW_ID, 'Unknown')} AS member FROM events")
def _(v):
    return v.table("events").select(
        "event_id", T.normalize_identity(F.expr(_RAW_ID), "Unknown").alias("member"))


@check("b6_staff", f"SELECT interaction_id, {O.staff()} AS staff FROM interactions", ("interactions",))
def _(v):
    return v.interactions.select("interaction_id", STAFF.matches().alias("staff"))


@check("b8_extract_json", f"""SELECT interaction_id, coalesce({O.json_body('scam_raw')}, scam_raw) AS body
  FROM answers""", ("answers",))
def _(v):
    return v.answers.select("interaction_id", V.extract_json("scam_raw").alias("body"))


@check("b9_boolean_verdict", f"SELECT interaction_id, {O.boolean_verdict('sanity_raw')} AS verdict FROM answers",
       ("answers",))
def _(v):
    return v.answers.select("interaction_id", V.boolean_verdict("sanity_raw").alias("verdict"))


_LINES = "concat('note', chr(10), '  ', replace(sanity_raw, '**', chr(10)), chr(10), 'end')"


@check("b10_line_verdict", f"""SELECT interaction_id, CASE upper(regexp_extract({_LINES},
  '(?im)^[ \\t]*verdict:[ \\t]*(true|false)', 1)) WHEN 'TRUE' THEN true WHEN 'FALSE' THEN false END AS verdict
  FROM answers""", ("answers",))
def _(v):
    return v.answers.select("interaction_id", V.line_verdict(F.expr(
        _LINES.replace("chr(10)", "char(10)"))).alias("verdict"))


@check("b11_support_hits", "SELECT interaction_id, hits, CAST(n_hits AS BIGINT) AS n_hits FROM sig",
       ("sig",))
def _(v):
    rows = v.interactions.select("interaction_id", T.normalize_training_text("content").alias("n"))
    hits = rows.select("interaction_id", distress.support_hits("n").alias("hits"))
    return hits.select("interaction_id", piped("hits"), F.size("hits").cast("bigint").alias("n_hits"))


@check("b14_term_hits", "SELECT interaction_id, words, CAST(kw AS BIGINT) AS keyword_hits, "
       "urgency, investment, smishing, aware FROM scan1", ("scan1",))
def _(v):
    rows = v.parted.judged(lambda t: M.with_hit_list(
        t.withColumn("low", F.lower(F.coalesce("content", F.lit("")))), "low", fraud.SCAN_TERMS, "h").drop("low"))
    h = F.col("h")
    return rows.select(
        "interaction_id",
        F.array_join(M.compact([F.when(M.in_hits(h, t), F.lit(t))
                                for t in dict.fromkeys(R.SCAM_KEYWORDS)]), "|").alias("words"),
        M.count_in_hits(h, R.SCAM_KEYWORDS).cast("bigint").alias("keyword_hits"),
        M.any_in_hits(h, R.URGENCY_TERMS).alias("urgency"),
        M.any_in_hits(h, R.INVESTMENT_TERMS).alias("investment"),
        M.any_in_hits(h, R.SMISHING_TERMS).alias("smishing"),
        M.any_in_hits(h, R.AWARENESS_TERMS).alias("aware"))


@check("b15_payment_terms", "SELECT interaction_id, concat_ws('|', " + ", ".join(
    O.flag(t, O.payment(t)) for t in R.PAYMENT_TERMS) + ") AS payment FROM scan0", ("scan0",))
def _(v):
    rows = v.interactions.withColumn("low", F.lower("content"))
    rows = rows.withColumn("h", M.hit_list(F.col("low"), R.PAYMENT_TERMS))
    return rows.select("interaction_id", F.array_join(M.compact([
        F.when(fraud.payment_term(t, F.col("low"), F.col("h")), F.lit(t))
        for t in R.PAYMENT_TERMS]), "|").alias("payment"))


@check("b16_contact_patterns", "SELECT interaction_id, mail, phone, url, short, act, promo, code, account "
       "FROM scan1", ("scan1",))
def _(v):
    raw, low = F.col("content"), F.lower("content")
    return v.interactions.select(
        "interaction_id", raw.rlike(M.pattern(R.EMAIL, True)).alias("mail"),
        raw.rlike(M.pattern(R.PHONE)).alias("phone"), raw.rlike(M.pattern(R.URL, True)).alias("url"),
        raw.rlike(M.pattern(R.SHORTLINK, True)).alias("short"),
        low.rlike(M.pattern(R.SMS_ACTION)).alias("act"), low.rlike(M.pattern(R.SMS_PROMO)).alias("promo"),
        low.rlike(M.pattern(R.SHORTCODE)).alias("code"),
        (low.rlike(M.pattern(R.ACCOUNT_PHRASE))
         & (F.regexp_count(low, F.lit(M.pattern(R.ACCOUNT_CONTEXT))) >= 2)).alias("account"))


@check("b17_week_bounds", """SELECT DISTINCT isoyear(o_orderdate) AS year, weekofyear(o_orderdate) AS week,
  strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday,
  strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d') AS sunday FROM orders""")
def _(v):
    weeks = v.table("orders").select(
        W.iso_year("o_orderdate").alias("year"), W.iso_week("o_orderdate").alias("week")).distinct()
    return weeks.select(
        F.col("year").cast("bigint"), F.col("week").cast("bigint"),
        W.week_monday("year", "week").cast("string").alias("monday"),
        W.week_sunday("year", "week").cast("string").alias("sunday"))


@check("b18_week_labels", f"""SELECT o_orderkey, {O.week_label('o_orderdate')} AS label,
  {O.week_key('o_orderdate')} AS week_key, CASE WHEN month(m) = month(m + 6) THEN concat(strftime(m, '%b '),
  day(m), '–', day(m + 6)) ELSE concat(strftime(m, '%b %d'), '–', strftime(m + 6, '%b %d')) END AS span
  FROM (SELECT *, {O.monday('o_orderdate')} AS m FROM orders)""")
def _(v):
    return v.table("orders").select(
        "o_orderkey", W.week_label("o_orderdate").alias("label"),
        W.week_key("o_orderdate").alias("week_key"),
        W.week_range_label(W.monday_of("o_orderdate")).alias("span"))


@check("b19_week_calendar", """WITH years AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders),
  days AS (SELECT y, unnest(generate_series(make_date(y, 1, 1) - 6, make_date(y, 12, 31), INTERVAL 1 DAY)) AS d
  FROM years)
SELECT y AS year, weekofyear(d) AS week, concat('Week ', weekofyear(d), ' (', strftime(d, '%b'), ')') AS choice
  FROM days WHERE isodow(d) = 1 AND isoyear(d) = y""")
def _(v):
    years = v.table("orders").select(F.year("o_orderdate").alias("y"))
    return W.week_calendar(years, "y").select(
        F.col("year").cast("bigint"), F.col("week").cast("bigint"), "choice")


@check("b20_week_text", """SELECT o_orderkey, CAST(weekofyear(o_orderdate) AS BIGINT) AS week FROM orders""")
def _(v):
    rows = v.table("orders").withColumn("w", W.iso_week("o_orderdate"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.col("w").cast("string")).otherwise(
        W.week_choice(W.monday_of("o_orderdate")))
    return rows.select("o_orderkey", W.parse_week(text).cast("bigint").alias("week"))


@check("b22_display_scaling", "SELECT interaction_id, concat(upper(dom[1]), dom[2:]) AS emotion, "
       "round(dom_score * 100, 1) AS score FROM sev0", ("sev0",))
def _(v):
    from hearthlight.functions import scores as S
    labels = (*L.SERIOUS, "confusion")
    return v.scores.select("interaction_id", T.title_case(S.dominant(labels)).alias("emotion"),
                           T.percent(S.peak(labels)).alias("score"))


@check("b23_text_chunks", r"""WITH w AS (SELECT doc_id, text, string_split(trim(regexp_replace(text, '\s+', ' ',
  'g')), ' ') AS ws FROM documents),
starts AS (SELECT doc_id, text, ws, unnest(CASE WHEN len(ws) <= 300 THEN [0] ELSE generate_series(0,
  len(ws) - 1, 250) END) AS s FROM w)
SELECT doc_id, CAST(s // 250 AS BIGINT) AS chunk_no, CASE WHEN len(ws) <= 300 THEN text ELSE
  array_to_string(ws[s + 1:s + 300], ' ') END AS chunk FROM starts""")
def _(v):
    return T.explode_chunks(v.table("documents").select("doc_id", "text"), "text").select(
        "doc_id", F.col("chunk_no").cast("bigint"), "chunk")


@check("b26_verdict_json", """SELECT interaction_id, status AS llm_status, CAST(scam AS VARCHAR) AS is_scam,
  conf AS confidence, action0 AS recommended_action, reason0 AS reasons, inds AS indicators FROM parsed""",
       ("parsed",))
def _(v):
    rows = fraud.parse_verdicts(fraud.with_verdicts(
        fraud.candidates(v.screened, STAFF), v.verdicts))
    return rows.select("interaction_id", "llm_status", F.col("is_scam").cast("string"), "confidence",
                       "recommended_action", piped("reasons"), piped("indicators"))


@check("b27_verification_log", """SELECT interaction_id, concat(left(content, 120), '...') AS comment_preview,
  emotion AS flagged_for, CASE WHEN failed THEN 'API_ERROR' ELSE sanity_raw END AS raw_response,
  keep AS interpreted_label, status, CASE WHEN status = 'Ambiguous' THEN 'UNCERTAIN' WHEN keep THEN 'VERIFIED'
  ELSE 'REJECTED' END AS display_verdict FROM vsource""", ("vsource",))
def _(v):
    return distress.verification_log(v.parted.with_texts(distress.verify(
        distress.severe_candidates(severe_rows(v), STAFF), v.verdicts), "comment"))
