"""Queries over score vectors and rule sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import oracle as O
from checks.inputs import STAFF, piped, reviewed, severe_rows
from checks.registry import check
from checks.views import BucketedViews
from hearthlight import labels as L
from hearthlight.functions import scores as S
from hearthlight.functions import text as T
from hearthlight.functions import verdicts as V
from hearthlight.operators import distress, evaluation, fraud, metrics, sampling, scoring, training
from hearthlight.session import cut_lineage, new_folder
from hearthlight.sources.ledger import Ledger


def _scores(name: str, sql: str, columns):
    @check(name, f"SELECT interaction_id, {sql} FROM scores", ("scores",))
    def _(v):
        return v.scores.select("interaction_id", *columns())


_MESSY = ("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'bad' WHEN 2 THEN '-0.5' WHEN 3 THEN '1.75' "
          "ELSE concat('0.', CAST(100 + event_id % 900 AS VARCHAR(20))) END")


@check("c1_normalize_scores", f"""SELECT event_id, least(greatest(coalesce(TRY_CAST({_MESSY} AS DOUBLE), 0), 0), 1)
  AS score FROM events""")
def _(v):
    return v.table("events").select("event_id", S.normalize_score(F.expr(_MESSY)).alias("score"))


_scores("c2_active_labels", f"{O.active()} AS labels",
        lambda: [S.active_labels(L.DEFAULT_THRESHOLDS).alias("labels")])
_scores("c3_dominant", f"{O.first_max(L.LABELS)} AS top_label, {O.first_max(L.NEGATIVE)} AS top_negative",
        lambda: [S.dominant().alias("top_label"), S.dominant(L.NEGATIVE).alias("top_negative")])
_scores("c4_components",
        f"round({O.component_sum(L.SEVERE_SUM)}, 12) AS total, CAST({O.component_count(L.SEVERE_SUM)} AS BIGINT) AS n, "
        f"{O.component_list(L.SEVERE_SUM)} AS names",
        lambda: [F.round(S.component_sum(L.SEVERE_SUM), 12).alias("total"),
                 S.component_count(L.SEVERE_SUM).cast("bigint").alias("n"),
                 F.array_join(S.components(L.SEVERE_SUM), "|").alias("names")])
_scores("c5_spike", f"round({O.greatest(L.SERIOUS)}, 12) AS spike, round({O.greatest(L.RARE)}, 12) AS rare",
        lambda: [F.round(S.peak(L.SERIOUS), 12).alias("spike"), F.round(S.peak(L.RARE), 12).alias("rare")])
_scores("c6_threshold_margin", "round(least(" + ", ".join(
    f"abs({x} - {L.DEFAULT_THRESHOLDS[x]!r}::DOUBLE)" for x in L.LABELS) + "), 12) AS margin",
        lambda: [F.round(S.threshold_margin(L.DEFAULT_THRESHOLDS), 12).alias("margin")])
_CLIPPED = [f"least(greatest({x}, 1e-9), 1.0)" for x in L.LABELS]
_ALL = O.plus(_CLIPPED)
_scores("c7_entropy", f"round(-({O.plus(f'({c} / {_ALL}) * ln({c} / {_ALL})' for c in _CLIPPED)}), 6) AS entropy",
        lambda: [F.round(S.entropy(), 6).alias("entropy")])


@check("c8_max_pool", """WITH starts AS (SELECT doc_id, n, unnest(CASE WHEN n <= 300 THEN [0] ELSE
  generate_series(0, n - 1, 250) END) AS s FROM (SELECT doc_id, len(string_split(trim(regexp_replace(text,
  '\\s+', ' ', 'g')), ' ')) AS n FROM documents))
SELECT doc_id, """ + ", ".join(
    f"round(max(((doc_id * 31 + (s // 250) * 7 + {i * 13}) % 100) / 100.0::DOUBLE), 6) AS {x}"
    for i, x in enumerate(L.LABELS)) + " FROM starts GROUP BY doc_id")
def _(v):
    pieces = T.explode_chunks(v.table("documents").select("doc_id", "text"), "text")
    scored = pieces.select("doc_id", *[
        (((F.col("doc_id") * 31 + F.col("chunk_no") * 7 + i * 13) % 100) / F.lit(100.0)).alias(x)
        for i, x in enumerate(L.LABELS)])
    pooled = S.max_pool(scored, "doc_id")
    return pooled.select("doc_id", *[F.round(x, 6).alias(x) for x in L.LABELS])


@check("c9_baseline_scores", "SELECT event_id, " + ", ".join(
    f"{float(L.BASELINE_SCORES.get(x, 0))!r}::DOUBLE AS {x}" for x in L.LABELS) + " FROM events")
def _(v):
    return S.baseline_scores(v.table("events").select("event_id"))


def length_scorer(texts: list[str]) -> list[dict[str, float]]:
    """Stand-in model: two labels from the text length."""
    return [{"joy": (len(t) % 100) / 100, "fear": (len(t) % 7) / 10} for t in texts]


_SCORED = r"""WITH w AS (SELECT interaction_id, content, string_split(trim(regexp_replace(content,
  '\s+', ' ', 'g')), ' ') AS ws FROM interactions), starts AS (SELECT *, unnest(CASE WHEN len(ws) <= 300 THEN [0] ELSE
  generate_series(0, len(ws) - 1, 250) END) AS s FROM w), chunks AS (SELECT interaction_id, length(CASE WHEN len(ws) <= 300
  THEN content ELSE array_to_string(ws[s + 1:s + 300], ' ') END) AS n FROM starts)
SELECT interaction_id, max((n % 100) / 100::DOUBLE) AS joy, max((n % 7) / 10::DOUBLE) AS fear, 0::DOUBLE AS neutral
  FROM chunks GROUP BY 1"""


@check("c10_pluggable_scorer", _SCORED, ("interactions",))
def _(v):
    scored = v.parted.judged(lambda t: scoring.score_texts(t, length_scorer, key="text_key"))
    return scored.select("interaction_id", "joy", "fear", "neutral")


@check("c10_scored_once", _SCORED, ("interactions",))
def _(v):
    ledger = Ledger(v.spark, new_folder(v.spark, "scores"), scoring.SCORES)
    half = v.parted.where("interaction_id % 2 = 0")
    scoring.score_with_memo(half, length_scorer, ledger, slices=2)
    return scoring.score_with_memo(v.parted, length_scorer, ledger, slices=2).select(
        "interaction_id", "joy", "fear", "neutral")


@check("c11_external_vector", "WITH n AS (SELECT row_no, " + "CASE emotion_no " + " ".join(
    f"WHEN {i} THEN {O.q(name)}" for i, name in enumerate(O.R.DIALOGUE_LABEL_MAP)) + """ END AS lab FROM external)
SELECT row_no, lab, concat_ws(', ', """ + ", ".join(
    f"CASE WHEN lab IN ({', '.join(O.q(k) for k, w in O.R.DIALOGUE_LABEL_MAP.items() if x in w) or 'NULL'}) THEN {O.q(x)} END"
    for x in L.LABELS) + ") AS labels, " + ", ".join(
    "CAST(CASE lab " + " ".join(f"WHEN {O.q(k)} THEN {w[x]}" for k, w in O.R.DIALOGUE_LABEL_MAP.items() if x in w)
    + f" ELSE 0 END AS DOUBLE) AS {x}" if any(x in w for w in O.R.DIALOGUE_LABEL_MAP.values()) else f"0::DOUBLE AS {x}"
    for x in L.LABELS) + " FROM n", ("external",))
def _(v):
    names = list(O.R.DIALOGUE_LABEL_MAP)
    rows = v.external.select("row_no", F.try_element_at(
        F.array(*map(F.lit, names)), F.col("emotion_no") + 1).alias("lab"))
    wide = rows.withColumns(training.labels_from_map(F.col("lab"), O.R.DIALOGUE_LABEL_MAP))
    return wide.select("row_no", "lab", F.concat_ws(", ", *[
        F.when(F.col(x) > 0, F.lit(x)) for x in L.LABELS]).alias("labels"), *L.LABELS)


def taught(v):
    return training.teacher_rows(v.parted.rows.select("interaction_id"), v.teacher)


def pairs(v, facts=lambda texts: texts, size=None):
    """Without texts, but with what ``facts`` reads from them."""
    pool = cut_lineage(evaluation.evaluation_pool(v.parted.texts.drop("text_key"), size, facts=facts))
    ids = pool.select("interaction_id")
    answers = v.teacher.join(ids, "interaction_id", "left_semi")
    return evaluation.score_pairs(pool, v.scores, training.teacher_rows(ids, answers))


_DELTAS = [f"round({x} - t_{x}, 2)" for x in L.LABELS]
_TOP = "greatest(" + ", ".join(f"abs({d})" for d in _DELTAS) + ")"
DISAGREE = f"""SELECT interaction_id, concat(left(cleaned, 80), CASE WHEN length(cleaned) > 80 THEN '...' ELSE
  '' END) AS text_preview, {O.active('t_')} AS teacher_labels, {O.active()} AS student_labels,
  CASE {' '.join(f"WHEN abs({d}) = {_TOP} THEN {O.q(x.title())}" for x, d in zip(L.LABELS, _DELTAS))} END
  AS disagreement_label,
  CASE {' '.join(f"WHEN abs({d}) = {_TOP} THEN {d}" for d in _DELTAS)} END AS disagreement_delta FROM pairs"""


@check("c12_teacher_student_deltas", DISAGREE, ("pairs",))
def _(v):
    return evaluation.disagreements(pairs(v, evaluation.with_preview))


# --- distress -----------------------------------------------------------------------------------


@check("d1_severe_candidate", """SELECT interaction_id, severe AS candidate, round(ssum, 12) AS severe_sum,
  round(savg, 6) AS severe_avg, comps AS severe_components, CAST(scount AS BIGINT) AS severe_component_count,
  round(spike, 12) AS severe_spike, dom AS dominant_emotion, round(dom_score, 12) AS dominant_score,
  flags AS reason_flags, hints AS rare_hints, hits AS support_need_hits FROM detail""", ("detail",))
def _(v):
    rows = distress.severe_details(v.signalled.join(v.scores, "interaction_id"))
    flat = rows.select("interaction_id", "severe.*")
    return flat.select(
        "interaction_id", "candidate",
        *[F.round(c, 12).alias(c) for c in ("severe_sum", "severe_spike", "dominant_score")],
        F.round("severe_avg", 6).alias("severe_avg"),
        F.col("severe_component_count").cast("bigint"), "dominant_emotion",
        *[piped(c) for c in ("severe_components", "reason_flags", "rare_hints", "support_need_hits")])


@check("d2_mild_candidate", """SELECT interaction_id, mild AS candidate, round(CASE WHEN severe THEN ssum ELSE
  negsum END, 12) AS negative_sum, round(CASE WHEN severe THEN savg ELSE navg END, 6) AS negative_avg,
  CASE WHEN severe THEN comps ELSE neg_comps END AS negative_components,
  CASE WHEN severe THEN dom ELSE neg_dom END AS dominant_emotion FROM detail""", ("detail",))
def _(v):
    flat = severe_rows(v).select("interaction_id", "mild.*")
    return flat.select(
        "interaction_id", "candidate", F.round("negative_sum", 12).alias("negative_sum"),
        F.round("negative_avg", 6).alias("negative_avg"), piped("negative_components"),
        "dominant_emotion")


@check("d3_fraud_scan", """SELECT interaction_id, CAST(heuristic_score AS BIGINT) AS heuristic_score, matched_terms
  FROM scan""", ("scan",))
def _(v):
    return fraud.scan(v.screened).select(
        "interaction_id", F.col("heuristic_score").cast("bigint"), piped("matched_terms"))


@check("d4_benchmark_escalation", """SELECT interaction_id, heuristic_score >= 10 OR short AS escalates FROM scan""",
       ("scan",))
def _(v):
    return fraud.scan(v.screened).select(
        "interaction_id", fraud.benchmark_escalates().alias("escalates"))


@check("d5_severity", f"SELECT interaction_id, {O.SEVERITY} AS severity_level FROM scan", ("scan",))
def _(v):
    return fraud.scan(v.screened).select("interaction_id", fraud.severity().alias("severity_level"))


@check("d6_context_gates", "SELECT interaction_id, gate AS tier3_verdict, gate_reason AS tier3_reason FROM gates",
       ("gates",))
def _(v):
    rows = fraud.with_accounts(fraud.candidates(v.screened, STAFF), v.accounts)
    return fraud.context_gates(rows).select("interaction_id", "tier3_verdict", "tier3_reason")


@check("d7_outage_fallback", """SELECT interaction_id, CAST(CASE WHEN severity_level IN ('HIGH', 'MEDIUM') THEN true END
  AS VARCHAR) AS is_scam, CASE severity_level WHEN 'HIGH' THEN 0.9::DOUBLE WHEN 'MEDIUM' THEN 0.75::DOUBLE ELSE
  0.2::DOUBLE END AS confidence, CASE severity_level WHEN 'HIGH' THEN 'block' WHEN 'MEDIUM' THEN 'flag_for_review'
  ELSE 'audit' END AS recommended_action FROM cand""", ("cand",))
def _(v):
    rows = fraud.candidates(v.screened, STAFF).withColumn("scam_raw", F.lit("ERROR: UNAVAILABLE"))
    return fraud.parse_verdicts(rows).select(
        "interaction_id", F.col("is_scam").cast("string"), "confidence", "recommended_action")


def routed(v):
    return fraud.cascade(v.screened, v.verdicts, v.accounts, staff=STAFF)


_ROUTED = """SELECT interaction_id, severity_level, status AS llm_status, CASE WHEN
  status = 'OK' THEN gate END AS tier3_verdict,
  action AS recommended_action, disposition, audit_reason FROM routed"""


def _routes(rows):
    return rows.select("interaction_id", "severity_level", "llm_status", "tier3_verdict",
                       "recommended_action", "disposition", "audit_reason")


@check("d8_routing", _ROUTED, ("routed",))
def _(v):
    return _routes(routed(v))


@check("e4_bucketed_cascade", _ROUTED, ("routed",))
def _(v):
    return _routes(routed(BucketedViews(v, ("interactions", "verdicts", "accounts"))))


@check("d9_review_severity", """SELECT interaction_id, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][priority] AS severity,
  CAST(priority AS BIGINT) AS review_priority FROM reviewed""", ("reviewed",))
def _(v):
    return reviewed(v).select("interaction_id", "severity", F.col("review_priority").cast("bigint"))


@check("d10_policy_thresholds", """WITH p AS (SELECT *, CASE WHEN need_context IS NULL THEN false ELSE
  (status = 'OK' AND coalesce(scam, false) AND coalesce(conf, 0) >= 0.69::DOUBLE AND coalesce(conf, 0) < 0.7::DOUBLE)
  END AS nc, (coalesce(scam, false) AND coalesce(conf, 0) >= 0.7::DOUBLE) OR action = 'block' AS u FROM routed0)
SELECT interaction_id, CASE WHEN status <> 'OK' THEN CASE WHEN coalesce(scam, false) AND severity_level IN ('HIGH',
  'MEDIUM') THEN 'flag' ELSE 'audit' END WHEN u THEN CASE WHEN nc AND context_raw LIKE '%context_pass%' THEN 'audit'
  ELSE 'flag' END WHEN action = 'flag_for_review' THEN 'audit' ELSE 'drop' END AS disposition FROM p""", ("routed0",))
def _(v):
    strict = fraud.Policy(block=0.70, medium=0.80)
    out = fraud.cascade(v.screened, v.verdicts, v.accounts, strict, STAFF)
    return out.select("interaction_id", "disposition")


def verified_rows(v):
    return distress.verify(distress.severe_candidates(severe_rows(v), STAFF), v.verdicts)


@check("d11_severe_verification", """SELECT interaction_id, CAST(verdict AS VARCHAR) AS verdict, over AS recall_override,
  keep AS is_concerning, source AS verdict_source, status FROM vsource""", ("vsource",))
def _(v):
    return verified_rows(v).select(
        "interaction_id", F.col("verdict").cast("string"), "recall_override", "is_concerning",
        "verdict_source", "status")


@check("d12_verified_only", "SELECT interaction_id, total_negative FROM vsource WHERE source = 'gemini_true'",
       ("vsource",))
def _(v):
    return distress.verified(verified_rows(v), True).select("interaction_id", "total_negative")


@check("d13_trusted_filter", f"SELECT interaction_id, commenter_name FROM interactions WHERE NOT {O.staff()}",
       ("interactions",))
def _(v):
    return fraud.drop_staff(v.interactions, STAFF).select("interaction_id", "commenter_name")


def training_rows(v):
    """Without texts, which neither masks nor draws read."""
    return sampling.training_candidates(v.parted, v.scores, master_rows(v), words=False)


def master_rows(v):
    return v.external.filter("has_labels").select("row_no", "text").withColumn(
        "text_hash", T.text_hash("text"))


@check("d14_bucket_masks", "SELECT interaction_id, m1 AS rare_focus, m2 AS uncertain, m3 AS suspect, m4 AS neutral, "
       "m5 AS random FROM masks", ("masks",))
def _(v):
    masked = sampling.with_bucket_masks(cut_lineage(training_rows(v)))
    return masked.select(
        "interaction_id", F.col("in_rare_focus").alias("rare_focus"), F.col("in_uncertain").alias("uncertain"),
        F.col("in_false_positive_suspect").alias("suspect"), F.col("in_neutral_baseline").alias("neutral"),
        F.col("in_random_baseline").alias("random"))
