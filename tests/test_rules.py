"""Fraud and distress rules on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from hearthlight import labels as L
from hearthlight.functions import scores as S
from hearthlight.operators import distress, fraud

CASES = [
    ("Please verify your account at once here http://bit.ly/abc", "HIGH"),
    ("dm me on telegram, I trade bitcoin and take zelle", "MEDIUM"),
    ("A kernel thread mentioned something new", None),
    ("Which movers did you use for your relocation?", None),
    ("Claim your free voucher, text GIFT to 85023 today", "LOW"),
    ("Dear member, failed login on your bank account", "LOW"),
    ("The bank security team shared a login checklist with every member", None),
    ("Is this a scam? beware of the giveaway", None),
    ("cash flip", None),
]


def test_severity_cases(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)],
                                 "interaction_id bigint, content string")
    got = {r.interaction_id: r for r in fraud.scan(rows).withColumn(
        "severity", fraud.severity()).collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i].severity == want, (text, got[i])


def test_repeated_keyword_counts_twice_and_shows_once(spark):
    row = fraud.scan(spark.createDataFrame([("we cash flip daily",)], "content string")).first()
    assert row.matched_terms == ["cash flip"] and row.heuristic_score == 2


def test_short_payment_terms_stand_alone(spark):
    rows = spark.createDataFrame([("something mentioned",), ("pay in eth, please",)], "content string")
    got = [r.heuristic_score for r in fraud.scan(rows).collect()]
    assert got == [1, 1 + 3]


def people(spark, rows):
    return spark.createDataFrame(
        rows, "interaction_id bigint, content string, community_name string, "
              "commenter_name string, commenter_email string")


LOUD = "won a gift card giveaway, dm me on whatsapp now, send crypto"


def answer(spark, raw, context="{}"):
    return spark.createDataFrame([(1, raw, context)],
                                 "interaction_id bigint, scam_raw string, context_raw string")


def scam(confidence, action, scam=True):
    return json.dumps({"reasoning": "r", "is_scam": scam, "confidence": confidence,
                       "indicators": ["won"], "recommended_action": action})


PASS = '{"context_verdict": "context_pass", "pattern": "move", "reasoning": "ok"}'
FAIL = '{"context_verdict": "context_fail", "pattern": "predatory"}'


@pytest.mark.parametrize("raw, context, disposition", [
    (scam(0.92, "allow"), FAIL, "flag"),
    (scam(0.70, "block"), FAIL, "flag"),
    (scam(0.70, "block"), PASS, "audit"),
    (scam(0.70, "flag_for_review"), FAIL, "audit"),
    (scam(0.95, "allow", False), FAIL, "drop"),
    ("ERROR: 503", FAIL, "flag"),
    ("not json", FAIL, "audit"),
    ('{"is_scam": "true", "confidence": 0.99, "recommended_action": "allow"}', FAIL, "drop"),
])
def test_routing(spark, raw, context, disposition):
    rows = people(spark, [(1, LOUD, None, "Ana", None)])
    out = fraud.cascade(rows, answer(spark, raw, context)).collect()
    assert [r.disposition for r in out] == [disposition]


def test_no_answer_is_a_timeout(spark):
    rows = people(spark, [(2, LOUD, "forum", "Ana", None)])
    out = fraud.cascade(rows, answer(spark, scam(0.9, "block"))).first()
    assert out.llm_status == "ERROR: Timeout" and out.disposition == "flag"
    assert out.confidence == 0.9 and out.recommended_action == "block"


def test_staff_are_left_out_unless_asked(spark):
    rows = people(spark, [(1, LOUD, None, "Forum Moderator", None),
                          (2, LOUD, None, "Ana", "a@staff.example.org")])
    policy = fraud.StaffPolicy(domains=("staff.example.org",))
    assert fraud.candidates(rows, policy).count() == 0
    assert fraud.candidates(rows, policy, include_trusted_users=True).count() == 2


def test_gates(spark):
    rows = spark.createDataFrame([
        (1, "I can help with moves", 400, 3), (2, "I mentor people, dm me", 400, 3),
        (3, "custom handmade mugs, price 10, see my website", 400, 3),
        (4, "seems suspicious, watch out", 400, 3), (5, "you won", 2, 1), (6, "you won", None, None),
    ], "interaction_id bigint, comment string, account_days_old bigint, user_post_count bigint")
    got = [r.tier3_verdict for r in fraud.context_gates(rows).orderBy("interaction_id").collect()]
    assert got == ["safe_peer_support", "proceed", "safe_business", "safe_awareness",
                   "new_account_risk", "proceed"]


def test_new_account_reaches_the_audit_queue(spark):
    rows = people(spark, [(1, "Congratulations you won! Claim prize http://example.com", None, "Ana", None)])
    accounts = spark.createDataFrame([(1, 2, 1)], "interaction_id bigint, account_days_old bigint, "
                                                  "user_post_count bigint")
    out = fraud.cascade(rows, answer(spark, scam(0.7, "flag_for_review"), FAIL), accounts).first()
    assert (out.tier3_verdict, out.disposition) == ("new_account_risk", "audit")


def test_dispositions_partition_the_candidates(spark):
    rows = people(spark, [(1, LOUD, None, "Ana", None), (2, LOUD, None, "Ben", None)])
    out = fraud.cascade(rows, answer(spark, scam(0.1, "allow", False)))
    assert fraud.flags(out).count() + fraud.audit_queue(out).count() + out.filter(
        "disposition = 'drop'").count() == 2


def scored(spark, rows):
    """rows: (id, text, {label: score})"""
    data = [(i, t, *[float(s.get(x, 0.0)) for x in L.LABELS]) for i, t, s in rows]
    return spark.createDataFrame(data, "interaction_id bigint, content string, "
                                 + ", ".join(f"{x} double" for x in L.LABELS))


@pytest.mark.parametrize("text, scores, flags", [
    ("hello", {"sadness": 0.30}, []),  # 0.75 * 0.40 is a little above 0.30 in binary
    ("hello", {"sadness": 0.31}, ["sadness_above_review_band"]),
    ("hello", {"grief": 0.05}, ["grief_review_band"]),
    ("at the funeral", {"grief": 0.033}, ["grief_review_band", "support_need_with_grief_hint"][:1]),
    ("hello", {"nervousness": 0.16}, []),
    ("hello", {"anger": 0.41}, ["severe_hard_guardrail"]),
    ("i need help", {"confusion": 0.12}, ["support_need_signal", "lexical_hardship_override"]),
    ("surviving debt", {"confusion": 0.2}, []),
    ("job loss, evicted, behind on bills and homeless", {}, ["multi_hit_context_override"]),
])
def test_severe_flags(spark, text, scores, flags):
    row = distress.severe_details(scored(spark, [(1, text, scores)])).first()
    assert row.severe.reason_flags == flags
    assert row.severe.candidate == bool(flags)


def test_verification_override(spark):
    rows = spark.createDataFrame([
        (1, "true", 10.0, []), (2, "false", 71.0, ["severe_sum_high"]),
        (3, "false", 60.0, ["severe_sum_high"]), (4, "unclear", 60.0, []), (5, "unclear", 10.0, []),
        (6, "ERROR: 1", 90.0, [])],
        "interaction_id bigint, sanity_raw string, total_negative double, reason_flags array<string>")
    candidates = rows.drop("sanity_raw").withColumn("support_need_hits", F.array().cast("array<string>"))
    out = {r.interaction_id: r.verdict_source for r in distress.verify(candidates, rows).collect()}
    assert out == {1: "gemini_true", 2: "recall_override_false", 3: "gemini_false",
                   4: "recall_override_ambiguous", 5: "gemini_false", 6: None}


def test_ties_go_to_the_first_label(spark):
    row = scored(spark, [(1, "", {"fear": 0.5, "anger": 0.5})]).select(
        S.dominant().alias("all"), S.dominant(L.SERIOUS).alias("serious")).first()
    assert (row.all, row.serious) == ("anger", "anger")
