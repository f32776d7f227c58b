"""Rules test cheap literals before their patterns; what they find is what the patterns alone find."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hearthlight import rules as R
from hearthlight.functions import matching as M
from hearthlight.functions import text as T
from hearthlight.operators import distress, fraud

PIECES = [
    "i help with", "i can help with", "hi mentor", "i mentor", "i assist", "i offer guidance", "i volunteer to help",
    "i provide support", "i have experience with", "i trained", "i specialize in", "i focus in", "i offer  make",
    "i sell custom", "handmade", "handmades", "licensed", "$5", "$", "cost", "cost 7", "fee\n9", "price ٣", "email", "emails",
    "facebook", "is this a scam?", "is this a scam?x", "warning", "warnings", "don't click", "fake", "fakery", "red flags",
    "unred flags", "how to spot", "gift card", "send me dm", "dm me", "signal", "upfront payment", "whatsapp",
    "1 (202) 555-0143", "202.555.0143", "+1 202 555 014", "12345", "123456", "eth", "something", "eth5", "wire", "free",
    "txt", "win", "claim", "account locked", "bank", "member", "é", "_", ".", "éwin", "opt out",
    "need help", "it's been tough", "its been tough", "isolated", "isod", "widowed", "widows", "work", "works", "éwork",
    "i'm homeless", "laid off", "caregiver", "funeral", "proud of", "  ", "\t", "\xa0", "  ", "\n\n", "\x1c", "\x85",
]


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(3)
    rows = [(i, p) for i, p in enumerate(PIECES)]
    rows += [(len(PIECES) + i, "".join(
        draw.choice(PIECES) + draw.choice(["", " ", " ", "\n"]) for _ in range(draw.randint(2, 9)))) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, content string")


def _plain(low, patterns):
    return low.rlike(M.pattern("|".join(f"(?:{p})" for p in patterns)))


def test_gates_find_what_their_patterns_find(texts):
    low = F.lower("content")
    found = fraud._with_hits(texts, "content").select("id", "content", *[
        c.alias(n) for n, c in fraud._gate_signals().items()])
    plain = {
        "_peer": _plain(low, R.PEER_SUPPORT) & ~M.any_term(low, R.PEER_BLOCKERS),
        "_signals": M.compact([F.when(low.rlike("(?Ud)" + e), F.lit(n)) for n, e in R.BUSINESS_SIGNALS]),
        "_routing": M.any_term(low, R.BUSINESS_BLOCKERS),
        "_aware": _plain(low, R.AWARENESS_TALK) & ~M.any_term(low, R.AWARENESS_BLOCKERS),
    }
    for name, want in plain.items():
        assert found.where(~F.col(name).eqNullSafe(want)).select("content").take(3) == [], name
        assert found.select(name).distinct().count() > 1


def test_signals_find_what_their_patterns_find(texts):
    raw, low = F.col("content"), F.lower("content")
    pairs = {"phone": (fraud._PHONE_CORE, R.PHONE, raw)} | {
        n: (M.letters_first(getattr(R, n)), getattr(R, n), low) for n in (
            "SMS_ACTION", "SMS_PROMO", "SHORTCODE_ACTION", "SHORTCODE_PROMO", "ACCOUNT_PHRASE", "ACCOUNT_CONTEXT")
    } | {p: (M.start_first(p), p, low) for p in (*R.SUPPORT_NEED, *R.HARDSHIP_CONTEXT, R.SMS_FREE)}
    assert fraud._PHONE_CORE != R.PHONE and fraud._PHONE_CORE.startswith(r"\d{3}")
    wrong = texts.select([F.count_if(on.rlike(M.pattern(a)) != on.rlike(M.pattern(b))).alias(str(i))
                          for i, (a, b, on) in enumerate(pairs.values())]).first()
    assert sum(wrong) == 0


def test_white_space_is_as_listed(texts):
    odd = T._NON_SPACE
    plain = F.regexp_replace("content", f"[{odd}][ {odd}]*| [ {odd}]+", " ")
    assert texts.where(T.collapse_whitespace("content") != plain).count() == 0
    every = texts.sparkSession.range(0x3100).where("id not between 55296 and 57343").select(
        F.concat(F.lit("a"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"), F.lit("b")).alias("content"))
    assert every.where(T.collapse_whitespace("content") != plain).count() == 0


def test_no_word_edge_is_tested_at_each_position(texts, spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (
            fraud.screen(texts), distress.with_text_signals(texts))]
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    for plan in plans:
        assert "(?U)(?=" in plan and not re.search(r"\(\?Ud?\)(\(\?:)*\\b", plan)
