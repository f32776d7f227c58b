"""Text functions against Python's own libraries."""

import hashlib
import html
import random
import re
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from hearthlight import rules as R
from hearthlight.functions import matching as M
from hearthlight.functions import text as T
from hearthlight.functions import verdicts as V
from hearthlight.functions import weeks as W


def expected_clean(value):
    if value is None:
        return ""
    value = html.unescape(re.sub(r"<[^>]+>", " ", value))
    return re.sub(r"\s+", " ", value).strip()


def random_text(rng):
    parts = []
    for _ in range(rng.randint(1, 6)):
        kind = rng.randrange(5)
        if kind == 0:
            parts.append("&" + rng.choice(sorted(html5)) + rng.choice(["", ";", "x", "=", "&"]))
        elif kind == 1:
            number = rng.choice([0, 1, 11, 13, 127, 128, 129, 150, 160, 233, 0x1F600, 0x110000,
                                 10 ** 20, 0xFFFE, 65, 64976])
            parts.append(f"&#{number}" + rng.choice([";", "", "a"]))
        elif kind == 2:
            parts.append("&#x" + rng.choice(["0", "d", "80", "92", "dfff", "41", "10ffff",
                                             "f" * 18]) + rng.choice([";", "", " "]))
        elif kind == 3:
            parts.append(rng.choice(["<b>", "&lt;i&gt;", "<", ">", "& ", "&&", "&notit;",
                                     "&amp;lt;", "&;", "&#;", "&#xg;"]))
        else:
            parts.append(rng.choice(["abc", "  ", "\x1c", "\n\t ", " ", "é", "　x"]))
    return "".join(parts)


def test_clean_text_equals_standard_library(spark):
    rng = random.Random(7)
    rows = [(i, random_text(rng)) for i in range(3000)] + [(3000, None), (3001, "")]
    got = spark.createDataFrame(rows, "i int, s string").repartition(8).select(
        "i", T.clean_text("s").alias("c"), T.text_hash("s").alias("h")).collect()
    by_id = {r.i: r for r in got}
    for i, value in rows:
        want = expected_clean(value)
        assert by_id[i].c == want, value
        assert by_id[i].h == hashlib.sha256(want.lower().encode()).hexdigest()


def test_cleaning_is_not_idempotent(spark):
    row = spark.range(1).select(
        T.clean_text(F.lit("&lt;b&gt;")).alias("once"),
        T.clean_text(T.clean_text(F.lit("&lt;b&gt;"))).alias("twice")).first()
    assert (row.once, row.twice) == ("<b>", "")


def test_hit_list_equals_substring_search(spark):
    rng = random.Random(3)
    terms = ["won", "winner", "claim your", "claim your prize", " pin", "bit.ly", "earn $", "eth"]
    pieces = [*terms, "wonderful", "something", " ", "claim ", "you", "$", "bit", "."]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(6))) for i in range(400)]
    frame = spark.createDataFrame(rows, "i int, s string").withColumn(
        "h", M.hit_list(F.col("s"), terms))
    for row in frame.select("s", *[M.in_hits(F.col("h"), t).alias(str(k))
                                   for k, t in enumerate(terms)]).collect():
        assert [row[str(k)] for k in range(len(terms))] == [t in row.s for t in terms], row.s


def test_literal_starts_are_necessary():
    for expr in (*R.SUPPORT_NEED, *[p for g in R.RARE_HINTS.values() for p in g]):
        start = M.literal_start(expr)
        assert start and re.escape(start)[0] == re.escape(expr.removeprefix(r"\b"))[0]
    assert M.literal_start(r"\bwidow(?:ed)?\b") == "widow"
    assert M.literal_start(r"\bit'?s been tough\b") == "it"


@pytest.mark.parametrize("raw, tolerant, strict", [
    ("REASONING: r\n**VERDICT: True**", True, None),
    ("REASONING: r\nVERDICT: True", True, True),
    ("VERDICT: maybe\n  verdict: false", False, False),
    ("VERDICT:\nTRUE", True, None),
    ("true", True, None),
    ("true or false", None, None),
])
def test_verdicts(spark, raw, tolerant, strict):
    row = spark.range(1).select(V.boolean_verdict(F.lit(raw)).alias("a"),
                                V.line_verdict(F.lit(raw)).alias("b")).first()
    assert (row.a, row.b) == (tolerant, strict)


def test_extract_json(spark):
    fence = "```"
    cases = [
        (f'{fence}JSON\n{{"a": 1}}\n{fence} tail', '{"a": 1}'),
        ('note {"a": {"b": 2}} end', '{"a": {"b": 2}}'), ("} no {", "} no {"), ("  x ", "x"),
    ]
    got = spark.createDataFrame(cases, "s string, want string").select(
        V.extract_json("s").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_chunks(spark):
    words = [f"w{i}" for i in range(301)]
    rows = [(0, " a  b "), (1, " ".join(words)), (2, " ".join(words[:300]))]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i int, s string").select(
        "i", T.chunks("s").alias("c")).collect()}
    assert got[0] == [" a  b "] and len(got[2]) == 1
    assert got[1] == [" ".join(words[:300]), " ".join(words[250:])]


def test_iso_weeks(spark):
    row = spark.range(1).select(
        W.week_label(F.lit("2024-12-30").cast("date")).alias("label"),
        W.week_monday(F.lit(2020), F.lit(53)).cast("string").alias("w53"),
        W.week_monday(F.lit(2021), F.lit(53)).cast("string").alias("none"),
        W.parse_week(F.lit("Week 12 (Mar)")).alias("p")).first()
    assert (row.label, row.w53, row.none, row.p) == ("W1/2025", "2020-12-28", None, 12)
    with pytest.raises(ValueError):
        W.week_bounds(2021, 53)


def test_identity_and_staff(spark):
    rows = [("  Ana ", "A@Staff.Example.org"), ("NaN", None), ("Site Moderator", ""), (None, "x@y.z")]
    got = spark.createDataFrame(rows, "n string, e string").select(
        T.normalize_identity("n").alias("n"),
        T.is_staff("n", "e", ("staff.example.org",)).alias("s")).collect()
    assert [(r.n, r.s) for r in got] == [
        ("Ana", True), ("N/A", False), ("Site Moderator", True), ("N/A", False)]


def test_the_automaton_finds_what_the_expression_finds(spark):
    from hearthlight.operators import fraud

    texts = ["", "now", "no", "snow and ethical won't", "gift cardgift card", "İ ß 😀 cash flip", "pin, ssn\nloan", "éstruggling", "a_struggling",
             "struggling with rent; i struggle", "x" * 50_000 + " whatsapp", " ".join(fraud.SCAN_TERMS)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = M.with_hit_list(rows, "t", fraud.SCAN_TERMS, "new").withColumn("old", M.hit_list(F.col("t"), fraud.SCAN_TERMS)).collect()
    for r in found:
        for term in fraud.SCAN_TERMS:
            assert (f"\n{term}" in r.new) == (f"\n{term}" in r.old) == (term in r.t)
    starts = [M.literal_start(p) for p in R.SUPPORT_NEED]
    edged = M.with_hit_list(rows, "t", starts, "new", at_edge=True).withColumn("old", M.start_hits(F.col("t"), R.SUPPORT_NEED)).collect()
    for r in edged:  # never less than the expression finds; patterns follow
        assert all(f"\n{s}" in r.new for s in starts if f"\n{s}" in r.old)
        assert not any(f"\n{s}" in r.new for s in starts if s not in r.t)
