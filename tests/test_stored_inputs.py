"""Stored weeks, numbered corpus lines, the request ledger, and capped samples."""

import json

import pytest
from pyspark.sql import functions as F

from checks.rules_checks import length_scorer
from checks.views import Views
from hearthlight.operators import sampling, scoring, training
from hearthlight.session import new_folder
from hearthlight.sources import interactions as ingest
from hearthlight.sources import tables
from hearthlight.sources.ledger import Ledger
from hearthlight.sources.weekstore import WeekStore

FOLDER = "/root/testdata/sf0.001"


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_stored_weeks_equal_one_scan(spark):
    forum = Views(spark, FOLDER).forum
    store = WeekStore(spark, new_folder(spark, "weeks"))
    with pytest.raises(ValueError, match="2024-01-22"):
        store.history(2024, 4, 2)
    early = forum.filter("interaction_id % 2 = 0")
    assert len(store.catch_up(early, 2024, 4, 3)) == 3
    assert same(store.history(2024, 4, 3), ingest.interaction_window(early, 2024, 4, 3))
    assert store.catch_up(forum, 2024, 5, 4) == ["2024-01-29"]  # stored weeks are not read again
    store.refresh(forum, 2024, 4, 3)  # late rows
    assert same(store.history(2024, 5, 4), ingest.interaction_window(forum, 2024, 5, 4))
    store.refresh(forum.limit(0), 2024, 3)  # a week that has lost its rows
    left = ingest.interaction_window(forum, 2024, 5, 4).filter("scam_scan_week <> 'W3/2024'")
    assert same(store.history(2024, 5, 4), left)
    plan = store.history(2024, 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    lines = [json.dumps({"id": f"i{k}", "text": "x" * (k % 97)}) for k in range(3000)]
    for k in (5, 700, 2999):
        lines[k] = "{damaged " + "y" * 50
    for part in range(3):
        (tmp_path / f"part-{2 - part}.json").write_text("\n".join(lines[(2 - part) * 1000:(3 - part) * 1000]) + "\n")
    seen, default = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "20k", "3000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = tables.read_corpus(spark, str(tmp_path), json_lines=True)
            seen.append(sorted((r.row_index, r.id) for r in rows.collect()))
            bad = tables.unreadable_lines(spark, str(tmp_path), json_lines=True).collect()
            assert sorted((r.row_index, r.line) for r in bad) == [(k, lines[k]) for k in (5, 700, 2999)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)
    assert seen[0] == [(k, f"i{k}") for k in range(3000) if k not in (5, 700, 2999)]
    assert seen[1] == seen[0] == seen[2]
    first = tables.read_corpus(spark, str(tmp_path), first=7, json_lines=True)
    assert [r.id for r in first.collect()] == ["i0", "i1", "i2", "i3", "i4", "i6", "i7"]


def test_an_array_keeps_its_order(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": f"i{k}"} for k in range(50)]))
    rows = tables.read_corpus(spark, str(tmp_path / "c.json")).collect()
    assert sorted((r.row_index, r.id) for r in rows) == [(k, f"i{k}") for k in range(50)]
    assert tables.unreadable_lines(spark, str(tmp_path / "missing.json")).count() == 0


def replies(spark, log, fail=(), stop_after=None):
    """A reviewer that counts what it is asked, and may fail or end the run."""
    def answer(requests):
        asked = sorted(r.prompt for r in requests.select("prompt").collect())
        if stop_after is not None and len(log) + len(asked) > stop_after:
            raise RuntimeError("cut")
        log.extend(asked)
        text = F.concat(F.lit("re: "), "prompt")
        return requests.select("request", F.when(F.col("prompt").isin(*fail), "ERROR: 429").otherwise(text).alias("answer"))
    return answer


def test_a_run_that_is_cut_goes_on_where_it_stopped(spark):
    prompts = spark.createDataFrame([(k, f"p{k % 40}") for k in range(100)] + [(100, None)], "interaction_id long, prompt string")
    whole, cut = (Ledger(spark, new_folder(spark, "ledger")) for _ in range(2))
    log: list[str] = []
    assert whole.ask(prompts, replies(spark, log), slices=4) == 40 == len(log) == len(set(log))
    log = []
    with pytest.raises(RuntimeError, match="cut"):
        cut.ask(prompts, replies(spark, log, stop_after=25), slices=4)
    before = len(log)
    assert 0 < before < 40
    assert cut.ask(prompts, replies(spark, log), slices=4) == 40 - before
    assert len(log) == len(set(log)) == 40  # nothing was asked twice
    assert same(cut.answers(prompts), whole.answers(prompts))
    rows = {r.interaction_id: r.answer for r in cut.answers(prompts).collect()}
    assert len(rows) == 101 and rows[3] == rows[43] == "re: p3" and rows[100] == "ERROR: Timeout"


def test_failures_are_asked_again_a_few_times(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "interaction_id long, prompt string")
    ledger, log = Ledger(spark, new_folder(spark, "ledger")), []
    for _ in range(5):
        ledger.ask(prompts, replies(spark, log, fail=("b",)), slices=1, attempts=3)
    assert sorted(log) == ["a", "b", "b", "b"]
    assert {r.interaction_id: r.answer for r in ledger.answers(prompts).collect()} == {1: "re: a", 2: "ERROR: 429"}
    assert ledger.compact() and ledger.table.rows(ledger.schema).count() == 2
    assert ledger.ask(prompts, replies(spark, log), slices=1, attempts=4) == 1  # one more try
    assert {r.answer for r in ledger.answers(prompts).collect()} == {"re: a", "re: b"}


def test_equal_texts_are_scored_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.write_text("")

    def counting(texts):
        with seen.open("a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return length_scorer(texts)
    rows = spark.createDataFrame([(k, f"text {k % 7}") for k in range(50)], "interaction_id long, content string")
    ledger = Ledger(spark, new_folder(spark, "scores"), scoring.SCORES)
    first = scoring.score_with_memo(rows.limit(20), counting, ledger, slices=2)
    assert first.count() == 20
    got = scoring.score_with_memo(rows, counting, ledger, slices=2)
    asked = seen.read_text().splitlines()
    assert len(asked) == len(set(asked)) == 7
    want = scoring.score_texts(rows, length_scorer)
    assert same(got.select("interaction_id", "joy", "fear"), want.select("interaction_id", "joy", "fear"))


def test_capped_sample_keeps_all_rows_that_fit(spark):
    rows = Views(spark, FOLDER).external.filter("has_labels").select("row_no", "text")
    wide = rows.withColumns({x: F.lit(1.0) if x in ("joy", "fear") else F.lit(0.0) for x in training.L.LABELS})
    wide = wide.withColumn("text_hash", F.sha2(F.col("row_no").cast("string"), 256))
    n = wide.count()
    assert training.capped_sample(wide, n, 10).count() == n == training.capped_sample(wide, 0, 10).count()
    few = training.capped_sample(wide, 30, 10)
    assert few.count() == 30 and few.columns == wide.columns
    assert same(few.select("row_no"), sampling.uniform_sample(training.cap_per_label(wide, 40), 30, "text_hash").select("row_no"))
