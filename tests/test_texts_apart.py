"""Texts that many rows hold are read once, and rows move without them."""

import datetime as dt

from pyspark.sql import functions as F

from checks.inputs import STAFF, severe_rows
from checks.rules_checks import length_scorer, routed
from checks.views import Views
from hearthlight.operators import distress, evaluation, fraud, scoring, texts
from hearthlight.session import new_folder
from hearthlight.sources import interactions as ingest
from hearthlight.sources.ledger import Ledger

SMALL = "/root/testdata/sf0.001"
HELD = [(3, "claim your prize at http://bit.ly/x"), (1, "claim your prize at http://bit.ly/x"), (2, "hello"),
        (None, "hello"), (None, "only without an id"), (4, None), (5, None), (6, ""), (6, "hello")]


def held(spark):
    return spark.createDataFrame(HELD, "interaction_id bigint, content string").withColumn("n", F.lit(7))


def test_each_text_stands_once_and_no_row_is_lost(spark):
    apart = texts.split(held(spark))
    assert sorted(apart.rows.columns) == ["interaction_id", "n", "text_key"]
    assert apart.rows.count() == len(HELD)
    got = sorted(((r.content, r.interaction_id) for r in apart.texts.collect()), key=repr)
    assert got == sorted([(HELD[0][1], 1), ("hello", 2), ("only without an id", None), (None, 4), ("", 6)], key=repr)


def test_rows_get_what_the_rules_find_in_their_text(spark):
    def found(rows):
        return sorted(map(repr, rows.select("interaction_id", "n", "heuristic_score", "matched_terms").collect()))
    assert found(texts.split(held(spark)).judged(fraud.screen)) == found(fraud.scan(held(spark)))


def test_repeated_texts_reach_the_scorer_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def scorer(batch):
        seen.add(len(batch))
        return length_scorer(batch)
    rows = spark.range(40).select(F.col("id").alias("interaction_id"), F.concat(F.lit("text "), (F.col("id") % 4).cast("string")).alias("content"))
    scored = texts.split(rows).judged(lambda t: scoring.score_texts(t, scorer, key="text_key"))
    assert scored.count() == 40 and seen.value == 4
    ledger = Ledger(spark, new_folder(spark, "scores"), scoring.SCORES)
    again = scoring.score_with_memo(rows, scorer, ledger, slices=1)
    assert again.count() == 40 and seen.value == 8


def test_screened_rows_pass_the_cascade_without_their_text(spark):
    v = Views(spark, SMALL)
    plain = fraud.cascade(v.interactions, v.verdicts, v.accounts, staff=STAFF)
    columns = [c for c in plain.columns if c != "comment"]
    screened = routed(v)
    assert "content" not in screened._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, screened.select(columns).collect())) == sorted(map(repr, plain.select(columns).collect()))
    severe = severe_rows(v)
    assert "content" not in severe._jdf.queryExecution().executedPlan().toString()
    direct = distress.mild_details(distress.severe_details(v.interactions.join(v.scores, "interaction_id")))
    cells = ["interaction_id", "severe", "mild"]
    assert sorted(map(repr, severe.select(cells).collect())) == sorted(map(repr, direct.select(cells).collect()))


def test_texts_of_a_history_are_neither_sorted_nor_shuffled(spark):
    start = dt.datetime(2024, 1, 30)
    rows = [(i, f"t{i % 2}", f"body {i % 3}", start + dt.timedelta(hours=i), i % 2, f"body {i % 3}",
             start + dt.timedelta(hours=i), "c", "n", "e") for i in range(12)]
    raw = spark.createDataFrame(rows, (
        "interaction_id bigint, forum_title string, forum_content string, forum_created_at timestamp, discussion_id bigint, "
        "discussion_content string, discussion_created_at timestamp, community_name string, commenter_name string, commenter_email string"))
    window = ingest.interaction_window(raw, 2024, 5, 1)
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan
    assert sorted(r.interaction_id for r in window.collect()) == [0, 2, 4, 6, 8, 10, 21, 23]


def test_a_miss_sample_draws_ids(spark):
    rows = held(spark).where("interaction_id < 5")
    out = evaluation.miss_sample(rows, rows.where("interaction_id = 3"), 2)
    assert out.count() == 2 and "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert 3 not in [r.interaction_id for r in out.collect()]


def test_texts_do_not_move_with_the_rows_that_repeat_them(spark):
    v, moved = Views(spark, SMALL), []

    def read(ids):
        moved.append(v.interactions_of(ids))
        return moved[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        apart = texts.split(v.interactions, read=read)
        plan = moved[0].select("interaction_id", "content")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join Inner") < plan.index("Join LeftSemi")  # ids are left out below the join with the texts
        assert v.parted.texts.count() == apart.texts.count() == v.interactions.select("content").distinct().count()
        assert apart.rows.count() == v.interactions.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parted_rows_give_the_same_scores_and_candidates(spark):
    from checks.rules_checks import master_rows
    from hearthlight.operators import sampling

    v = Views(spark, SMALL)
    some = v.parted.where("interaction_id % 3 = 0")
    assert some.rows.count() == v.interactions.where("interaction_id % 3 = 0").count()
    assert some.texts.count() == v.interactions.where("interaction_id % 3 = 0").select("content").distinct().count()

    def drawn(rows):
        got = sampling.training_candidates(rows, v.scores, master_rows(v))
        return sorted(map(repr, got.select("interaction_id", "text_hash", "content", "entropy", "commenter_name").collect()))
    assert drawn(v.parted) == drawn(v.interactions)
    rows = held(spark).where("interaction_id IS NOT NULL")

    def scored(given):
        ledger = Ledger(spark, new_folder(spark, "scores"), scoring.SCORES)
        return sorted(map(repr, scoring.score_with_memo(given, length_scorer, ledger, slices=1).collect()))
    assert scored(texts.split(rows)) == scored(rows)


def test_rules_read_texts_in_more_parts_than_there_are_cores(spark):
    apart, dealt = texts.split(held(spark).coalesce(1)), []

    def work(rows):
        dealt.append(rows.rdd.getNumPartitions())
        return fraud.screen(rows)
    assert apart.judged(work).count() == len(HELD)
    assert dealt[0] >= 2 * spark.sparkContext.defaultParallelism > apart.texts.rdd.getNumPartitions()
