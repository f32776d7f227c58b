"""Sampling, metrics, ingest and whole jobs on small frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import compare
from hearthlight import schema
from hearthlight.operators import metrics, sampling, scoring, training
from hearthlight.operators.dedup import keep_first, top_per_group
from hearthlight.sources import interactions as ingest
from hearthlight.sources import tables


@pytest.mark.parametrize("values", [
    [0.5], [0.1, 0.2], [1.0] * 50 + [2.0], [0.3] * 9 + [0.9] * 3, "random", "close",
])
def test_exact_quantile(spark, values):
    rng = random.Random(5)
    if values == "random":
        values = [rng.random() * 3 for _ in range(3000)]
    elif values == "close":
        values = [1 + rng.random() * 1e-7 for _ in range(500)]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(8)
    got = metrics.exact_quantile(rows, "v", 0.75, 0.0, 3.4, bins=64).first().quantile
    assert got == pytest.approx(np.quantile(values, 0.75), abs=1e-12)


def test_bucket_targets():
    assert sum(sampling.bucket_targets(61).values()) == 61
    assert sampling.bucket_targets(10) == {
        "rare_focus": 3, "uncertain": 3, "false_positive_suspect": 2, "neutral_baseline": 1,
        "random_baseline": 1}


def test_stratified_sample_fills_in_order(spark):
    rows = spark.range(200).select(
        F.col("id").alias("k"), (F.col("id") < 5).alias("in_rare_focus"),
        (F.col("id") % 2 == 0).alias("in_uncertain"), F.lit(False).alias("in_false_positive_suspect"),
        (F.col("id") > 150).alias("in_neutral_baseline"), F.lit(True).alias("in_random_baseline"))
    got = sampling.stratified_sample(rows, 60, "k").collect()
    assert len({r.k for r in got}) == len(got) == 60
    counts = {}
    for r in got:
        counts[r.sampler_bucket] = counts.get(r.sampler_bucket, 0) + 1
    assert counts == {"rare_focus": 5, "uncertain": 15, "neutral_baseline": 9, "random_baseline": 6,
                      "random_fill": 25}


@pytest.mark.parametrize("n, limit", [(3, "1000"), (40, "10")])
def test_top_per_group_on_a_hot_key(spark, n, limit):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", limit)
    try:
        rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("g"))
        got = top_per_group(rows, ["g"], [F.desc("id")], n, "id").filter("g = -1").collect()
        want = [i for i in range(1999, -1, -1) if i % 3][:n]
        assert sorted((r.id for r in got), reverse=True) == want
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_keep_first_limits_before_the_shuffle(spark):
    rows = spark.range(100).withColumn("g", F.col("id") % 3)
    plan = keep_first(rows, ["g"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_append_equals_merge(spark):
    master = spark.createDataFrame([(1, "a"), (2, "b")], "row_no bigint, text_hash string")
    batch = spark.createDataFrame([(9, "b"), (8, "c"), (7, "c")], "row_no bigint, text_hash string")
    fresh = training.rows_to_append(batch, master, ["row_no"]).collect()
    merged = training.merged_master(batch, master, ["row_no"]).collect()
    assert [(r.row_no, r.text_hash) for r in fresh] == [(7, "c")]
    assert sorted((r.row_no, r.text_hash) for r in merged) == [(1, "a"), (2, "b"), (7, "c")]


def test_ingest_rules(spark):
    rows = [
        (1, "T", "B", "2024-01-16 10:00:00", 5, "old", "2024-01-16 10:00:00"),
        (2, "T", "B", "2024-01-15 10:00:00", 5, "<p>new &amp; x</p>", "2024-01-17 10:00:00"),
        (3, None, "B", "2024-01-15 00:00:00", None, "none", "2024-01-15 00:00:00"),
        (4, "T", None, "2024-01-21 23:59:59", 6, "  ", "2024-01-21 23:59:59"),
        (5, "T", "B", "2024-01-22 00:00:00", 5, "next week", "2024-01-22 00:00:00"),
    ]
    raw = spark.createDataFrame([(*r, "c", "n", "e") for r in rows], (
        "interaction_id bigint, forum_title string, forum_content string, forum_created_at string, "
        "discussion_id bigint, discussion_content string, discussion_created_at string, "
        "community_name string, commenter_name string, commenter_email string")).withColumns({
            c: F.col(c).cast("timestamp") for c in ("forum_created_at", "discussion_created_at")})
    got = {(r.interaction_id, r.content) for r in ingest.weekly_interactions(raw, 2024, 3).collect()}
    assert got == {(4, "T - B"), (6, "- B"), (5, "new & x")}
    empty = ingest.weekly_interactions(raw, 2023, 3)
    assert empty.count() == 0 and empty.columns == schema.INTERACTIONS.fieldNames()
    assert ingest.interaction_window(raw, 2021, 53).count() == 0
    assert ingest.interaction_window(raw, 2024, 4).filter("scam_scan_offset = 0").count() == 2


def test_corpus_forms(spark, tmp_path):
    def read(body):
        path = tmp_path / f"{abs(hash(body))}.json"
        path.write_text(body)
        return tables.corpus_items(tables.read_corpus(spark, str(path))).collect()
    rows = read('[{"label": "scam", "text": "a"}, {"id": "x", "category": "c"}]')
    assert [(r.id, r.expected_scam, r.category, r.text) for r in sorted(rows, key=lambda r: r.row_index)] == [
        ("item_0", True, "unknown", "a"), ("x", False, "c", "")]
    assert read('{"label": "scam"}') == [] and read("[{bad") == []
    assert tables.read_corpus(spark, str(tmp_path / "missing.json")).count() == 0


def test_failing_scorer_gives_zeros(spark):
    def scorer(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("model")
        return [{"joy": 0.5} for _ in texts]
    rows = spark.createDataFrame([(1, "fine"), (2, "boom")], "interaction_id bigint, content string")
    got = {r.interaction_id: r.joy for r in scoring.score_texts(rows, scorer).collect()}
    assert got == {1: 0.5, 2: 0.0}


ORACLE_SAMPLE = (
    "a2_rolling_window", "a13_snapshot_upsert", "b1_clean_text", "b23_text_chunks", "d1_severe_candidate",
    "d3_fraud_scan", "d8_routing", "e8_week_before", "f5_per_label_cap", "g11_global_agreement",
    "h4_master_append", "i3_training_sample", "j2_stream_weekly_health",
)


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_oracle(spark, name):
    import __spark_entry__ as entry
    folder = "/root/testdata/sf0.001"
    got = compare.rows_of(entry.queries()[name](spark, folder).toArrow())
    want = compare.connect(folder).execute(entry.oracle_sql()[name]).to_arrow_table()
    assert got == compare.rows_of(want)


def test_registry_is_complete():
    import __spark_entry__ as entry
    from checks import registry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) == set(registry.ORACLES) <= set(entry.oracle_sql())

