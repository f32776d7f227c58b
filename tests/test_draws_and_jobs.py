"""Draws without a full sort, streams without loss, the weekly job, and the master's round trip."""

import pytest
from pyspark.sql import functions as F

from checks.inputs import STAFF
from checks.views import Views
from hearthlight import schema
from hearthlight import session
from hearthlight.operators import metrics, sampling, training
from hearthlight.operators.dedup import top_per_group
from hearthlight.plans import jobs
from hearthlight.session import new_folder
from hearthlight.sources import sinks, tables
from hearthlight.streaming import jobs as streams

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 7, 100, 299, 300, 1000])
@pytest.mark.parametrize("digits", [1, 2])
def test_first_drawn(spark, n, digits):
    keys = spark.range(300).select("id", sampling.sample_key("id").alias("_draw"))
    want = [r.id for r in keys.orderBy("_draw", "id").limit(n).collect()]
    assert [r.id for r in sampling.first_drawn(keys, n, "id", digits).collect()] == want


def test_draw_orders_a_filtered_slice_only(spark):
    keys = spark.range(1000).select("id", sampling.sample_key("id").alias("_draw"))
    plan = sampling.first_drawn(keys, 5, "id")._jdf.queryExecution().executedPlan().toString()
    ordered = plan[plan.index("TakeOrderedAndProject"):]
    assert "Filter" in ordered.split("Range")[0]


def test_uniform_sample_of_an_empty_frame(spark):
    assert sampling.uniform_sample(spark.range(0), 5, "id").count() == 0


def test_bucket_targets_follow_the_table(spark):
    totals = spark.range(1, 120).select(F.col("id").alias("total"))
    table = {}
    for r in sampling.bucket_target_table(totals, "total").collect():
        table.setdefault(r.total, {})[r.bucket] = r.target
    assert all(sampling.bucket_targets(t) == row for t, row in table.items())


def test_hot_group_is_ranked_in_slices(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), "id")
    top = top_per_group(rows, ["g"], ["id"], 4, salt_on="id")
    assert sorted(r.id for r in top.collect()) == list(range(12))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number") >= 2 and "_salt" in plan


def test_weekly_stream_equals_batch_in_any_order(spark):
    v = Views(spark, FOLDER)
    rows = v.interactions.select("interaction_id", F.col("activity_date").cast("timestamp").alias("activity_date")).join(
        v.scores, "interaction_id").withColumn("week", F.weekofyear("activity_date"))
    path, log = new_folder(spark, "late"), new_folder(spark, "weekly")
    for week in sorted((r.week for r in rows.select("week").distinct().collect()), reverse=True):
        rows.filter(F.col("week") == week).coalesce(1).write.mode("append").parquet(path)
    frame = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = streams.log_weekly(frame, log).option("checkpointLocation", new_folder(spark, "progress")).trigger(
        availableNow=True).start()
    query.awaitTermination()
    got = {r.monday: (r.interactions, r.health_score) for r in streams.read_weekly(spark.read.parquet(log)).collect()}
    from hearthlight.functions.weeks import monday_of
    dated = rows.withColumn("monday", monday_of("activity_date"))
    counts = {r.monday: r["count"] for r in dated.groupBy("monday").count().collect()}
    want = {r.monday: (counts[r.monday], r.health_score) for r in metrics.weekly_health(dated, ["monday"]).collect()}
    assert got == want and len(want) > 2


def test_weekly_job_shows_kept_rows_only(spark):
    v = Views(spark, FOLDER)
    both = v.scores.withColumn("interaction_id", F.explode(F.array(F.col("interaction_id") * 2, F.col("interaction_id") * 2 + 1)))
    verdicts = v.verdicts.withColumn("interaction_id", F.explode(F.array(F.col("interaction_id") * 2, F.col("interaction_id") * 2 + 1)))
    week = jobs.weekly_analysis(v.forum, both, verdicts, 2024, 4, staff=STAFF)
    severe = week.severe.select("interaction_id", "is_concerning").collect()
    assert severe and all(r.is_concerning for r in severe)
    summary = week.summary.collect()
    assert [r.week_key for r in summary] == ["2024-W04"]
    assert summary[0].interactions == week.interactions.count()
    short = jobs.weekly_analysis(v.forum, both, verdicts, 2024, 4, window_weeks=1, staff=STAFF).summary.first()
    assert short.delta == summary[0].delta is not None


def test_benchmark_job_flags_as_the_single_rules(spark):
    rows = [("1", "scam", "c", "send a gift card to claim the prize http://bit.ly/x", "s", ""), (None, None, None, "hello", None, None)]
    corpus = spark.createDataFrame(rows, schema.CORPUS).withColumn("row_index", F.monotonically_increasing_id())
    report = jobs.benchmark(corpus)
    assert report.tier1.first().total == 2 and report.cascade is None
    plan = report.categories._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan.lower()  # texts were scanned once, before


def _teacher_batch(spark):
    values = {"content": "a text, with \"quotes\"\nand lines", "labels": "joy", "text_hash": None, "sampler_bucket": "uncertain",
              "activity_type": "Comment", "community_name": None, "commenter_name": "m", "student_primary_emotion": "joy",
              "entropy": 1.5, "student_primary_score": 0.25, "student_negative_sum": 0.5, "student_false_positive_signal": 0.75,
              "rare_hint_emotions": ["grief"], "valid": True}
    from hearthlight.labels import LABELS
    row = spark.range(1).select(*[
        (F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)).alias(k) for k, x in values.items()
    ], *[F.lit(i / 100).alias(e) for i, e in enumerate(LABELS)])
    return training.teacher_training_rows(row.withColumn("text_hash", F.lit(None).cast("string")))


def test_master_round_trip(spark):
    batch = tables.full_master(_teacher_batch(spark))
    path = new_folder(spark, "master")
    sinks.write_csv(batch.select(*reversed(batch.columns)), path)  # any column order
    back = tables.read_master(spark, path)
    assert back.columns == schema.MASTER.fieldNames()
    row, sent = back.first(), tables.with_missing_hash(batch).first()
    assert row.text_hash and row.text_hash == sent.text_hash
    assert {k: v for k, v in row.asDict().items() if v is not None and v != ""} == {
        k: v for k, v in sent.asDict().items() if v is not None and v != ""}
    assert training.rows_to_append(tables.with_missing_hash(batch), back, ["text"]).count() == 0


def test_master_without_hash_column(spark):
    path = new_folder(spark, "master")
    sinks.write_csv(spark.createDataFrame([("other text here", 0.5)], "text string, sadness double"), path)
    row = tables.read_master(spark, path).first()
    assert row.sadness == 0.5 and row.anger is None and len(row.text_hash) > 10


def test_generation_stats(spark):
    rows = spark.createDataFrame([(True,), (False,), (True,)], "valid boolean")
    assert tuple(training.generation_stats(rows).first()) == (3, 2, 1)


def test_staged_rows_can_be_removed(spark, tmp_path):
    path = new_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    made = list(session._made)
    session._made[:] = [path]
    session.remove_stages(spark)
    assert not session._made
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    session._made[:] = [m for m in made if m != path]


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Empty:
        def isEmpty(self):  # noqa: N802
            return True

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Empty()})()})()

        def getConf(self):  # noqa: N802
            return {}

    fake = type("Session", (), {"sparkContext": Context(), "conf": {}})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake)



def test_the_interactions_view_is_spread_over_the_cores(spark):
    rows = Views(spark, "/root/testdata/sf0.1").interactions.select("content")
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) >= spark.sparkContext.defaultParallelism / 2 and max(counts) < sum(counts) / 4
