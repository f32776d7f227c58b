"""Commits, the master's index and appends, snapshots, and streams with state, against plain Spark."""

import datetime as dt
import random
import re
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlight import labels as L
from hearthlight import schema
from hearthlight.operators import training
from hearthlight.session import new_folder
from hearthlight.sources.commits import Commit, FolderTable
from hearthlight.sources.master import Master
from hearthlight.sources.sinks import Snapshots
from hearthlight.streaming import jobs as streams

ROWS = T.StructType([T.StructField("row_no", T.LongType()), T.StructField("text_hash", T.StringType())])


def hashed(spark, first, last, shift=0):
    return spark.range(first, last).select(
        (F.col("id") + shift).alias("row_no"), F.sha2(F.col("id").cast("string"), 256).alias("text_hash"))


def pairs(frame):
    return sorted(map(tuple, frame.select("row_no", "text_hash").collect()))


# --- commits ----------------------------------------------------------------------------------


def test_one_of_two_writers_gets_a_number(spark):
    table = FolderTable(spark, new_folder(spark, "commits"))
    assert table.commits() == [] and table.commit(0, Commit("a", ("rows/x",), (), {"n": 1}))
    assert not table.commit(0, Commit("b"))
    assert FolderTable(spark, table.root).commits() == [Commit("a", ("rows/x",), (), {"n": 1})]


def test_uncommitted_rows_do_not_exist_and_compaction_keeps_readers(spark):
    table = FolderTable(spark, new_folder(spark, "commits"))
    assert table.rows(ROWS).count() == 0
    for k in range(4):
        assert table.add(hashed(spark, k, k + 2), f"b{k}")
    assert not table.add(hashed(spark, 50, 60), "b2")  # sent again
    hashed(spark, 90, 99).write.parquet(f"{table.root}/rows/lost")
    old = table.rows(ROWS)
    before = pairs(old)

    def reduced(rows):
        table.add(hashed(spark, 7, 8), "meanwhile")
        return rows.dropDuplicates(["text_hash"])
    assert table.compact(ROWS, reduced)
    assert pairs(old) == before  # a reader that has begun
    assert pairs(table.rows(ROWS)) == sorted({*before, *pairs(hashed(spark, 7, 8))})
    assert len(table.live(table.commits())) == 2
    table.expire()
    assert pairs(table.rows(ROWS)) == sorted({*before, *pairs(hashed(spark, 7, 8))})


# --- master -----------------------------------------------------------------------------------


def test_appends_equal_the_rewritten_master(spark):
    master = Master(spark, new_folder(spark, "master"), ROWS)
    first = hashed(spark, 0, 500).unionByName(hashed(spark, 0, 100, 1000))
    done = master.append(first, "week 1", ["row_no"])
    assert (done.added_rows, done.total_rows, done.committed) == (500, 500, True)
    again = master.append(first, "week 1", ["row_no"])
    assert (again.added_rows, again.total_rows, again.committed) == (0, 500, False)
    files = len(master.table.commits())
    assert not master.append(hashed(spark, 0, 50), "nothing new", ["row_no"]).committed
    assert len(master.table.commits()) == files
    second = hashed(spark, 450, 800, 5000).unionByName(spark.createDataFrame([(1, None)], ROWS))
    want = training.merged_master(second.where("text_hash is not null"), master.rows(), ["row_no"])
    want = pairs(want)
    assert master.append(second, "week 2", ["row_no"]).total_rows == 800
    assert pairs(master.rows()) == want and master.total() == 800
    assert master.compact() and pairs(master.rows()) == want and master.total() == 800
    assert master.append(hashed(spark, 700, 810), "week 3", ["row_no"]).added_rows == 10
    assert not master.append(hashed(spark, 0, 0), "empty", ["row_no"]).committed


def test_two_appends_at_once_add_each_key_once(spark):
    root = new_folder(spark, "master")
    batches = {"a": hashed(spark, 0, 300), "b": hashed(spark, 200, 500, 1000), "c": hashed(spark, 100, 600, 2000)}
    errors, gate = [], threading.Barrier(len(batches))

    def run(name):
        class Slow(Master):
            def _write_index(self, *args):
                words = super()._write_index(*args)
                if not waited:
                    waited.append(gate.wait(60))
                return words
        waited = []
        try:
            Slow(spark, root, ROWS).append(batches[name], name, ["row_no"])
        except Exception as wrong:  # noqa: BLE001
            errors.append(wrong)
    threads = [threading.Thread(target=run, args=(n,)) for n in batches]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    master = Master(spark, root, ROWS)
    keys = [h for _, h in pairs(master.rows())]
    assert len(keys) == len(set(keys)) == 600 == master.total()
    assert len(master.table.commits()) == 3


def test_a_writer_that_dies_adds_nothing(spark, monkeypatch):
    master = Master(spark, new_folder(spark, "master"), ROWS)

    def die(self, number, made):
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr(FolderTable, "commit", die)
        with pytest.raises(OSError, match="lost"):
            master.append(hashed(spark, 0, 10), "week", ["row_no"])
    assert master.rows().count() == 0
    assert master.append(hashed(spark, 0, 10), "week", ["row_no"]).added_rows == 10


def test_a_small_batch_reads_a_share_of_the_index(spark):
    master = Master(spark, new_folder(spark, "master"), ROWS)
    master.append(hashed(spark, 0, 4000), "all", ["row_no"])
    names = [f.removeprefix("rows/") for f in master.table.live(master.table.commits())]
    words = master.table.commits()[0].facts["words"][names[0]]
    some = hashed(spark, 3990, 4300).select(F.col("text_hash").alias("key"))
    maybe = {r.key for r in master.maybe_known(some, names, [words]).collect()}
    held = {h for _, h in pairs(hashed(spark, 3990, 4000))}
    assert held <= maybe and len(maybe - held) < 0.05 * 300  # no key is missed, few are asked for in vain
    assert {r.key for r in master.known(some).collect()} == held
    # The anti-join reads the folders of these prefixes only.
    rows = hashed(spark, 3998, 4000)
    fresh = master.unknown_rows(rows.unionByName(hashed(spark, 9000, 9002)))
    assert pairs(fresh) == pairs(hashed(spark, 9000, 9002))
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*prefix#", plan)
    prefixes = {h[:2] for _, h in pairs(rows)}
    files = master._index("keys", "batch string, key string, prefix string", names).where(F.col("prefix").isin(sorted(prefixes)))
    assert files.select(F.input_file_name()).distinct().count() <= len(prefixes)


# --- snapshots --------------------------------------------------------------------------------


def test_snapshots_compact_to_the_newest_row_per_week(spark):
    snaps = Snapshots(spark, new_folder(spark, "snapshots"))

    def rows(k):
        at = dt.datetime(2025, 1, 1) + dt.timedelta(days=k)
        return spark.createDataFrame([(f"2025-W{w:02d}", k, w, 0, float(k), "m", at) for w in range(k, k + 3)], schema.SNAPSHOT)
    for k in range(1, 5):
        assert snaps.append(rows(k), f"run {k}") and not snaps.append(rows(k + 9), f"run {k}")
    want = sorted(map(tuple, snaps.read().collect()))
    assert len(want) == 6 and {r[1] for r in want if r[0] == "2025-W04"} == {4}
    assert snaps.compact() and sorted(map(tuple, snaps.read().collect())) == want
    assert snaps.table.rows(schema.SNAPSHOT).count() == 6


# --- streams ----------------------------------------------------------------------------------


def drive(writer, progress):
    query = writer.option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert not query.isActive
    return query


def versions(n):
    rng = random.Random(n)
    start = dt.datetime(2025, 1, 1)
    out = []
    for k in range(n):
        at = None if k % 41 == 0 else start + dt.timedelta(hours=rng.randrange(400))
        out.append((k, rng.randrange(30), at, f"version {k}"))
    return out + out[:20]  # some come twice


COMMENTS = T.StructType([
    T.StructField("interaction_id", T.LongType()), T.StructField("discussion_id", T.LongType()),
    T.StructField("discussion_created_at", T.TimestampType()), T.StructField("content", T.StringType()),
])


def test_keyed_state_equals_the_batch_result(spark):
    source, out, progress = (new_folder(spark, n) for n in ("source", "latest", "progress"))
    rows = spark.createDataFrame(versions(400), COMMENTS)
    table = FolderTable(spark, out)

    def stream():
        return spark.readStream.schema(COMMENTS).option("maxFilesPerTrigger", 1).parquet(source)
    for part in range(3):
        rows.where(F.col("interaction_id") % 3 == part).coalesce(2).write.mode("append").parquet(source)
        query = drive(streams.keep_latest(stream(), out), progress)  # the run before was stopped
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 30
    want = sorted(map(tuple, streams.read_latest(rows).collect()))
    assert sorted(map(tuple, streams.latest_discussions(table, COMMENTS).collect())) == want
    written = table.rows(COMMENTS).count()
    assert written < rows.count() / 2  # versions that change nothing are not written
    assert streams.compact_latest(table, COMMENTS)
    assert sorted(map(tuple, table.rows(COMMENTS).collect())) == want


def test_state_holds_live_discussions_only(spark):
    source, out, progress = (new_folder(spark, n) for n in ("source", "latest", "progress"))
    stamp = T.StructType([*COMMENTS.fields, T.StructField("came", T.TimestampType())])
    start = dt.datetime(2025, 1, 1)
    states = []
    for day in range(4):
        rows = [(day * 100 + d, day * 100 + d, start, "x", start + dt.timedelta(days=10 * day)) for d in range(20)]
        spark.createDataFrame(rows, stamp).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(stamp).parquet(source)
        query = drive(streams.keep_latest(stream, out, "15 days", F.col("came")), progress)
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert states == [20, 40, 40, 40]  # 80 discussions, of which those of 15 days are held
    assert FolderTable(spark, out).rows(stamp).count() == 80


def scored_rows(spark, n):
    rng = random.Random(n)
    start = dt.datetime(2024, 12, 20)
    rows = [(start + dt.timedelta(hours=rng.randrange(24 * 60)), *[rng.randrange(100) / 128 for _ in L.LABELS]) for _ in range(n)]
    return spark.createDataFrame(rows, "activity_date timestamp, " + ", ".join(f"{x} double" for x in L.LABELS))


def weekly(frame):
    return sorted((r.week_key, r.interactions, round(r.health_score, 2)) for r in frame.collect())


def test_weeks_in_event_time_lose_nothing(spark):
    source, cells, snaps, progress = (new_folder(spark, n) for n in ("source", "cells", "snaps", "progress"))
    rows = scored_rows(spark, 600).withColumn("week", F.weekofyear("activity_date"))
    parts = [rows.where(c).drop("week") for c in ("week between 1 and 6", "week > 50", "week between 7 and 20")]
    for part in parts:  # newest first: the second part lies weeks before the first
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(source)
        drive(streams.upsert_weeks(stream, cells, snaps, "m", span="1 second"), progress)
        time.sleep(1.1)
    want = weekly(streams.read_weekly(streams.weekly_sums(rows)))
    log = FolderTable(spark, cells)
    assert weekly(streams.read_weekly(streams.newest_cells(log.rows(streams.CELLS)))) == want
    snapshots = Snapshots(spark, snaps).read().collect()
    assert sorted((r.week_key, r.comment_count, round(r.score, 2)) for r in snapshots) == want
    assert streams.compact_cells(log) and weekly(streams.read_weekly(log.rows(streams.CELLS))) == want
    other = streams.upsert_weeks(
        spark.readStream.schema(part.schema).parquet(source), cells, snaps, "m").option(
        "checkpointLocation", new_folder(spark, "other")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="another checkpoint folder"):
        other.awaitTermination(180)


# --- buckets ----------------------------------------------------------------------------------


def test_a_cascade_over_buckets_shuffles_nothing(spark):
    from checks.rules_checks import routed
    from checks.views import BucketedViews, Views
    from hearthlight.sources import buckets

    views = Views(spark, "/root/testdata/sf0.001")
    stored = BucketedViews(views, ("interactions", "scores", "verdicts", "accounts"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, dealt = routed(views), routed(stored).join(stored.scores.select("interaction_id", "joy"), "interaction_id")
        plans = [f._jdf.queryExecution().executedPlan().toString() for f in (plain, dealt)]
        assert "Exchange" in plans[0] and "Exchange" not in plans[1] and plans[1].count("SortMergeJoin") >= 3
        ids = [sorted(r.interaction_id for r in f.select("interaction_id").collect()) for f in (plain, dealt)]
        assert ids[0] == ids[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    folder = new_folder(spark, "again")
    rows = buckets.store(hashed(spark, 0, 50), "first_name", folder, 3, "row_no")
    again = buckets.reopen(spark, "row_no bigint, text_hash string", "second_name", folder, 3, "row_no")
    assert pairs(rows) == pairs(again) == pairs(hashed(spark, 0, 50))
