"""Structured Streaming forms of the scan, the weekly health and the dedup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hearthlight import labels as L
from hearthlight.functions import weeks
from hearthlight.operators import fraud
from hearthlight.operators.dedup import keep_first
from hearthlight.operators.metrics import health_score
from hearthlight.sources.commits import FolderTable
from hearthlight.sources.sinks import Snapshots


def flag_stream(interactions: DataFrame, staff: fraud.StaffPolicy = fraud.StaffPolicy()
                ) -> DataFrame:
    """First-tier flags on a stream of interactions; stateless, append mode."""
    return fraud.candidates(interactions, staff)


def weekly_sums(scored: DataFrame, ts: str = "activity_date") -> DataFrame:
    """Rows and label sums per week (its Monday), to be added up later."""
    return scored.groupBy(weeks.monday_of(ts).alias("monday")).agg(
        F.count(F.lit(1)).alias("interactions"),
        *[F.sum(label).alias(f"sum_{label}") for label in L.LABELS],
        *[F.count(label).alias(f"n_{label}") for label in L.LABELS],
    )


def log_weekly(scored: DataFrame, path: str, ts: str = "activity_date") -> DataStreamWriter:
    """Append each batch's sums per week to a log.

    Weeks are added up by the reader, so rows may come in any order and as late as they like:
    there is no state to expire and no watermark to drop rows. Rewriting a batch after a failure
    replaces only that batch's folder, so a retry leaves no duplicates.
    """
    def write(batch: DataFrame, number: int) -> None:
        weekly_sums(batch, ts).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scored.writeStream.outputMode("append").foreachBatch(write)


def read_weekly(log: DataFrame) -> DataFrame:
    """Mean profile and health per ISO week over all batches so far."""
    sums = log.groupBy("monday").agg(
        F.sum("interactions").alias("interactions"),
        *[(F.sum(f"sum_{x}") / F.sum(f"n_{x}")).alias(x) for x in L.LABELS],
    )
    return sums.select(
        "monday", weeks.week_key("monday").alias("week_key"), "interactions",
        health_score().alias("health_score"),
    )


def latest_comments(comments: DataFrame, path: str) -> DataStreamWriter:
    """Keep the latest version of each discussion from a stream of comments.

    Each batch is reduced to its latest rows and appended; ``read_latest`` reduces the log.
    Dropping duplicates inside the stream would keep the first version, not the last.
    """
    def write(batch: DataFrame, number: int) -> None:
        newest = keep_first(batch, ["discussion_id"], _newest())
        newest.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(
            f"{path}/batch={number}")

    return comments.writeStream.outputMode("append").foreachBatch(write)


def _newest():
    return [F.desc("discussion_created_at"), F.desc("interaction_id")]


def read_latest(log: DataFrame) -> DataFrame:
    return keep_first(log, ["discussion_id"], _newest())


# --- state kept by Spark ----------------------------------------------------------------------
#
# A watermark on event time would drop what comes later than it allows. These jobs put the watermark
# on the time of arrival, which never goes back: no row is late, and state still expires.

ARRIVED = "arrived_at"


def _arriving(rows: DataFrame, arrived: Column | None) -> DataFrame:
    """Rows with the time they came at: a column of the source, or else the batch's time."""
    at = F.current_timestamp() if arrived is None else arrived
    return rows.withColumn(ARRIVED, at.cast("timestamp")).withWatermark(ARRIVED, "0 seconds")


def _run_of(batch: DataFrame) -> str:
    """The same for all runs from one checkpoint folder."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def weekly_cells(scored: DataFrame, ts: str = "activity_date", arrived: Column | None = None,
                 span: str = "1 day") -> DataFrame:
    """Running sums per ISO week of the event and ``span`` of arrival, in update mode.

    Weeks are windows of event time, four days after the epoch's Thursday. A row that comes months
    after its week makes a cell of its own, beside those of its week that are closed: state holds
    the cells of the spans that still arrive, and nothing is dropped.
    """
    week = F.window(ts, "7 days", "7 days", "4 days")
    rows = _arriving(scored, arrived).withColumn("week", week)
    return rows.groupBy(F.col("week.start").cast("date").alias("monday"),
                        F.window(ARRIVED, span).alias("arrival")).agg(
        F.count(F.lit(1)).alias("interactions"),
        *[F.sum(label).alias(f"sum_{label}") for label in L.LABELS],
        *[F.count(label).alias(f"n_{label}") for label in L.LABELS],
    ).select("monday", F.col("arrival.start").alias("arrival"), "interactions",
             *[f"{kind}_{label}" for kind in ("sum", "n") for label in L.LABELS])


CELLS = T.StructType([
    T.StructField("monday", T.DateType()), T.StructField("arrival", T.TimestampType()),
    T.StructField("interactions", T.LongType()),
    *[T.StructField(f"sum_{label}", T.DoubleType()) for label in L.LABELS],
    *[T.StructField(f"n_{label}", T.LongType()) for label in L.LABELS],
    T.StructField("batch", T.LongType()),
])


def newest_cells(log: DataFrame) -> DataFrame:
    """A cell's sums as the last batch has left them."""
    return keep_first(log, ["monday", "arrival"], [F.desc("batch")])


def upsert_weeks(scored: DataFrame, cells: str, snapshots: str, model_id: str,
                 ts: str = "activity_date", arrived: Column | None = None, span: str = "1 day"
                 ) -> DataStreamWriter:
    """Keep the weekly snapshots up to date from a stream of scored rows.

    Each batch commits the cells it has changed, then the totals of their weeks. Both commits bear the
    batch's number, so a batch that is run again changes nothing. Sums of another checkpoint
    folder would count rows twice: a log that has some is refused.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark, run = batch.sparkSession, _run_of(batch)
        log, weekly = FolderTable(spark, cells), Snapshots(spark, snapshots)
        if any(c.name != "compact" and not c.name.startswith(f"{run}:") for c in log.commits()):
            raise ValueError(f"{cells} holds sums of another checkpoint folder")
        name = f"{run}:{number}"
        log.add(batch.withColumn("batch", F.lit(number).cast("long")), name)
        every = newest_cells(log.rows(CELLS))
        changed = log.rows(CELLS).where(F.col("batch") == number).select("monday").distinct()
        totals = read_weekly(every.join(changed, "monday", "left_semi"))
        weekly.append(totals.select(
            "week_key", F.lit(None).cast("long").alias("severe_count"),
            F.lit(None).cast("long").alias("scam_count"),
            F.col("interactions").alias("comment_count"), F.col("health_score").alias("score"),
            F.lit(model_id).alias("model_id"), F.current_timestamp().alias("updated_at"),
        ), name)

    return weekly_cells(scored, ts, arrived, span).writeStream.outputMode("update").foreachBatch(write)


def compact_cells(cells: FolderTable) -> bool:
    return cells.compact(CELLS, newest_cells)


def changed_discussions(comments: DataFrame, idle: str = "30 days", arrived: Column | None = None
                        ) -> DataFrame:
    """A discussion's version whenever a newer one than any before comes; update mode.

    State is a time and an id per discussion, for as long as versions of it come at least once in
    ``idle``. Where an older version comes after that, it is emitted again, and the reader keeps the
    newest one all the same.
    """
    names = comments.columns
    millis = int(pd.Timedelta(idle) / pd.Timedelta("1ms"))

    def newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = tuple(state.get) if state.exists else None
        best, found, came = before, None, 0
        for frame in frames:
            came = max(came, int(frame[ARRIVED].max().value // 1_000_000))
            times = frame["discussion_created_at"]
            micros = times.astype("datetime64[us]").astype("int64").where(times.notna(), -(1 << 63))
            last = pd.DataFrame({"t": micros, "i": frame["interaction_id"]}).sort_values(["t", "i"]).index[-1]
            version = (int(micros[last]), int(frame["interaction_id"][last]))
            if best is None or version > best:
                best, found = version, frame.loc[[last], names]
        if found is not None:
            state.update(best)
            yield found
        state.setTimeoutTimestamp(came + millis)

    return _arriving(comments, arrived).groupBy("discussion_id").applyInPandasWithState(
        newest, comments.schema, "micros long, id long", "update", GroupStateTimeout.EventTimeTimeout
    )


def keep_latest(comments: DataFrame, path: str, idle: str = "30 days", arrived: Column | None = None
                ) -> DataStreamWriter:
    """Commit the changed discussions of each batch; a batch that is run again changes nothing."""
    def write(batch: DataFrame, number: int) -> None:
        FolderTable(batch.sparkSession, path).add(batch, f"{_run_of(batch)}:{number}")

    return changed_discussions(comments, idle, arrived).writeStream.outputMode("update").foreachBatch(write)


def latest_discussions(table: FolderTable, schema: T.StructType) -> DataFrame:
    return read_latest(table.rows(schema))


def compact_latest(table: FolderTable, schema: T.StructType) -> bool:
    return table.compact(schema, read_latest)
