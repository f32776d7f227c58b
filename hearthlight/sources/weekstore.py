"""Stored weeks of cleaned, deduplicated interactions, so that long histories read each raw week once.

A refresh writes whole weeks in one commit; a week counts as its last refresh has left it, whether
that has rows or none. A week that is read again replaces itself, late rows included, and readers
see it before or after.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlight import schema
from hearthlight.functions import weeks
from hearthlight.operators.texts import Read
from hearthlight.sources.commits import Commit, FolderTable
from hearthlight.sources.interactions import interaction_window


def _mondays(year: int, week: int, n: int) -> list[str]:
    anchor, _ = weeks.week_bounds(year, week)
    return [str(anchor - dt.timedelta(weeks=k)) for k in range(n - 1, -1, -1)]


class WeekStore:
    def __init__(self, spark: SparkSession, path: str):
        self.table = FolderTable(spark, path)

    def _folders(self) -> dict[str, str | None]:
        """The folder of each stored week; None for a week without rows."""
        out: dict[str, str | None] = {}
        for c in self.table.commits():
            filled = set(c.facts["filled"])
            out.update({w: f"{c.added[0]}/monday={w}" if w in filled else None for w in c.facts["weeks"]})
        return out

    def refresh(self, raw: DataFrame, year: int, week: int, n: int = 1, read: Read | None = None) -> None:
        """Reads the week, and the ``n`` - 1 before it, from the raw table and replaces what is stored. For ``read``
        see ``interaction_window``."""
        folder, mondays = self.table.new_folder("rows"), _mondays(year, week, n)
        rows = interaction_window(raw, year, week, n, read).select(*schema.INTERACTIONS.fieldNames())
        path = f"{self.table.root}/{folder}"
        monday = weeks.monday_of("activity_date").cast("string")
        rows.withColumn("monday", monday).write.partitionBy("monday").option("compression", "zstd").parquet(path)
        kept = rows.schema.add("monday", "string")
        stored = self.table.spark.read.schema(kept).parquet(path)
        filled = sorted(r.monday for r in stored.select("monday").distinct().collect())  # at most n
        facts = {"weeks": mondays, "filled": filled}
        while not self.table.commit(len(self.table.commits()), Commit(f"{year}-{week}-{n}", (folder,), (), facts)):
            pass

    def catch_up(self, raw: DataFrame, year: int, week: int, n: int, read: Read | None = None) -> list[str]:
        """Reads the newest week, and all others of ``n`` that are not stored yet. Returns them."""
        have, wanted = self._folders(), _mondays(year, week, n)
        missing = [m for m in wanted if m not in have or m == wanted[-1]]
        runs: list[list[dt.date]] = []
        for monday in map(dt.date.fromisoformat, missing):
            if runs and monday - runs[-1][-1] == dt.timedelta(weeks=1):
                runs[-1].append(monday)
            else:
                runs.append([monday])
        for run in runs:
            year, week, _ = run[-1].isocalendar()
            self.refresh(raw, year, week, len(run), read)
        return missing

    def history(self, year: int, week: int, n: int) -> DataFrame:
        """The week and those before it, with label and offset. A week that was never read raises."""
        have, wanted = self._folders(), _mondays(year, week, n)
        missing = [m for m in wanted if m not in have]
        if missing:
            raise ValueError(f"weeks not stored: {', '.join(missing)}")
        rows = self.table.read([have[m] for m in wanted if have[m]], schema.INTERACTIONS)
        anchor = F.lit(wanted[-1]).cast("date")
        return rows.withColumns({
            "scam_scan_week": weeks.week_label("activity_date"),
            "scam_scan_offset": (F.datediff(anchor, weeks.monday_of("activity_date")) / 7).cast("int"),
        }).select(*schema.WINDOW_INTERACTIONS.fieldNames())
