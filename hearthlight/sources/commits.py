"""Tables made of folders, with numbered commit files that say which folders count.

A commit file is written under a name of its own and renamed to the next number; a rename never
replaces a file, so of two writers one fails and looks again at what the other has added. Readers go
by the commit files they see, so rows of a writer that died, or has not committed yet, do not exist,
and a reader sees a table before or after a commit, never in between. Needs a store whose renames are
atomic and refuse an existing target.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Commit:
    """``added`` folders count from here on, ``dropped`` ones no more. ``name`` is the writer's own
    (a batch), ``facts`` what it wants to keep."""

    name: str
    added: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()
    facts: dict = field(default_factory=dict)


class FolderTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._seen: list[Commit] = []

    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}")

    def commits(self) -> list[Commit]:
        """All commits so far, in order; those read before are remembered, as they never change."""
        while True:
            path = self._path(f"commits/{len(self._seen):010d}.json")
            store = path.getFileSystem(self._conf)
            if not store.exists(path):
                return list(self._seen)
            stream = store.open(path)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            raw = json.loads(text)
            self._seen.append(Commit(raw["name"], tuple(raw["added"]), tuple(raw["dropped"]), raw["facts"]))

    def commit(self, number: int, made: Commit) -> bool:
        """Whether this became commit ``number``; False if another writer was first."""
        text = json.dumps({"name": made.name, "added": made.added, "dropped": made.dropped, "facts": made.facts})
        own, target = self._path(f"commits/_{uuid.uuid4().hex}"), self._path(f"commits/{number:010d}.json")
        stream = own.getFileSystem(self._conf).create(own)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._fs.FileContext.getFileContext(own.getFileSystem(self._conf).makeQualified(own).toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            context.rename(own, target, options)
        except Py4JJavaError as failed:
            own.getFileSystem(self._conf).delete(own, False)
            if "FileAlreadyExists" in failed.java_exception.getClass().getName():
                return False
            raise
        return True

    @staticmethod
    def live(commits: list[Commit]) -> list[str]:
        folders: dict[str, None] = {}
        for c in commits:
            for name in c.dropped:
                folders.pop(name, None)
            folders.update(dict.fromkeys(c.added))
        return list(folders)

    def new_folder(self, kind: str) -> str:
        return f"{kind}/{uuid.uuid4().hex}"

    def read(self, folders: list[str], schema) -> DataFrame:
        """Rows of folders; without any, none."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def remove(self, folder: str) -> None:
        path = self._path(folder)
        path.getFileSystem(self._conf).delete(path, True)

    def add(self, rows: DataFrame, name: str, facts: dict | None = None, attempts: int = 100) -> bool:
        """Writes rows and commits them under ``name``; False if that name is committed already."""
        if any(c.name == name for c in self.commits()):
            return False
        folder = self.new_folder("rows")
        rows.write.parquet(f"{self.root}/{folder}")
        for _ in range(attempts):
            seen = self.commits()
            if any(c.name == name for c in seen):
                self.remove(folder)
                return False
            if self.commit(len(seen), Commit(name, (folder,), (), facts or {})):
                return True
        raise RuntimeError("other writers were faster each time")

    def rows(self, schema) -> DataFrame:
        return self.read(self.live(self.commits()), schema)

    def compact(self, schema, reduced: Callable[[DataFrame], DataFrame], attempts: int = 100) -> bool:
        """Replaces the live folders by one with ``reduced`` rows. Folders that others add meanwhile
        stay; the old ones are left to readers that have begun, and ``expire`` removes them."""
        old = self.live(self.commits())
        if len(old) < 2:
            return False
        folder = self.new_folder("rows")
        reduced(self.read(old, schema)).write.parquet(f"{self.root}/{folder}")
        for _ in range(attempts):
            seen = self.commits()
            if not set(old) <= set(self.live(seen)):  # another one has compacted them
                self.remove(folder)
                return False
            if self.commit(len(seen), Commit("compact", (folder,), tuple(old))):
                return True
        raise RuntimeError("other writers were faster each time")

    def expire(self) -> None:
        """Removes folders that no longer count. No reader may have begun before they were dropped."""
        seen = self.commits()
        for name in {f for c in seen for f in c.added} - set(self.live(seen)):
            self.remove(name)
