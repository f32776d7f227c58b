"""Session settings the operators are tuned for, and shared scratch space."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

# State of streams lies in RocksDB, on disk, not in the executors' heap. hugeMethodLimit: the rule expressions are wide; methods over 8000 bytes are never compiled by
# the JVM, so Spark should fall back to split methods instead.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def builder(app: str = "hearthlight") -> SparkSession.Builder:
    out = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        out = out.config(key, value)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, from ``spark.checkpoint.dir``.

    Where none is named, only a session in one process may go on: it gets a folder in its
    warehouse, removed when Python ends. Executors elsewhere would not see each other's files.
    """
    context = spark.sparkContext
    named = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir", None)
    )
    current = context._jsc.sc().getCheckpointDir()
    if named is None and current.isEmpty():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
        own = f"{warehouse.rstrip('/')}/_stages-{uuid.uuid4().hex}"
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    elif current.isEmpty():
        context.setCheckpointDir(named)
    return named or context._jsc.sc().getCheckpointDir().get()


_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for rows that are staged between jobs; ``remove_stages`` deletes them."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove_stages(spark: SparkSession) -> None:
    """Delete all staged rows of this process; frames that read them end with it."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from there.

    The files survive lost executors. Unlike ``checkpoint()``, which computes its input a second
    time, the rows are computed once, and later scans read only the columns they need.
    """
    path = new_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
