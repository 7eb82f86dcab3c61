"""Tables between the steps of an iterative job: written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session that names none gets a temporary folder, on a cluster that is an error."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(f"file://{own}")
        found = sc.getCheckpointDir()
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: the lineage ends here, and no executor's loss takes it away."""
    path = f"{shared_folder(df.sparkSession)}/ledgerloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def once(df: DataFrame, name: str) -> DataFrame:
    """The table itself if it is a stored one, else ``stored``: for what several plans read."""
    return df if hasattr(df, "_path") else stored(df, name)


#: Rows that one task should aggregate or sort.
ROWS_A_TASK = 500_000


@contextmanager
def tasks_for(spark: SparkSession, rows: int):
    """What is written meanwhile is read and shuffled by as many tasks as ``rows`` ask for, so that a task's memory doesn't grow with the input; never by fewer than the session's.

    Lists are gathered by hashing up to that many keys a task, where Spark else sorts from 128 on.
    """
    shuffles = "spark.sql.shuffle.partitions"
    parts = max(int(spark.conf.get(shuffles)), -(-rows // ROWS_A_TASK))
    asked = {shuffles: parts, "spark.sql.files.minPartitionNum": parts, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": ROWS_A_TASK}
    before = {k: spark.conf.get(k, None) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key over some tasks for every core: a small file is one task's work however much its rows take."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def drop_stored(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
