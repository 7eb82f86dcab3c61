"""Helpers shared by the corpus operators: table access, shared storage, running offsets."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs in one process (local tests) is a temporary
    folder made and set; on a cluster a folder of its own is an error, since no other machine sees it.
    """
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


def persist_table(df: DataFrame, name: str, bucket_by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage the way ``checkpoint()`` does, with a smaller footprint, and it
    survives the loss of any executor. With ``bucket_by``, later joins on that column need no
    exchange of this table.
    """
    spark = df.sparkSession
    own = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/ledgerloom/{own}"
    writer = df.write.option("compression", "zstd")
    if bucket_by is None:
        title = None
        writer.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        title = "ledgerloom_" + own.replace("-", "_")
        writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), bucket_by).option("path", path).saveAsTable(title)
        out = spark.table(title)
    out._stored = (path, title)
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads; whatever was derived from them must have been stored by now."""
    for df in tables:
        path, title = df._stored
        spark = df.sparkSession
        if title is not None:
            spark.sql(f"DROP TABLE IF EXISTS {title}")
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of frames that are out of scope."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def utf8(col: Column | str) -> Column:
    """Text with null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def subs_for(rows: int) -> int:
    """Parts of a queue such that one part of all rows has about 100,000."""
    return max(64, rows // 100_000)


def running_start(df: DataFrame, queue: str, sub: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all earlier rows of the same ``queue``.

    The order inside a queue is (``sub``, ``order``). A task sorts one part of one queue, however hot
    the queue is; the table of the parts' sums (queues x parts) is added up apart.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("_value", value)
    sums = own.groupBy(queue, sub).agg(F.sum("_value").alias("_t"))
    base = sums.select(queue, sub, F.coalesce(F.sum("_t").over(before(Window.partitionBy(queue).orderBy(sub))), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_value").over(before(Window.partitionBy(queue, sub).orderBy(*order))), F.lit(0))
    return own.join(base, [queue, sub]).withColumn(out, (F.col("_base") + inside).cast("long")).drop("_base", "_value")
