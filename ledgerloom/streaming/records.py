"""Evaluation records from a folder that is still being filled: counted by status and time window.

A batch run accounts for a finished record set (``operators.records``); these do the same while
it is written. Repeated records within the allowed lateness count once, later ones are dropped by
the watermark, so the state is bounded by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grade import STATUSES

RECORD = "example_id string, status string, finished timestamp, _corrupt_record string"


def read_records(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of JSON lines; a line that can't be read keeps its text in ``_corrupt_record``."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def status_counts(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, status, n) of records with an id and a time; an unknown status counts as ``invalid_output``."""
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("invalid_output")
    once = stream.where("example_id is not null and finished is not null").withWatermark("finished", late).dropDuplicatesWithinWatermark(["example_id"])
    counts = once.groupBy(F.window("finished", window).alias("w"), known.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "status", "n")
