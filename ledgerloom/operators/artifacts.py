"""Which files may be parsed: registrations by path and content, conflicts refused before anything is classed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import ensure

FIELDS = ("artifact_id", "path", "kind", "sha256")


def canonical(path: Column) -> Column:
    """A path without ``file:``, empty and ``.`` segments, ``..`` taken back (not beyond the start). Links aren't followed."""
    plain = F.regexp_replace(path, "^file:/+", "/")
    step = lambda kept, x: F.when((x == "") | (x == "."), kept).when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(F.split(plain, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(plain.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def registrations(rows: DataFrame) -> DataFrame:
    """Distinct (artifact_id, path, kind, sha256), paths canonical; a row that lacks one of them is an error, whichever columns are read."""
    lacks = reduce(lambda p, c: p | F.col(c).isNull(), FIELDS, F.lit(False))
    sound = ensure(rows, lacks, F.lit("a registration lacks artifact_id, path, kind or sha256"))
    return sound.select("artifact_id", canonical(F.col("path")).alias("path"), "kind", "sha256").distinct()


def conflicts(registered: DataFrame) -> DataFrame:
    """(field, value, n): paths and ids that ``registrations`` gives more than one meaning; the last one written never wins."""
    per = lambda field: registered.groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(field).alias("field"), "value", "n")
    return per("artifact_id").unionByName(per("path"))


def classified(files: DataFrame, registered: DataFrame) -> DataFrame:
    """(path, artifact_id, kind, state) of each row of ``files`` (path, sha256).

    ``registered`` (the only state with an id and a kind): path and content are those of one registration without a
    conflict; ``altered``: the path is registered with other content, or the content is null; ``conflicting``: the path or its id has several
    registrations; ``unregistered``: no such path, or null. Conflicts count before contents.
    """
    bad = conflicts(registered)
    marked = (
        registered.join(bad.where("field = 'artifact_id'").select(F.col("value").alias("artifact_id"), F.lit(True).alias("_by_id")), "artifact_id", "left")
        .groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_by_id").alias("_by_id"), F.min("artifact_id").alias("_id"), F.min("kind").alias("_kind"), F.min("sha256").alias("_sha256"))
    )
    state = (
        F.when(F.col("_n").isNull(), "unregistered").when((F.col("_n") > 1) | F.coalesce("_by_id", F.lit(False)), "conflicting")
        .when(F.col("sha256").eqNullSafe(F.col("_sha256")), "registered").otherwise("altered")
    )
    sound = lambda c: F.when(F.col("state") == "registered", F.col(c))
    found = files.select(canonical(F.col("path")).alias("path"), "sha256").join(marked, "path", "left").withColumn("state", state)
    return found.select("path", sound("_id").alias("artifact_id"), sound("_kind").alias("kind"), "state")


def admitted(files: DataFrame, registered: DataFrame, kinds: list[str]) -> DataFrame:
    """``classified`` files, all of which must be registered with one of ``kinds``: any other stops the job, named, before its records are parsed."""
    found = classified(files, registered)
    fine = (F.col("state") == "registered") & F.col("kind").isin(kinds)
    why = F.concat(F.lit("not admitted: "), F.coalesce("path", F.lit("null")), F.lit(" is "), F.when(F.col("state") == "registered", F.col("kind")).otherwise(F.col("state")))
    return ensure(found, ~fine | fine.isNull(), why)
