"""Versions of a table under one folder: pinned by a tree of digests, put in place by a manifest.

*Pins* are the distinct rows' digests with their keys and counts. Rows are dealt to parts by the leading
hexadecimal digits of their digest, so parts are even whatever the keys are and copies of a row are one entry. A
part's digest is over its sorted entries, a node's over its (at most 16) children, the root's stands
for the table whatever its order and files are. Two tables are compared from the root down: only parts
whose digests differ are read further, and in those only rows that differ remain.

A version is published by writing data, pins and tree under names of their own and then one small manifest with its
own digest. Nothing is renamed or overwritten: whoever reads takes the greatest version whose manifest is
whole, so a publish that dies anywhere leaves the version before it, also in stores without a rename. Of two publishers of
one version number the second gets an error.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Distinct rows in a part, on average at most.
LEAF = 4096
_TREE = "level int, part string, n_rows long, digest string"


def row_pins(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_sha256, n_rows) of the distinct rows; the digest is over all columns by name, nulls included."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    return df.select(*keys, F.sha2(whole, 256).alias("row_sha256")).groupBy(*keys, "row_sha256").agg(F.count(F.lit(1)).alias("n_rows"))


def depth_for(distinct: int, leaf: int = LEAF) -> int:
    """Digits after which parts hold ``leaf`` rows."""
    depth = 0
    while 16**depth * leaf < distinct:
        depth += 1
    return depth


def write_tree(pins: DataFrame, depth: int, path: str) -> None:
    """Write the levels of the tree over ``pins`` to ``path``, each from the one below as it was written."""
    entry = F.concat_ws(":", "row_sha256", F.col("n_rows").cast("string"))
    level = pins.groupBy(F.substring("row_sha256", 1, depth).alias("part")).agg(F.sum("n_rows").alias("n_rows"), F.array_sort(F.collect_list(entry)).alias("own"))
    for at in range(depth, -1, -1):
        level.select("part", "n_rows", F.sha2(F.array_join("own", ","), 256).alias("digest")).write.parquet(f"{path}/level={at}")
        below = pins.sparkSession.read.schema("part string, n_rows long, digest string").parquet(f"{path}/level={at}")
        level = below.groupBy(F.substring("part", 1, at - 1).alias("part")).agg(F.sum("n_rows").alias("n_rows"), F.array_sort(F.collect_list(F.concat_ws(":", "part", "digest"))).alias("own"))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_TREE).parquet(path)


def differing_parts(before: DataFrame, now: DataFrame, depth: int) -> DataFrame:
    """(part) of the lowest level whose digests differ; below a node that agrees nothing is compared."""
    found = None
    for at in range(depth + 1):
        a, b = (t.where(F.col("level") == at).select("part", "digest") for t in (before, now))
        if found is not None:
            a, b = (t.withColumn("up", F.substring("part", 1, at - 1)).join(found.withColumnRenamed("part", "up"), "up", "left_semi").drop("up") for t in (a, b))
        both = a.join(b.withColumnRenamed("digest", "digest_now"), "part", "full")
        found = both.where(~F.col("digest").eqNullSafe(F.col("digest_now"))).select("part")
    return found


def located(before: DataFrame, now: DataFrame, keys: list[str], parts: DataFrame | None = None, depth: int = 0) -> DataFrame:
    """(keys, change, n_lost, n_gained) from the pins of two tables; only rows of ``parts`` are looked at, if given.

    ``changed``: rows of the key went and others came; ``lost``: rows or copies went; ``doubled``: only copies of
    rows that stood there came; ``added``: new rows came. Null keys are keys of their own.
    """
    if parts is not None:
        before, now = (t.withColumn("part", F.substring("row_sha256", 1, depth)).join(parts, "part", "left_semi").drop("part") for t in (before, now))
    signed = before.withColumn("n_now", F.lit(0).cast("long")).unionByName(now.withColumnsRenamed({"n_rows": "n_now"}).withColumn("n_rows", F.lit(0).cast("long")))
    rows = signed.groupBy(*keys, "row_sha256").agg(F.sum("n_rows").alias("was"), F.sum("n_now").alias("is")).where(F.col("was") != F.col("is"))
    n = lambda c: F.sum(F.greatest(c, F.lit(0).cast("long")))
    per = rows.groupBy(*keys).agg(n(F.col("was") - F.col("is")).alias("n_lost"), n(F.col("is") - F.col("was")).alias("n_gained"), F.bool_or(F.col("was") == 0).alias("_new"))
    change = F.when((F.col("n_lost") > 0) & (F.col("n_gained") > 0), "changed").when(F.col("n_lost") > 0, "lost").when(F.col("_new"), "added").otherwise("doubled")
    return per.select(*keys, change.alias("change"), "n_lost", "n_gained")


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Version numbers that were begun, whole or not, the latest first."""
    target, fs = _files(spark, f"{path}/_versions")
    if not fs.exists(target):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    return sorted((int(n) for n in names if n.isdigit()), reverse=True)


def _manifest(spark: SparkSession, path: str, number: int) -> dict | None:
    """The manifest of a version; None if it isn't whole."""
    target, fs = _files(spark, f"{path}/_versions/{number:010}")
    stream = fs.open(target)
    try:
        body, _, digest = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").partition("\n")
    finally:
        stream.close()
    return json.loads(body) if hashlib.sha256(body.encode()).hexdigest() == digest.strip() else None


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version, or of the latest whole one."""
    for number in _numbers(spark, path) if version is None else [version]:
        got = _manifest(spark, path, number) if version is None or version in _numbers(spark, path) else None
        if got is not None:
            return got
    raise FileNotFoundError(f"no version {'' if version is None else version} under {path}")


def publish_version(df: DataFrame, path: str, keys: list[str], gates: tuple = (), note: dict | None = None, leaf: int = LEAF) -> dict:
    """Add a version and return its manifest; a gate (name, function of the reread frame -> bool) that fails leaves all as it was.

    What is pinned is what was stored, not what ``df`` would give if it ran again.
    """
    spark, own = df.sparkSession, uuid.uuid4().hex
    number = max(_numbers(spark, path), default=0) + 1
    names = {kind: f"{kind}-{own}" for kind in ("data", "pins", "tree")}
    df.write.parquet(f"{path}/{names['data']}")
    again = spark.read.schema(df.schema).parquet(f"{path}/{names['data']}")
    failed = [name for name, check in gates if not check(again)]
    if failed:
        target, fs = _files(spark, f"{path}/{names['data']}")
        fs.delete(target, True)
        raise ValueError(f"gates failed: {', '.join(failed)}")
    row_pins(again, keys).repartitionByRange("row_sha256").sortWithinPartitions("row_sha256").write.parquet(f"{path}/{names['pins']}")
    pins = spark.read.parquet(f"{path}/{names['pins']}")
    depth = depth_for(pins.count(), leaf)
    write_tree(pins, depth, f"{path}/{names['tree']}")
    root = read_tree(spark, f"{path}/{names['tree']}").where("level = 0").first()
    facts = {"version": number, **names, "keys": keys, "depth": depth, "rows": root.n_rows if root else 0, "root": root.digest if root else None, "schema": df.schema.json(), "note": note or {}}
    body = json.dumps(facts, sort_keys=True)
    target, fs = _files(spark, f"{path}/_versions/{number:010}")
    stream = fs.create(target, False)
    try:
        stream.write(bytearray(f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}\n".encode()))
    finally:
        stream.close()
    return facts


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    m = manifest(spark, path, version)
    return spark.read.schema(StructType.fromJson(json.loads(m["schema"]))).parquet(f"{path}/{m['data']}")


def compare_versions(spark: SparkSession, path: str, before: int, now: int) -> DataFrame:
    """``located`` between two versions with the same keys; trees of different depth are built anew at the greater one."""
    a, b = manifest(spark, path, before), manifest(spark, path, now)
    if a["keys"] != b["keys"]:
        raise ValueError(f"keys differ: {a['keys']}, {b['keys']}")
    depth = max(a["depth"], b["depth"])
    pins = [spark.read.parquet(f"{path}/{m['pins']}") for m in (a, b)]
    trees = []
    for m, p in zip((a, b), pins):
        where = f"{path}/{m['tree']}"
        if m["depth"] != depth:
            where = f"{path}/tree-{uuid.uuid4().hex}"
            write_tree(p, depth, where)
        trees.append(read_tree(spark, where))
    return located(*pins, a["keys"], differing_parts(*trees, depth), depth)


def verify_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``located`` between a version's pins and what its files hold now; no rows if all is as it was published."""
    m = manifest(spark, path, version)
    pins, now = spark.read.parquet(f"{path}/{m['pins']}"), row_pins(read_version(spark, path, m["version"]), m["keys"])
    where = f"{path}/tree-{uuid.uuid4().hex}"
    write_tree(now, m["depth"], where)
    parts = differing_parts(read_tree(spark, f"{path}/{m['tree']}"), read_tree(spark, where), m["depth"])
    return located(pins, now, m["keys"], parts, m["depth"])


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Delete what no whole manifest names (of publishes that died, of comparisons) and return its names; not while another publishes."""
    named = {m[k] for n in _numbers(spark, path) if (m := _manifest(spark, path, n)) for k in ("data", "pins", "tree")}
    target, fs = _files(spark, path)
    gone = [s.getPath() for s in fs.listStatus(target) if s.getPath().getName().startswith(("data-", "pins-", "tree-")) and s.getPath().getName() not in named]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)
