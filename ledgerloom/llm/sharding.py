"""Sharding by longest processing time: groups that must stay together, largest first, to the
least-loaded shard of a heap.

The heap runs on the driver over a bounded number of items. Groups above ``1 / (shards *
FINE)`` of all bytes are items of their own (so at most ``shards * FINE``); the rest are
gathered by hash into ``shards * FINE`` bundles first. On tables of fewer groups than that the
schedule is LPT over the groups themselves up to hash collisions. Every other step is a
DataFrame operation; hot groups are pre-aggregated before they are shuffled.

Defined results: a null text counts as empty (size 8); equal texts share a shard, so one group
that outweighs ``total / shards`` makes its shard larger than the others; an empty table gives
no rows; repeated rows each get their own slot; a column ``shard`` of the input is replaced, other
columns may have any name.
"""

from __future__ import annotations

import heapq
import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persist_table, running_start, subs_for, table, utf8

FINE = 512


def lpt(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """(item, size) -> shard: by falling size, each to the least-loaded shard (ties: smaller item, smaller shard)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[item] = s
        heapq.heappush(heap, (load + size, s))
    return out


def assign_shards(df: DataFrame, group: str, size: str, shards: int = 24, fine: int = FINE) -> DataFrame:
    """Add ``shard`` to a materialised table; rows of one ``group`` (a hashable column) stay together. A column ``shard`` it has is replaced."""
    spark = df.sparkSession
    df = df.drop("shard")
    bundles = shards * fine
    taken = {c.lower() for c in df.columns}
    total_, key, own_, bundle = (next(n for n in (name + "_" * k for k in itertools.count()) if n not in taken) for name in ("_size", "_g", "_own", "_bundle"))
    groups = df.groupBy(group).agg(F.sum(size).alias(total_))
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if not total:
        return df.withColumn("shard", F.lit(0))
    small = F.pmod(F.xxhash64(group), F.lit(bundles)).cast("int")
    big = groups.where(F.col(total_) > total / bundles).orderBy(F.desc(total_), group).limit(bundles).collect()
    own = spark.createDataFrame([(r[0], bundles + i) for i, r in enumerate(big)], f"{key} {df.schema[group].dataType.simpleString()}, {own_} int")

    def bundled(x: DataFrame) -> DataFrame:
        return x.join(F.broadcast(own), F.col(group) == F.col(key), "left").withColumn(bundle, F.coalesce(own_, small)).drop(key, own_)

    items = [(r[0], r[1]) for r in bundled(groups).groupBy(bundle).agg(F.sum(total_)).collect()]
    where = spark.createDataFrame(list(lpt(items, shards).items()), f"{bundle} int, shard int")
    return bundled(df).join(F.broadcast(where), bundle).drop(bundle)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = persist_table(
        docs.select(
            "doc_id", (F.octet_length(utf8("text")).cast("long") + 8).alias("size"), F.crc32(utf8("text").cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(utf8("text").cast("binary"))).alias("grp"),
        ),
        "shard-slim",
    )
    dealt = assign_shards(slim, "grp", "size").withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.lit(subs_for(slim.count()))))
    out = running_start(dealt, "shard", "sub", [F.col("doc_id"), F.col("text_crc32")], F.lit(1).cast("long"), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
