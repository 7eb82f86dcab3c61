"""Document fingerprints [native]: consistent weighted sampling of weighted words.

A document is a set of words weighted by their counts. For sample k and word x, hashes give
r and c from Gamma(2, 1) and b from U(0, 1); with weight w,
t = floor(ln w / r + b), and the sample is the pair (x, t) with the least
ln c - r (t - b) - r. Two fingerprints agree at a position with a probability that equals
the generalised Jaccard similarity sum(min) / sum(max) of the weights.

All of it is DataFrame expressions. Documents are dealt once, by ranges of doc_id; the next
document, word counts and samples all reuse that partitioning.

Defined results: null text is empty; texts without words share one fingerprint (likeness 1
between them, 0 to others); repeated doc_ids follow each other in the order of a hash of their
texts; null doc_ids come last in descending order; an empty table gives no rows; a single
document is its own next. Only doc_id and text of the input are used, so other columns can't clash. A text
is split into words in one row, some ten bytes of memory for each of its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import table, utf8

SAMPLES = 32


def _unit(h: Column, shift: int) -> Column:
    """20 bits of a hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND((1 << 20) - 1) + 0.5) / float(1 << 20)


def sample_key(word: Column, log_weight: Column, k: int) -> Column:
    """A long that orders by the sampling criterion and holds the identity of (word, t) in its low 24 bits."""
    h = F.xxhash64(word, F.lit(k))
    g = F.xxhash64(h)
    r = -F.log(_unit(h, 0) * _unit(h, 20))  # Gamma(2, 1): minus the log of a product of two uniforms
    ln_c = F.log(-F.log(_unit(g, 0) * _unit(g, 20)))
    b = _unit(h, 40)
    t = F.floor(log_weight / r + b)
    ln_a = ln_c - r * (t - b + 1.0)
    # Weights and gammas bound ln_a well inside (-64, 64) for counts below e^30.
    rank = F.floor((ln_a + 64.0) * float(1 << 31))
    return F.shiftleft(rank, 24).bitwiseOR(F.xxhash64(h, t).bitwiseAND((1 << 24) - 1))


def bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """Documents with ``bucket`` (ranges of doc_id), and a ghost of the document that follows each bucket."""
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / buckets for i in range(1, buckets)], 0.2 / buckets)))
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    base = docs.select(
        "doc_id", utf8("text").alias("text"), F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan"))).alias("_x")
    )
    base = Bucketizer(splits=splits, inputCol="_x", outputCol="_b", handleInvalid="keep").transform(base)
    # Null ids (kept as the last bucket) come after all others in descending order.
    base = base.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_b").cast("int"))).drop("_x", "_b")
    first = base.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).orderBy(F.desc("bucket")).collect()
    follows = [(b.doc_id, a.bucket) for a, b in zip(first, [*first[1:], *first[:1]])]
    after = F.broadcast(spark.createDataFrame(follows, "_id long, _to int"))  # one row for each bucket
    ghosts = base.join(after, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "rid", F.col("_to").alias("bucket"), F.lit(True).alias("ghost"))
    return base.select("doc_id", "text", "rid", "bucket", F.lit(False).alias("ghost")).unionByName(ghosts)


def fingerprints(docs: DataFrame, samples: int = SAMPLES, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    partitions = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Many small partitions, so that the word counts of one fit in memory.
    dealt = bucketed(docs.select(F.col("doc_id").cast("long"), "text"), buckets or 4 * partitions).withColumn("_h", F.xxhash64("text")).repartition(partitions, "bucket")
    line = Window.partitionBy("bucket").orderBy("ghost", F.desc("doc_id"), "_h", "rid")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    seen = (
        dealt.withColumn("next_text", F.lead("text").over(line)).withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", F.when(~F.col("ghost"), F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))))
    )
    sides = seen.select("bucket", "rid", "ghost", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))).alias("s"))
    words = (
        sides.where("s.body is not null")
        .select("bucket", "rid", "ghost", F.col("s.side").alias("side"), F.explode(F.split("s.body", r"[ \t-\r]+")).alias("word"))
        .select("bucket", "rid", "ghost", "side", F.when(F.col("word") != "", F.xxhash64("word")).alias("word"))
    )
    counted = words.groupBy("bucket", "rid", "ghost", "side", "word").agg(F.count("word").alias("n")).withColumn("ln_n", F.log("n"))
    keys = [F.min(F.when(F.col("word").isNotNull(), sample_key(F.col("word"), F.col("ln_n"), k))).alias(f"m{k}") for k in range(samples)]
    sampled = counted.groupBy("bucket", "rid", "ghost", "side").agg(*keys)
    both = sampled.groupBy("bucket", "rid", "ghost").agg(
        *[F.coalesce(F.max(F.when(F.col("side") == s, F.col(f"m{k}"))), F.lit(-1)).alias(f"{name}{k}") for s, name in ((0, "a"), (1, "b")) for k in range(samples)]
    )
    facts = seen.select("bucket", "rid", "ghost", "doc_id", "_h", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"))
    out = facts.join(both, ["bucket", "rid", "ghost"])
    out = out.select("*", *[F.lead(f"a{k}").over(line).alias(f"c{k}") for k in range(samples)]).where(~F.col("ghost"))

    def alike(x: str, y: str) -> Column:
        return sum((F.when(F.col(f"{x}{k}") == F.col(f"{y}{k}"), 1).otherwise(0) for k in range(samples)), F.lit(0)) / F.lit(float(samples))

    def shown(x: str) -> Column:
        return F.concat(*[F.lower(F.lpad(F.hex(F.col(f"{x}{k}").bitwiseAND((1 << 24) - 1)), 6, "0")) for k in range(samples)])

    return out.select("doc_id", "n_chars", "edited_sha256", shown("a").alias("fingerprint"), shown("b").alias("edited_fingerprint"), alike("a", "b").alias("near_edited"), alike("a", "c").alias("near_next"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
