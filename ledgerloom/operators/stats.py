"""Statistics with exact denominators."""

from __future__ import annotations

from functools import reduce
from math import comb, isfinite

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType

from ..sources.stored import stored


#: Values of a group that one task may put in order; beyond, intervals around the wanted places are narrowed first.
MOST, ACCURACY, PASSES = 1_000_000, 5_000, 6


def at_ranks(df: DataFrame, x: str, ranks: dict[str, tuple[int, int]], *by: str, most: int = MOST) -> DataFrame:
    """(by, low, high, and for each name (a, b) of ``ranks`` the value at place n * a // b of the sorted values).

    By rank, not interpolated, by selection: each (group, name) has an interval of values around its place. While
    one holds more than ``most`` values, a pass estimates the place inside it (a mergeable sketch), narrows the interval
    to a small part around the estimate, and counts exactly what lies below and within; bounds that would
    lose the place are not taken. Only what is left is put in order, as counts of distinct values. A pass is one
    aggregate over the rows, so a group's rows are in as many tasks as the table has.
    """
    keys = list(by)
    rows = df.where(F.col(x).isNotNull()).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col(x).alias("_x"))
    own = [f"_k{i}" for i in range(len(keys))]
    whole = stored(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")).where("_n > 0"), "rank-groups")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.col("_n") * a / b).alias("k")) for name, (a, b) in ranks.items()]))
    places = stored(whole.select(*own, wanted.alias("w"), F.col("_low").alias("lo"), F.col("_high").alias("hi"), F.col("_n").alias("held"), F.lit(0).cast("long").alias("below")).select(*own, "w.name", "w.k", "lo", "hi", "held", "below"), "rank-places")
    numeric = isinstance(rows.schema["_x"].dataType, NumericType)
    for _ in range(PASSES if numeric else 0):
        if not places.where(F.col("held") > most).where("lo < hi").limit(1).count():
            break
        places = stored(_narrowed(rows, places, own, most), "rank-places")
    inside = _met(rows, places, own).where("_x BETWEEN lo AND hi").groupBy(*own, "name", "_x").agg(F.count(F.lit(1)).alias("_c"))
    upto = inside.withColumn("_to", F.sum("_c").over(Window.partitionBy(*own, "name").orderBy("_x")))
    met = reduce(lambda p, c: p & F.col(f"u.{c}").eqNullSafe(F.col(f"p.{c}")), own, F.col("u.name") == F.col("p.name"))
    found = upto.alias("u").join(places.alias("p"), met).where("_to > k - below").groupBy(*[F.col(f"p.{c}").alias(c) for c in own]).agg(*[F.min(F.when(F.col("p.name") == name, F.col("_x"))).alias(name) for name in ranks])
    met = reduce(lambda p, c: p & F.col(f"w.{c}").eqNullSafe(F.col(f"f.{c}")), own, F.lit(True))
    return whole.alias("w").join(found.alias("f"), met).select(*[F.col(f"w.{o}").alias(c) for o, c in zip(own, keys)], F.col("_low").alias("low"), F.col("_high").alias("high"), *ranks)


def _met(rows: DataFrame, places: DataFrame, own: list[str]) -> DataFrame:
    """Rows with each of their group's places; a group is null-safe. Spark broadcasts the places where their size is small."""
    keyed = places.withColumnsRenamed({c: f"_p{c}" for c in own})
    met = reduce(lambda p, c: p & F.col(c).eqNullSafe(F.col(f"_p{c}")), own, F.lit(True))
    return rows.join(keyed, met).drop(*[f"_p{c}" for c in own])


def _narrowed(rows: DataFrame, places: DataFrame, own: list[str], most: int) -> DataFrame:
    """One pass over the intervals that hold too much."""
    wide = F.col("held") > most
    open_, done = places.where(wide & (F.col("lo") < F.col("hi"))), places.where(~(wide & (F.col("lo") < F.col("hi"))))
    inside = _met(rows, open_, own).where("_x BETWEEN lo AND hi")
    cuts = F.percentile_approx("_x", [i / 500 for i in range(501)], ACCURACY)
    sketch = stored(inside.groupBy(*own, "name").agg(cuts.alias("cuts")), "rank-sketch")
    met = reduce(lambda p, c: p & F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}")), own, F.col("a.name") == F.col("s.name"))
    at = F.floor(500 * (F.col("k") - F.col("below")) / F.col("held")).cast("int")
    tried = open_.alias("a").join(sketch.alias("s"), met).select("a.*", F.get("cuts", F.greatest(at - 1, F.lit(0))).alias("new_lo"), F.get("cuts", F.least(at + 2, F.lit(500))).alias("new_hi"))
    tried = stored(tried, "rank-tried")
    counted = _met(rows, tried, own).where("_x BETWEEN lo AND hi").groupBy(*own, "name", "k", "lo", "hi", "held", "below", "new_lo", "new_hi").agg(F.count_if(F.col("_x") < F.col("new_lo")).alias("under"), F.count_if(F.col("_x") > F.col("new_hi")).alias("over"))
    place = F.col("k") - F.col("below")
    left, right = F.col("under") <= place, place < F.col("held") - F.col("over")
    under, over = F.when(left, F.col("under")).otherwise(0), F.when(right, F.col("over")).otherwise(0)
    return done.unionByName(counted.select(*own, "name", "k", F.when(left, F.col("new_lo")).otherwise(F.col("lo")).alias("lo"), F.when(right, F.col("new_hi")).otherwise(F.col("hi")).alias("hi"), (F.col("held") - under - over).alias("held"), (F.col("below") + under).alias("below")))


def order_stats(df: DataFrame, x: str, *by: str) -> DataFrame:
    """min, x[n // 2], x[int(.95 n)], max of the sorted values."""
    return at_ranks(df, x, {"median": (1, 2), "p95": (95, 100)}, *by).select(*by, "low", "median", "p95", "high")


def mean_sd(values: list[float], deterministic: bool = False) -> dict:
    """Mean and sample SD; one value has no SD, and a deterministic condition has one value or is refused."""
    if not values:
        raise ValueError("no values")
    n, mean = len(values), sum(values) / len(values)
    if deterministic and n != 1:
        raise ValueError(f"a deterministic condition has one result, not {n}")
    return {"mean": mean, "n": n, "sd": (sum((v - mean) ** 2 for v in values) / (n - 1)) ** 0.5 if n > 1 else None}


def item_score(df: DataFrame, score: str) -> DataFrame:
    return df.agg(F.count(score).alias("n"), F.sum(score).alias("total"), (F.sum(score) / F.count(score)).alias("mean"))


def group_score(df: DataFrame, score: str, group: str) -> DataFrame:
    """Mean of the groups' means; rows without a group are left out and counted."""
    means = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg(score).alias("m"))
    return means.agg(F.count("m").alias("n_groups"), F.avg("m").alias("mean")).crossJoin(df.agg(F.count_if(F.col(group).isNull()).alias("unattributed")))


def effect_size(differences: list[float]) -> float | None:
    """d_z = mean / sample SD; None for zero variance; fewer than two or non-finite values are an error."""
    if any(not isfinite(d) for d in differences):
        raise ValueError("non-finite difference")
    n = len(differences)
    if n < 2:
        raise ValueError("an effect size needs at least two differences")
    mean = sum(differences) / n
    sd = (sum((d - mean) ** 2 for d in differences) / (n - 1)) ** 0.5
    return mean / sd if sd else None


#: Distinct differences that one task draws from.
VALUES = 100_000


def bootstrap(df: DataFrame, diff: str, resamples: int = 10_000, salt: int = 7, most: int = VALUES) -> DataFrame:
    """Mean difference and its percentile interval.

    Each resample draws as many items as there are, with replacement. Items of one value are alike, so a
    draw is a multinomial over distinct values. Those are dealt by hash to parts of about ``most``: a resample first
    draws how many items each part gets (from a stream of its own, so all parts know it), then each part draws among its
    values. Null differences are drawn but not averaged.
    """
    spark = df.sparkSession
    values = stored(df.groupBy(F.col(diff).cast("double").alias("d")).agg(F.count(F.lit(1)).alias("n")), "bootstrap-values")
    facts = values.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("d").isNotNull(), F.col("n"))), F.lit(0)).alias("held"), F.sum(F.col("d") * F.col("n")).alias("total")).first()
    if not facts.held:
        return spark.createDataFrame([(None, None, None, 0)], "low double, high double, mean double, n long")
    parts = -(-facts.k // most)
    dealt = values.withColumn("part", F.pmod(F.xxhash64("d"), F.lit(parts)).cast("int"))
    sizes = {r.part: r.n for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one a part
    numbers = sorted(sizes)
    share = np.array([sizes[p] for p in numbers]) / facts.n

    def run(tab: pa.Table) -> pa.Table:
        own = tab.sort_by("d")
        d, n, part = own.column("d").to_numpy(), own.column("n").to_numpy(), own.column("part")[0].as_py()  # null as NaN
        known, place = ~np.isnan(d), numbers.index(part)
        order = np.append(np.flatnonzero(known), np.flatnonzero(~known))
        d, n, known = d[order], n[order], known[order]
        sums, held = np.zeros(resamples), np.zeros(resamples, np.int64)
        for b in range(resamples):
            rng = np.random.default_rng([salt, b])
            mine = rng.multinomial(facts.n, share)[place] if len(numbers) > 1 else facts.n
            rng = np.random.default_rng([salt, b, place]) if len(numbers) > 1 else rng
            drawn = rng.multinomial(mine, n / n.sum())[known]
            sums[b], held[b] = (drawn * d[known]).sum(), drawn.sum()
        return pa.table({"b": np.arange(resamples), "s": sums, "c": held})

    drawn = dealt.groupBy("part").applyInArrow(run, "b long, s double, c long").groupBy("b").agg((F.sum("s") / F.nullif(F.sum("c"), F.lit(0))).alias("m"))
    ranked = drawn.withColumn("r", F.row_number().over(Window.orderBy("m")) - 1)  # as many as resamples
    low, high = int(0.025 * resamples), min(resamples - 1, int(0.975 * resamples))
    mean = facts.total / facts.held
    return ranked.agg(F.max(F.when(F.col("r") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("r") == high, F.col("m"))).alias("high")).select("*", F.lit(mean).alias("mean"), F.lit(facts.held).cast("long").alias("n"))


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided p of the discordant counts."""
    n, k = b + c, min(b, c)
    return 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)


@F.pandas_udf(DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """``mcnemar`` over columns of counts."""
    return pd.Series([mcnemar(int(x), int(y)) for x, y in zip(b, c)], dtype="float64")


def holm(df: DataFrame, p: str, name: str) -> DataFrame:
    """Adjusted p: (m - i) p in rising order, running maximum, at most 1."""
    w = Window.orderBy(p, name)
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    step = df.withColumn("_s", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    return step.withColumn("adjusted", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
