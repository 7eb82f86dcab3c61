"""Filters, joins, aggregates and windows of the curated-data engine as DataFrame functions."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SENTINELS
from ..sources.stored import dealt, stored


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns only; one that is missing is an error, and no other ever passes."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def fill_sentinels(df: DataFrame, field: str, rules: list[tuple[Column, str]], key: str | None = None, fixed: dict | None = None) -> DataFrame:
    """Blank cells of a field by the first rule that holds, row-specific values (by ``key``) before any; a blank that none covers is an error."""
    c = F.col(field)
    empty = F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    out = F.when(~empty, c)
    for k, value in (fixed or {}).items():
        out = out.when(F.col(key) == k, value)
    for test, value in rules:
        out = out.when(test, value)
    return df.withColumn(field, out.otherwise(F.raise_error(F.lit(f"blank {field} without a rule"))))


def contains_any(columns: list[str], words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(w.lower()) for c in columns for w in words])


def predicate(tree: dict) -> Column:
    """A predicate tree as one column: {op, field, value} leaves under AND / OR {op, operands}."""
    op = tree["op"].upper()
    if op in ("AND", "OR"):
        parts = [predicate(t) for t in tree["operands"]]
        if not parts:
            raise ValueError("operands missing")
        return reduce((lambda a, b: a & b) if op == "AND" else (lambda a, b: a | b), parts)
    field, value = F.col(tree["field"]), tree.get("value")
    return {
        "=": lambda: field == value, "!=": lambda: field != value, ">": lambda: field > value, ">=": lambda: field >= value, "<": lambda: field < value,
        "IN": lambda: field.isin(*value), "LIKE": lambda: field.ilike(value), "NOT NULL": field.isNotNull, "HAS": lambda: F.array_contains(field, value),
    }[op]()


def top_entities(df: DataFrame, entity: str, measure: str, low) -> DataFrame:
    """Entities with a measure above ``low``, by falling maximum (DISTINCT ordered by another column)."""
    return df.where(F.col(measure) > low).groupBy(entity).agg(F.max(measure).alias("top")).orderBy(F.desc("top"), entity)


def holders_of_both(a: DataFrame, b: DataFrame, entity: str) -> DataFrame:
    """Entities with a row in each: semi joins, so that no pairs are formed."""
    return a.select(entity).distinct().join(b.select(entity), entity, "left_semi")


def value_pairs(a: DataFrame, b: DataFrame, entity: str, x: str, y: str, low: int, high: int) -> DataFrame:
    """(x, y, n): entities that hold both values, where low <= n <= high."""
    return (
        a.select(entity, x).distinct().join(b.select(entity, y).distinct(), entity).groupBy(x, y).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(low, high))
    )


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys only in a, only in b, in both; and repeats in each."""
    x = a.groupBy(key).agg(F.count(F.lit(1)).alias("na"))
    y = b.groupBy(key).agg(F.count(F.lit(1)).alias("nb"))
    return x.join(y, key, "full_outer").agg(
        F.count_if(F.col("nb").isNull()).alias("only_a"), F.count_if(F.col("na").isNull()).alias("only_b"), F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull()).alias("both"),
        F.count_if(F.col("na") > 1).alias("repeated_a"), F.count_if(F.col("nb") > 1).alias("repeated_b"),
    )


def cell_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str], reasons: dict[str, str] | None = None) -> DataFrame:
    """(key, field, old, new, type, reason) of every cell that differs, nulls included; type: filled, cleared or changed."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(key, fields, "field", name)

    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    kind = F.when(empty("old"), "filled").when(empty("new"), "cleared").otherwise("changed")
    why = F.lit(None).cast("string")
    for f, text in (reasons or {}).items():
        why = F.when(F.col("field") == f, text).otherwise(why)
    return long(old, "old").join(long(new, "new"), [key, "field"]).where(~F.col("old").eqNullSafe(F.col("new"))).withColumns({"type": kind, "reason": why})


def resolve_or_conflict(df: DataFrame, entity: str, field: str) -> DataFrame:
    """The value where all rows of an entity agree, else a conflict. A null against a value is a conflict; arrays agree as sets."""
    array = df.schema[field].dataType.typeName() == "array"
    value = F.array_sort(F.array_distinct(field)) if array else F.col(field)
    return df.groupBy(entity).agg((F.count_distinct(value) + F.max(F.when(value.isNull(), 1).otherwise(0))).alias("n_values"), F.min(value).alias("_v"), F.count(F.lit(1)).alias("n_rows")).select(
        entity, "n_rows", F.when(F.col("n_values") == 1, F.col("_v")).alias("value"), (F.col("n_values") > 1).alias("conflict")
    )


def first_collision(candidates: DataFrame, checks: list[tuple[str, str, DataFrame]], ready: Column | None = None, not_ready: str = "no_anchor") -> DataFrame:
    """Add ``reason``: the first check, in order, whose used keys (frame of one column) hold the candidate's column; null: kept."""
    out, reason = candidates, F.when(~ready, not_ready) if ready is not None else None
    for i, (name, column, used) in enumerate(checks):
        keys = used.select(F.col(used.columns[0]).alias(f"_k{i}")).distinct()
        out = out.join(keys, F.col(column) == F.col(f"_k{i}"), "left")
        hit = F.col(f"_k{i}").isNotNull()
        reason = F.when(hit, name) if reason is None else reason.when(hit, name)
    return out.withColumn("reason", reason).drop(*[f"_k{i}" for i in range(len(checks))])


def crosstab(df: DataFrame, value: str, split: str, sides: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """Rows of each value by split, the sides it is absent from, and whether that is a gap: a value on fewer rows than sides can't span them."""
    x = df.groupBy(value).pivot(split, list(sides)).count().na.fill(0, list(sides))
    total = reduce(lambda a, b: a + b, [F.col(c) for c in sides])
    absent = F.concat_ws(",", *[F.when(F.col(c) == 0, c) for c in sides])
    return x.withColumn("absent_from", absent).withColumn("assessment", F.when(F.col("absent_from") == "", "covered").when(total < len(sides), "too_few_rows").otherwise("gap"))


def cost_table(df: DataFrame, value: str, reasons: list[tuple[str, Column]], **aggregates: Column) -> DataFrame:
    """(value, n, the aggregates, reasons against it joined by ``;``, share of all rows in percent)."""
    g = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in aggregates.items()])
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    return g.crossJoin(F.broadcast(total)).withColumn("reasons", F.concat_ws(";", *[F.when(c, name) for name, c in reasons])).withColumn("share", F.round(100.0 * F.col("n") / F.col("_t"), 4)).drop("_t")


def table_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of a not in b and of b not in a, as multisets, by counts of equal rows (null equals null); both 0 if the tables are equal."""
    columns = a.columns
    if sorted(columns) != sorted(b.columns):
        raise ValueError("tables differ in their columns")
    side = lambda df, n: df.select(*columns, F.lit(n).alias("_side"))
    net = side(a, 1).unionAll(side(b, -1)).groupBy(*columns).agg(F.sum("_side").alias("_net"))
    return net.agg(F.coalesce(F.sum(F.greatest("_net", F.lit(0))), F.lit(0)).cast("long").alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("_net"), F.lit(0))), F.lit(0)).cast("long").alias("only_b"))


def containment(df: DataFrame, group: str, key: str, inner: Column, outer: Column) -> DataFrame:
    """One row: groups partly inside the inner scope, and keys of the inner scope that lie outside the outer one (scopes must nest)."""
    g = df.groupBy(group).agg(F.count_if(inner).alias("_in"), F.count(F.lit(1)).alias("_n"))
    split = g.agg(F.count_if((F.col("_in") > 0) & (F.col("_in") < F.col("_n"))).alias("partial"))
    return split.crossJoin(df.where(inner & ~outer).agg(F.count_distinct(key).alias("outside")))


def extra_copies(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows that repeat their key more often than the least repeated key does."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    least = counts.agg(F.min("_n").alias("_least"))
    numbered = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.crossJoin(F.broadcast(least)).where(F.col("_r") > F.col("_least")).drop("_r", "_least")


def capped(df: DataFrame, family: str, cap: int, *order) -> DataFrame:
    """The first ``cap`` candidates of each family (the cap is the feature)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(family).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")


def preferred(df: DataFrame, family: str, matched: str, cap: int, *values: str) -> DataFrame:
    """``capped``, answers of several rows before those of one, larger before smaller."""
    return capped(df, family, cap, F.col(matched) == 1, F.desc(matched), *values)


def range_part(df: DataFrame, value: Column, parts: int = 0) -> Column:
    """Which of about ``parts`` ranges of its order a value falls in (nulls: the first); pass a struct to part the rows of a frequent value by further columns.

    The bounds are literals, so the number is the same wherever it is computed, and only sizes depend on them. They come
    from distinct values and how often each occurs: the most frequent ones, and others chosen by hash that stand for all the rest.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.select(value.alias("_v")).where("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    rows = counts.agg(F.sum("_c")).first()[0] or 0
    often = {r._v: r._c for r in counts.orderBy(F.desc("_c"), F.xxhash64("_v"), "_v").limit(200).collect()}
    some = {r._v: r._c for r in counts.orderBy(F.xxhash64("_v"), "_v").limit(1000).collect()}
    rest = sum(c for v, c in some.items() if v not in often)
    scale = (rows - sum(often.values())) / rest if rest else 1.0
    weight = {v: c * scale for v, c in some.items()} | often
    kind = counts.schema["_v"].dataType
    whole = lambda v: tuple((x is not None, x) for x in (v if kind.typeName() == "struct" else (v,)))
    bounds, held, last = [], 0.0, 0
    for v in sorted(weight, key=whole):
        at = int((held + weight[v] / 2) * n / rows)
        if at > last:
            bounds.append(v)
        held, last = held + weight[v], max(at, last)
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[_literal(b, kind) for b in bounds]), lambda b: b <= value))


def _literal(v, kind) -> Column:
    if kind.typeName() == "struct":
        return F.struct(*[_literal(x, f.dataType).alias(f.name) for x, f in zip(v, kind.fields)])
    return F.lit(v).cast(kind)


def with_position(df: DataFrame, *order: str, by: tuple[str, ...] = (), parts: int = 0) -> DataFrame:
    """Add ``position`` from 0 in the order of the columns (within the groups of ``by``), without putting all rows in one task.

    Rows are dealt to ranges of the whole order, so that rows with one frequent first value are in several; each
    range counts on from those before (a small table). Rows equal in all of ``order`` must be told apart by it.
    """
    value = F.struct(*order) if len(order) > 1 else F.col(order[0])
    dealt = df.withColumn("_p", range_part(df, value, parts))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    base = base.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), "_base")
    placed = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order)) - 1)
    met = reduce(lambda x, ic: x & F.col(ic[1]).eqNullSafe(F.col(f"_b{ic[0]}")), enumerate(by), F.col("_p") == F.col("_q"))
    return placed.join(base if by else F.broadcast(base), met).withColumn("position", F.col("_base") + F.col("_i")).select(*df.columns, "position")


def recombined(df: DataFrame, key: str, offsets: tuple[int, ...]) -> DataFrame:
    """(key, others): each row with the rows at fixed offsets after it in key order, around the end."""
    placed = with_position(df.select(key).distinct(), key)
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    wanted = placed.crossJoin(F.broadcast(n)).select(F.col(key).alias("_own"), F.posexplode(F.array(*[(F.col("position") + o) % F.col("_n") for o in offsets])).alias("_i", "position"))
    met = wanted.join(placed, "position").groupBy("_own").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", key))), lambda x: x[key]).alias("others"))
    return met.withColumnRenamed("_own", key)


def evidence_sets(df: DataFrame, term: str, entity: str, n_terms: int = 8, n_matches: int = 2) -> DataFrame:
    """(term, matches, other): of the first shared terms, the first entities that hold each, and the first that does not (null if all do).

    Null terms and entities are none; repeated rows count once.
    """
    pairs = df.select(term, entity).where(F.col(term).isNotNull() & F.col(entity).isNotNull()).distinct()
    shared = stored(pairs.groupBy(term).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n_matches).orderBy(term).limit(n_terms).select(term), "evidence-terms")
    # Holders of one term and all entities are counted by ranges of the order, so no task sorts either.
    own = stored(with_position(stored(pairs.join(F.broadcast(shared), term), "evidence-pairs"), term, entity, by=(term,)), "evidence-own")
    entities = stored(with_position(stored(df.select(entity).where(F.col(entity).isNotNull()).distinct(), "evidence-entities"), entity), "evidence-places")
    matches = own.where(F.col("position") < n_matches).groupBy(term).agg(F.array_sort(F.collect_list(entity)).alias("matches"))
    # The first entity without a term: the k-th entity at all, where the first k - 1 hold it.
    at = own.join(entities.withColumnRenamed("position", "_k"), entity).where(F.col("position") == F.col("_k")).groupBy(term).agg(F.max("_k").alias("_held"))
    other = shared.join(at, term, "left").select(term, (F.coalesce("_held", F.lit(-1)) + 1).alias("position")).join(entities.withColumnRenamed(entity, "other"), "position", "left").select(term, "other")
    return matches.join(other, term)


def spread(df: DataFrame, k: int, *order: str) -> DataFrame:
    """``k`` rows spread evenly over the order: those at round(i (n - 1) / (k - 1)), all if there are fewer."""
    placed = with_position(df, *order)
    n = df.count()
    marks = sorted({round(i * (n - 1) / (k - 1)) for i in range(k)} if 1 < k < n else range(min(n, 1 if k == 1 else n)))
    return placed.where(F.col("position").isin(marks)).drop("position") if k < n else df


def same_rows(a: DataFrame, b: DataFrame, ordered: bool = False) -> bool:
    """Equal as multisets of rows or, ``ordered`` by a column ``position``, as lists."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    own = [c for c in a.columns if c != "position"] if not ordered else a.columns
    d = table_differences(a.select(*own), b.select(*own)).first()
    return d.only_a == d.only_b == 0


def support(df: DataFrame, field: str, split: str, entity: str) -> DataFrame:
    """Rows and distinct entities of each value, by split and over all (one pass of grouping sets)."""
    spark = df.sparkSession
    return spark.sql(
        f"SELECT {field} AS term, coalesce({split}, 'ALL') AS split, count(*) AS n_rows, count(DISTINCT {entity}) AS n_entities FROM {{df}} GROUP BY GROUPING SETS (({field}, {split}), ({field}))", df=df
    )


def digest_rank(df: DataFrame, stratum: str, digest: Column, *ties: str) -> DataFrame:
    """Add ``rank`` (from 1, in the order of a hex digest, then ``ties``) and ``of`` (rows of the stratum).

    A digest is uniform: its first three digits deal a stratum to 4,096 parts, which count on from those before, so
    that no task sorts a stratum.
    """
    dealt = df.withColumn("_k", digest).withColumn("_p", F.substring("_k", 1, 3))
    parts = dealt.groupBy(stratum, "_p").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(stratum)
    base = parts.select(F.col(stratum).alias("_t"), F.col("_p").alias("_q"), (F.sum("_c").over(whole.orderBy("_p")) - F.col("_c")).alias("_base"), F.sum("_c").over(whole).alias("of"))
    placed = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(stratum, "_p").orderBy("_k", *ties)))
    return placed.join(base, F.col(stratum).eqNullSafe(F.col("_t")) & (F.col("_p") == F.col("_q"))).withColumn("rank", F.col("_base") + F.col("_i")).drop("_k", "_p", "_c", "_t", "_q", "_base", "_i")


def assign_splits(df: DataFrame, group: str, stratum: str, salt: str, dev: float = 0.1, test: float = 0.2) -> DataFrame:
    """Splits by the digest order of groups in each stratum: the first dev, the next test, the rest train.

    Groups are ranked, not rows, so all rows of a group share its split; a group whose rows lie in several strata
    belongs to the least of them. Rows without a group are a group of their own, in training.
    """
    groups = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.min(stratum).alias("_s"))
    ranked = digest_rank(groups, "_s", F.md5(F.concat(F.lit(salt), F.col("_g").cast("string"))), "_g")
    first, second = F.bround(F.col("of") * dev), F.bround(F.col("of") * test)
    placed = ranked.select("_g", F.when(F.col("rank") <= first, "dev").when(F.col("rank") <= first + second, "test").otherwise("train").alias("split"))
    return df.join(placed, F.col(group) == F.col("_g"), "left").select(*df.columns, F.coalesce("split", F.lit("train")).alias("split"))


def repeat_to_budget(df: DataFrame, key: str, stratum: str, tokens: str, budget: int, salt: str) -> DataFrame:
    """Whole cycles of everything, then a proportional rest, stratum by stratum in digest order.

    The greedy rule (always the stratum furthest behind its share) is a merge of falling
    sequences, hence one global order by priority. Null strata are one stratum; a table without tokens is an error.
    """
    total = df.agg(F.sum(tokens)).first()[0]
    if not total:
        raise ValueError("rows without tokens fill no budget")
    cycles, rest = divmod(budget, total)
    digest = F.sha2(F.concat_ws("\0", F.lit(salt), F.col(key).cast("string")), 256)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # A digest is uniform: its first three digits deal a stratum to 4,096 parts, which go on from the sums of those before.
    cut = df.withColumn("_digest", digest).withColumn("_d", F.substring("_digest", 1, 3))
    parts = cut.groupBy(stratum, "_d").agg(F.sum(tokens).alias("_s"))
    whole = Window.partitionBy(stratum)
    parts = parts.select(F.col(stratum).alias("_q"), F.col("_d").alias("_e"), F.coalesce(F.sum("_s").over(earlier(whole.orderBy("_d"))), F.lit(0)).alias("_before"), F.sum("_s").over(whole).alias("_w"))
    inside = F.coalesce(F.sum(tokens).over(earlier(Window.partitionBy(stratum, "_d").orderBy("_digest", key))), F.lit(0))
    placed = cut.withColumn("_in", inside).join(parts, F.col(stratum).eqNullSafe(F.col("_q")) & (F.col("_d") == F.col("_e")))
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731 (products of two counts of tokens)
    prio = wide(F.lit(rest)) * wide(F.col("_w")) - wide(F.col("_before") + F.col("_in")) * wide(F.lit(total))
    ranked = placed.withColumn("_prio", prio.cast("decimal(38,0)")).select(*df.columns, "_digest", "_prio")
    # A running sum over ranges of the order, so that no task sorts everything.
    dealt = ranked.withColumn("_p", range_part(ranked, -F.col("_prio")))
    base = dealt.groupBy("_p").agg(F.sum(tokens).alias("_t")).withColumn("_base", F.coalesce(F.sum("_t").over(earlier(Window.orderBy("_p"))), F.lit(0))).select("_p", "_base")
    inside_range = F.coalesce(F.sum(tokens).over(earlier(Window.partitionBy("_p").orderBy(F.desc("_prio"), F.desc(stratum), "_digest", key))), F.lit(0))
    extra = dealt.withColumn("_in", inside_range).join(F.broadcast(base), "_p").where(F.col("_base") + F.col("_in") < rest).select(*df.columns)
    whole = df.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(cycles)))).drop("_c") if cycles else df.limit(0)
    return whole.unionByName(extra)


def residual_pairs(a: DataFrame, b: DataFrame, of_a: tuple[str, str], of_b: tuple[str, str]) -> DataFrame:
    """n: pairs of rows with equal keys and different values, given as (key, value) of each side: pairs of a key without those of equal values, from counts."""
    def counts(df: DataFrame, of: tuple[str, str], n: str) -> DataFrame:
        return df.select(F.col(of[0]).alias("k"), F.col(of[1]).alias("v")).where("k is not null and v is not null").groupBy("k", "v").agg(F.count(F.lit(1)).alias(n))

    x, y = counts(a, of_a, "na"), counts(b, of_b, "nb")
    all_ = x.groupBy("k").agg(F.sum("na").alias("na")).join(y.groupBy("k").agg(F.sum("nb").alias("nb")), "k")
    pairs = all_.select((F.col("na") * F.col("nb")).alias("n")).union(x.join(y, ["k", "v"]).select(-F.col("na") * F.col("nb")))
    return pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def fuzzy_pairs(df: DataFrame, key: str, name: str, threshold: float = 0.86) -> DataFrame:
    """Pairs a < b of names where one's tokens begin the other's, or with a Ratcliff-Obershelp ratio of at least the threshold.

    Both sweeps are whole. Token prefixes are an equi-join; a name without tokens begins every
    name. For the ratio, see ``ratio_pairs``.
    """
    from ..functions.text import sequence_ratio

    t = _spelled(df, key, name)
    u = t.withColumnsRenamed(_OTHER)
    begins = F.explode(F.transform(F.sequence(F.lit(0), F.size("v")), lambda i: F.array_join(F.slice("v", 1, i), " "))).alias("start")
    met = t.withColumn("start", F.array_join("w", " ")).join(u.select("*", begins), "start").where("a <> b")
    turned = [F.when(F.col("a") < F.col("b"), F.col(c)).otherwise(F.col(d)).alias(c) for c, d in zip(_BOTH[::2], _BOTH[1::2])]
    turned += [F.when(F.col("a") < F.col("b"), F.col(d)).otherwise(F.col(c)).alias(d) for c, d in zip(_BOTH[::2], _BOTH[1::2])]
    by_tokens = met.select(*turned).select(*_BOTH)
    begun = (F.slice("v", 1, F.size("w")) == F.col("w")) | (F.slice("w", 1, F.size("v")) == F.col("v"))
    pairs = by_tokens.union(_alike(t, threshold)).distinct().select("a", "b", "x", "y", sequence_ratio("f", "g").alias("ratio"), begun.alias("token_prefix"))
    return pairs.where(F.col("token_prefix") | (F.col("ratio") >= threshold))


def ratio_pairs(df: DataFrame, key: str, name: str, threshold: float = 0.86) -> DataFrame:
    """(a, b, x, y, ratio): pairs a < b of names with a Ratcliff-Obershelp ratio of at least the threshold.

    Names are case folded. Of S characters in both, M = ratio * S / 2 are matched, in order and in at most S - 2M + 1
    blocks. So the names differ in at most S - 2M of their letters (as sets of numbered letters), and in at most
    3S - 6M of their bigrams (ends marked), and have a common subsequence of M. Names are dealt to pairs of blocks of at most about ``BLOCK`` names,
    each compared in one task. A block holds whole cells (names of one length with as many letters of each of eight
    classes, where those are fewer than eight); cells whose counts differ by more than S - 2M are passed over. In the others signatures of 64 and 128 bits bound both
    differences from below, then the longest common subsequence is told, and what is left is measured.
    Pairs of cells are still quadratic in number, and so are pairs of names in near ones; memory is that of two blocks.
    """
    from ..functions.text import sequence_ratio

    pairs = _alike(_spelled(df, key, name).drop("w"), threshold).select("a", "b", "x", "y", sequence_ratio("f", "g").alias("ratio"))
    return pairs.where(F.col("ratio") >= threshold).distinct()


_OTHER = {"a": "b", "x": "y", "f": "g", "w": "v", "n": "m"}
_BOTH = ["a", "b", "x", "y", "f", "g", "w", "v"]

#: Names of a block, which are compared with another block's by one task: at most, where there are many; at least, so that all cores have some.
BLOCK, LEAST_BLOCK = 200_000, 1_000
#: Pairs of names that are compared together.
TOGETHER = 1_000_000


def _spelled(df: DataFrame, key: str, name: str) -> DataFrame:
    from ..functions.text import casefold, tokens

    t = df.where(F.col(name).isNotNull()).select(F.col(key).alias("a"), F.col(name).alias("x"), casefold(F.col(name)).alias("f"))
    return t.select("a", "x", "f", tokens(F.col("f")).alias("w"), F.length("f").alias("n"))


def _alike(t: DataFrame, threshold: float) -> DataFrame:
    """Pairs that may have the ratio."""
    from ..functions.text import signatures

    named = stored(t.drop("n").withColumn("_i", F.monotonically_increasing_id()), "spelled")
    signed = stored(dealt(named.select("_i", "f"), "_i").select("_i", "f", signatures("f").alias("s")).select("_i", "f", "s.*"), "signed")
    n = signed.count()
    for_all = math.ceil(math.sqrt(8 * t.sparkSession.sparkContext.defaultParallelism))  # some four pairs of blocks a core
    blocks = max(1, -(-n // BLOCK), min(for_all, -(-n // LEAST_BLOCK)))
    large = signed.groupBy("n", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts")).where("_parts > 1")  # at most one for each BLOCK names
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("_i"), F.col("_parts"))).otherwise(0)
    own = F.pmod(F.xxhash64("n", "cell", part), F.lit(blocks)).cast("int")
    columns = ["_i", "f", "n", "letters", "grams0", "grams1", "cell"]
    rows = signed.join(F.broadcast(large), ["n", "cell"], "left").select(*columns, own.alias("own"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    pairs = rows.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", *columns).repartition(blocks * (blocks + 1) // 2, "p", "q")

    def compare(pair: tuple, table: pa.Table) -> pa.Table:
        return near_names(table, pair[0].as_py(), pair[1].as_py(), threshold)

    near = stored(pairs.groupBy("p", "q").applyInArrow(compare, "i long, j long"), "near-names")
    held = [c for c in ("a", "x", "f", "w") if c in t.columns]
    side = F.struct(*[F.col(c) for c in held])
    one, two = named.select(F.col("_i").alias("i"), side.alias("one")), named.select(F.col("_i").alias("j"), side.alias("two"))
    met = near.join(one, "i").join(two, "j").select(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).where("one.a < two.a")
    return met.select(*[F.col(f"{own}.{c}").alias(_OTHER[c] if own == "two" else c) for c in held for own in ("one", "two")])


def ratio_bounds(n: int, m: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(matched, unmatched): characters that names of lengths n and m match at least, and are left over at most (-1: no such match)."""
    size = n + m.astype(np.int64)
    matched = np.ceil(size * (threshold / 2) - 1e-9).astype(np.int64)
    return matched, np.where(np.minimum(n, m) >= matched, size - 2 * matched, -1)


def near_names(table: pa.Table, p: int, q: int, threshold: float) -> pa.Table:
    """(i, j): names of block p and of block q (the same block: each pair once) that may have the ratio by their cells, signatures and common subsequence."""
    col = lambda c: table.column(c).to_numpy()
    own, at, n, cell = col("own"), col("_i"), col("n").astype(np.int64), col("cell")
    bits = [col(c).view(np.uint64) for c in ("letters", "grams0", "grams1")]
    codes = letter_codes(table.column("f"), n)

    def cells(block: int) -> tuple:
        """Rows in the order of their cells, where each cell begins and how many it holds, its counts by class (in unary), its length."""
        rows = np.flatnonzero(own == block)
        rows = rows[np.lexsort((cell[rows], n[rows]))]
        begun = np.flatnonzero(np.append(True, (np.diff(n[rows]) != 0) | (np.diff(cell[rows]) != 0))[: len(rows)])
        heads = rows[begun]
        return rows, begun, np.diff(np.append(begun, len(rows))), cell[heads].view(np.uint64), n[heads]

    left, right = cells(p), cells(q)
    bounds: dict[int, tuple] = {}
    found, open_, waiting = [], [], 0

    def close() -> None:
        i, j, need = (np.concatenate(x) for x in zip(*open_))
        for k in range(0, len(i), TOGETHER // 4):
            part = slice(k, k + TOGETHER // 4)
            keep = common_subsequence(codes, n, i[part], j[part]) >= need[part]
            found.append((at[i[part][keep]], at[j[part][keep]]))
        open_.clear()

    for a, (begun, size, length) in enumerate(zip(left[1].tolist(), left[2].tolist(), left[4].tolist())):
        if length not in bounds:
            bounds[length] = ratio_bounds(length, right[4], threshold)
        matched, unmatched = bounds[length]
        near = np.flatnonzero(np.bitwise_count(right[3] ^ left[3][a]) <= unmatched)
        if p == q:
            near = near[near >= a]
        if not len(near):
            continue
        sizes = right[2][near]
        places = np.arange(sizes.sum()) + np.repeat(right[1][near] - np.cumsum(sizes) + sizes, sizes)
        rows, most, need = right[0][places], np.repeat(unmatched[near], sizes), np.repeat(matched[near], sizes)
        letters, bound = bits[0][rows], np.minimum(most, 64).astype(np.uint8)  # as narrow as the counts
        step = max(1, TOGETHER // 8 // len(rows))
        for lo in range(begun, begun + size, step):
            mine = left[0][lo : min(lo + step, begun + size)]
            k, r = np.divmod(np.flatnonzero(np.bitwise_count(bits[0][mine][:, None] ^ letters) <= bound), len(rows))
            i, j = mine[k], rows[r]
            grams = np.bitwise_count(bits[1][i] ^ bits[1][j]).astype(np.int64) + np.bitwise_count(bits[2][i] ^ bits[2][j])
            keep = grams <= 3 * most[r]
            if p == q:
                keep &= places[r] > lo + k
            if keep.any():
                open_.append((i[keep], j[keep], need[r[keep]]))
                waiting += len(open_[-1][0])
            if waiting >= TOGETHER // 4:
                close()
                waiting = 0
    if open_:
        close()
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else ((), ())))
    return pa.table({"i": i, "j": j})


def letter_codes(names: pa.ChunkedArray, n: np.ndarray) -> np.ndarray:
    """The first 64 letters of each name as 32 codes; several letters may have one code."""
    wide = np.array(names.to_pylist(), "<U64")
    return (wide.view("<u4").reshape(len(n), 64) & 31).astype(np.uint8)


def common_subsequence(codes: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """At least the length of the longest common subsequence of names i and j, bit by bit (Crochemore and others); names of over 64 letters are not compared and get the greatest number."""
    most = np.iinfo(np.int64).max
    out = np.full(len(i), most)
    short = np.flatnonzero((n[i] <= 64) & (n[j] <= 64))
    if not len(short):
        return out
    i, j = i[short], j[short]
    of, mine = np.unique(i, return_inverse=True)
    places = np.zeros((len(of), 32), np.uint64)
    for k in range(int(n[of].max())):
        longer = np.flatnonzero(n[of] > k)
        places[longer, codes[of[longer], k]] |= np.uint64(1 << k)
    places = places.ravel()
    theirs = np.ascontiguousarray(codes[j].T)
    mine, m = mine.ravel() * 32, n[j]
    v = np.full(len(i), ~np.uint64(0))
    for k in range(int(m.max())):
        u = v & np.where(m > k, places[mine + theirs[k]], np.uint64(0))
        v = (v + u) | (v - u)
    inside = np.where(n[i] < 64, (np.uint64(1) << np.minimum(n[i], 63).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
    out[short] = np.bitwise_count(~v & inside)
    return out


def not_sentinel(c: Column) -> Column:
    return ~c.isin(*SENTINELS)


def smallest_union(df: DataFrame, term: str, row: str, k: int) -> DataFrame:
    """The k terms (of at most 26) whose rows' union is least; ties by the terms in order.

    Rows are counted by the set of terms they have (a mask), so that no term's rows are gathered.
    """
    spark = df.sparkSession
    names = [r[0] for r in df.where(F.col(term).isNotNull()).select(term).distinct().orderBy(term).limit(27).collect()]
    if len(names) > 26:
        raise ValueError("more than 26 terms")
    bit = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, 1 << i)]), F.col(term)) if names else F.lit(0)
    masks = df.where(F.col(term).isNotNull()).groupBy(row).agg(F.bit_or(bit).alias("_m")).groupBy("_m").agg(F.count(F.lit(1)).alias("_n"))
    chosen = [([names[i] for i in c], sum(1 << i for i in c)) for c in combinations(range(len(names)), k)]
    kind = df.schema[term].dataType.simpleString()
    sets = spark.createDataFrame(chosen, f"terms array<{kind}>, _t int")
    out = sets.crossJoin(masks).where(F.col("_t").bitwiseAND(F.col("_m")) != 0).groupBy("terms").agg(F.sum("_n").cast("long").alias("n_rows"))
    return out.orderBy("n_rows", "terms").limit(1)


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys both frames have (0: they are disjoint)."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("shared"))
