"""Identity of records by name: collision sweeps, their review, groups, and splits that keep groups whole.

A *candidate* is a set of distinct names that one sweep holds for one identity: the same detection
key (``suffix_key``), the same first token (``first_token``), tokens that begin with another name's (``token_prefix``),
or a similar spelling (``ratio``, pairs). Candidates are kept as memberships (sweep, hub, name), one row a name,
so a token that a million names start with costs a million rows and no pairs.

Names are compared as they stand; null is no name and no candidate. A name without letters
or digits has no tokens: it meets others by its (empty) detection key and by spelling only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SENTINELS, name_key, tokens
from ..sources.stored import drop_stored, stored
from .relational import digest_rank, ratio_pairs

SWEEPS = ("suffix_key", "first_token", "token_prefix", "ratio")


def _large(df: DataFrame) -> DataFrame:
    """A table of names or groups as a join's other side: it grows with the input, so it is shuffled however small its files look, and doesn't go through the driver."""
    return df.hint("merge")


def names_of(rows: DataFrame, name: str) -> DataFrame:
    """Distinct names as one column ``name``."""
    return rows.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()


def collision_candidates(names: DataFrame, sweeps: tuple[str, ...] = SWEEPS, threshold: float = 0.86) -> DataFrame:
    """(sweep, hub, name): candidates of two names at least, from distinct ``names``."""
    found = None
    words = names.select("name", tokens(F.col("name")).alias("w"))
    for sweep in sweeps:
        if sweep == "suffix_key":
            rows = names.select(name_key(F.col("name")).alias("hub"), "name")
        elif sweep == "first_token":
            rows = words.where(F.size("w") > 0).select(F.col("w")[0].alias("hub"), "name")
        elif sweep == "token_prefix":
            starts = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", 1, i), " "))
            whole = words.where(F.size("w") > 0).select(F.array_join("w", " ").alias("hub")).distinct()
            rows = words.where(F.size("w") > 0).select(F.explode(starts).alias("hub"), "name").join(_large(whole), "hub")
        elif sweep == "ratio":
            pairs = stored(ratio_pairs(names.select(F.col("name").alias("key"), "name"), "key", "name", threshold).select("a", "b"), "identity-alike")
            rows = pairs.select(F.concat_ws("\0", "a", "b").alias("hub"), F.explode(F.array("a", "b")).alias("name"))
        else:
            raise ValueError(f"no sweep {sweep!r}")
        if sweep != "ratio":  # of two names anyway
            several = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("hub")
            rows = rows.join(_large(several), "hub")
        rows = rows.select(F.lit(sweep).alias("sweep"), "hub", "name")
        found = rows if found is None else found.unionByName(rows)
    return found


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(name, group): each name with the least name it is connected to, from memberships (hub, name).

    A hub becomes a star around its least name; then large and small stars take turns (every name is
    tied to the least of its neighbours) until all ties lead to a least name. A round is aggregates and
    joins on names; what a round reads is stored, so skewed joins are split and nothing is computed twice.
    """
    hubs = links.select("hub", "name").distinct()
    least = hubs.groupBy("hub").agg(F.min("name").alias("least"))
    alone = hubs.select("name").distinct()
    edges = stored(hubs.join(_large(least), "hub").where("name <> least").select(F.col("name").alias("a"), F.col("least").alias("b")).distinct(), "identity-edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    seen = mark(edges)
    for _ in range(most_rounds):
        # Large star: neighbours above a name are tied to its least neighbour.
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "identity-low")
        large = stored(both.where("b > a").join(_large(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "identity-large")
        # Small star: a name and its lower neighbours are tied to the least of those.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low2 = stored(down.groupBy("a").agg(F.min("b").alias("m")), "identity-low")
        own = low2.select("a", F.col("m").alias("b"))
        lower = down.join(_large(low2), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new = stored(own.union(lower).distinct(), "identity-edges")
        drop_stored(edges, low, large, low2)
        edges, before, seen = new, seen, mark(new)
        if seen == before:
            return alone.join(_large(edges.select(F.col("a").alias("name"), F.col("b").alias("group"))), "name", "left").select("name", F.coalesce("group", "name").alias("group"))
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")


def identity_groups(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, group) for all distinct ``names``: names connected by candidates share the least of them.

    Pairs (``ratio``) with one first name are one star around it, which connects the same names in fewer rows.
    """
    parts = F.split("hub", "\0")
    hub = F.when((F.col("sweep") == "ratio") & (F.size(parts) == 2), parts[0]).otherwise(F.col("hub"))
    found = components(candidates.select(F.concat_ws("\0", "sweep", hub).alias("hub"), "name"))
    return names.join(_large(found), "name", "left").select("name", F.coalesce("group", "name").alias("group"))


def dispositions(candidates: DataFrame, approved: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(sweep, hub, n, disposition) of each candidate against sets that were looked at, frames of (label, name).

    ``approved`` or ``reviewed`` where such a set holds just the candidate's names, ``approved_subset`` or
    ``reviewed_subset`` where it holds more, in that order (a whole set before a part of one); else ``unmapped``.
    """
    size = candidates.groupBy("sweep", "hub").agg(F.count_distinct("name").alias("n"))
    kinds = {"approved": approved, "reviewed": reviewed}
    sets = None
    for kind, frame in kinds.items():
        own = frame.select(F.lit(kind).alias("kind"), "label", "name").distinct()
        sets = own if sets is None else sets.unionByName(own)
    whole = sets.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("of"))
    held = candidates.select("sweep", "hub", "name").distinct().join(sets, "name").groupBy("sweep", "hub", "kind", "label").agg(F.count(F.lit(1)).alias("held")).join(whole, ["kind", "label"])
    names = ["approved", "reviewed", "approved_subset", "reviewed_subset"]
    rank = F.when(F.col("kind") == "approved", 0).otherwise(1) + F.when(F.col("of") == F.col("held"), 0).otherwise(2)
    best = held.join(size, ["sweep", "hub"]).where("held = n").groupBy("sweep", "hub").agg(F.min(rank).alias("rank"))
    said = F.element_at(F.array(*map(F.lit, names)), F.col("rank") + 1)
    return size.join(best, ["sweep", "hub"], "left").select("sweep", "hub", "n", F.when(F.col("rank").isNull(), "unmapped").otherwise(said).alias("disposition"))


def approved_groups(names: DataFrame, approved: DataFrame) -> DataFrame:
    """(name, group): the label of a name's approved set, else the name itself. A set's name that does not occur, or that two sets hold, is an error."""
    sets = approved.select("label", "name").distinct()
    several = sets.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).collect()
    absent = sets.join(names, "name", "left_anti").limit(1).collect()
    if several or absent:
        raise ValueError(f"approved sets: {'two hold ' + several[0].name if several else 'no record has ' + absent[0].name!r}")
    return names.join(sets, "name", "left").select("name", F.coalesce("label", "name").alias("group"))


def referenced_names(names: DataFrame, rows: DataFrame, reference: str, nobody: tuple[str, ...] = SENTINELS) -> DataFrame:
    """Names that another column names exactly; ``nobody``: its values that name none."""
    used = rows.where(F.col(reference).isNotNull() & ~F.col(reference).isin(*nobody)).select(F.col(reference).alias("name"))
    return names.join(_large(used.distinct()), "name", "left_semi")


def uncovered_references(names: DataFrame, rows: DataFrame, reference: str, nobody: tuple[str, ...] = SENTINELS) -> DataFrame:
    """(value, missing): values of the column that name nobody exactly and hold tokens that no referenced name has."""
    values = rows.where(F.col(reference).isNotNull() & ~F.col(reference).isin(*nobody)).select(F.col(reference).alias("value")).distinct()
    known = referenced_names(names, rows, reference, nobody).select(F.explode(tokens(F.col("name"))).alias("token")).distinct()
    open_ = values.join(names.select(F.col("name").alias("value")), "value", "left_anti")
    return open_.select("value", F.explode(tokens(F.col("value"))).alias("token")).distinct().join(known, "token", "left_anti").groupBy("value").agg(F.array_sort(F.collect_list("token")).alias("missing"))


def assign_group_splits(rows: DataFrame, row: str, group: str, stratum: str, salt: str, forced: DataFrame | None = None, dev: float = 0.1, test: float = 0.2) -> DataFrame:
    """Add ``split`` and ``held_in``: all rows of a group are in one split, whatever the group's size.

    Groups of ``forced`` (a column of that name) are placed first, in training, and so are rows without a group. Every other
    group belongs to the stratum of its first row (least ``row``); in each stratum groups are ranked by a digest,
    the first share becomes dev, the next test, the rest train. Shares are of groups and rounded half to even.
    """
    first = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(stratum, row).alias("_stratum"))
    free, held = first, None
    if forced is not None:
        held = forced.select(F.col(group)).where(F.col(group).isNotNull()).distinct()
        free = first.join(_large(held), group, "left_anti")
    ranked = digest_rank(free, "_stratum", F.md5(F.concat(F.lit(salt), F.col(group).cast("string"))), group)
    placed = stored(ranked.select(group, split_of(dev, test).alias("split")), "group-splits")
    out = rows.join(_large(placed), group, "left").select(*rows.columns, F.coalesce("split", F.lit("train")).alias("split"))
    if held is None:
        return out.withColumn("held_in", F.lit(False))
    return out.join(_large(held.withColumn("_held", F.lit(True))), group, "left").select(*out.columns, F.coalesce("_held", F.lit(False)).alias("held_in"))


def split_of(dev: float, test: float) -> Column:
    """The split of ``rank`` among ``of`` in its stratum."""
    a, b = F.bround(F.col("of") * dev), F.bround(F.col("of") * test)
    return F.when(F.col("rank") <= a, "dev").when(F.col("rank") <= a + b, "test").otherwise("train")


def split_checks(rows: DataFrame, name: str, group: str, row: str, split: str = "split", held_in: str = "held_in") -> DataFrame:
    """One row of counts that a sound split has as 0: names and groups in two splits, repeated rows, held-in groups outside training, empty splits."""
    sides = ("train", "dev", "test")
    apart = lambda key: rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(split).alias("x"), F.max(split).alias("y")).agg(F.count_if(F.col("x") != F.col("y")))
    once = rows.groupBy(row).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_rows"))
    counts = rows.agg(F.count_if(F.col(held_in) & (F.col(split) != "train")).alias("misplaced"), *[F.count_if(F.col(split) == s).alias(s) for s in sides])
    empty = counts.select("misplaced", sum(F.when(F.col(s) == 0, 1).otherwise(0) for s in sides).cast("long").alias("empty_splits"))
    return apart(name).toDF("names_apart").crossJoin(apart(group).toDF("groups_apart")).crossJoin(once).crossJoin(empty)  # one row each
