"""Task pools over a scoped knowledge base: candidates, golds in all scopes, fingerprints, holdouts and exposure.

Golds are computed for a whole shape at once (one grouped query with the scope as a column),
not by one query for each task. Only values whose support lies within a cap get a task, so the
list of entities in a gold is bounded by the cap in the training scope; supports are counted before any list is gathered.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import sqltext
from ..sources.stored import drop_stored, stored, tasks_for

SCOPES = ("train", "train_dev", "full")
LIST_CAP, JOIN_CAP = 40, 25


class EligibilityError(ValueError):
    """A task's SQL lies outside the pool's grammar or contradicts its own metadata."""


# Fingerprints of predicates


def canonical_tree(tree):
    """A predicate tree with AND/OR operands in canonical order; an incomplete one is an error."""
    if not isinstance(tree, dict) or tree.get("op") is None:
        raise ValueError("a predicate needs an op")
    if tree["op"] in ("AND", "OR"):
        operands = tree.get("operands")
        if not isinstance(operands, list | tuple) or not operands:
            raise ValueError(f"{tree['op']} needs operands")
        return {"op": tree["op"], "operands": sorted((canonical_tree(t) for t in operands), key=_text)}
    if "field" not in tree or "value" not in tree:
        raise ValueError(f"{tree['op']} needs a field and a value")
    return {k: tree[k] for k in sorted(tree)}


_text = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def fingerprint(task: dict, facets: tuple[str, ...] = ("operation_family", "fields_used", "values_used", "predicate", "join_arity", "answer_type", "target_columns", "entity_dependent")) -> str:
    """SHA-256 of what a task asks for, whatever its wording, aliases and the order of commutative operands."""
    whole = {}
    for f in facets:
        v = task.get(f)
        if f == "predicate":
            v = canonical_tree(v)
        elif isinstance(v, list | tuple | set):
            v = sorted(map(str, v))
        whole[f] = v
    return "fp1:" + hashlib.sha256(_text(whole).encode()).hexdigest()


@F.pandas_udf(StringType())
def fingerprints(tasks: pd.Series) -> pd.Series:
    """``fingerprint`` of tasks given as JSON texts (recursion has no column expression)."""
    return tasks.map(lambda t: None if t is None else fingerprint(json.loads(t)))


# Policy of fields and operations


@dataclass
class FieldPolicy:
    """Which operations a field's meaning allows, less those excluded."""

    allowed: dict[str, set[str]]
    excluded: dict[str, set[str]] = field(default_factory=dict)

    def permits(self, name: str, operation: str) -> bool:
        return operation in self.allowed.get(name, set()) - self.excluded.get(name, set())

    def fields_for(self, operation: str) -> list[str]:
        return sorted(f for f in self.allowed if self.permits(f, operation))

    def filter(self, df: DataFrame, field_column: str, operation_column: str) -> DataFrame:
        """Rows whose operation is permitted for their field; the policy is small configuration."""
        pairs = [f"{f}\0{o}" for f in self.allowed for o in sorted(self.allowed[f]) if self.permits(f, o)]
        return df.where(F.concat_ws("\0", field_column, operation_column).isin(pairs))


def eligible(task: dict, tables: set[str], held_operations: set[str] = frozenset(), held_sets: list[set[str]] = (), held_values: dict[str, set[str]] | None = None, children: set[str] = frozenset()) -> tuple[bool, str | None]:
    """(eligible, reason why not): held-out operations, compositions and values go; a text outside the pool's grammar is an error.

    The grammar: one SELECT over plain-named tables with explicit joins, no quoted names, no
    subquery, no common table expression, and metadata that agrees with the text.
    """
    sql = task.get("gold_sql")
    if not isinstance(sql, str) or not sql.strip():
        raise EligibilityError("no gold SQL")
    if any(kind == "name" for kind, _, _ in sqltext.spans(sql)):
        raise EligibilityError("quoted name")
    code = sqltext.masked(sql)
    words = re.findall(r"\w+|[^\w\s]", code.lower())
    if words.count("select") != 1 or "with" in words:
        raise EligibilityError("subquery or common table expression")
    if len(sqltext.split_statements(sql)) != 1:
        raise EligibilityError("more than one statement")
    after = [words[i + 1 : i + 3] for i, w in enumerate(words) if w in ("from", "join")]
    named = [a[0] for a in after if a]
    if not named or set(named) - {t.lower() for t in tables}:
        raise EligibilityError("unknown or missing table")
    stop = next((i for i, w in enumerate(words) if w in ("where", "group", "order", "limit")), len(words))
    if any(a[1:] == ["."] for a in after) or "," in words[words.index("from") : stop]:
        raise EligibilityError("qualified table or implicit join")
    if words.count("join") != task["join_arity"] or sqltext.family(sql) != task["operation_family"]:
        raise EligibilityError("metadata disagree with the text")
    if set(sqltext.families(sql)) & set(held_operations):
        return False, "held_out_operation"
    used = set(named) & set(children)
    if any(set(h) <= used for h in held_sets):
        return False, "held_out_composition"
    if used != set(task["fields_used"]) & set(children):
        raise EligibilityError("child tables disagree with the metadata")
    for name, values in sorted((held_values or {}).items()):
        if set(map(str, task["values_used"])) & set(values):
            return False, f"held_out_value:{name}"
    return True, None


# Supports and selections


def attribute_totals(children: DataFrame, entity: str, row: str, split: str, field_column: str, of: str = "train") -> DataFrame:
    """(field, n_rows, n_entities): rows and entities of one split that have the attribute at all."""
    return children.where(F.col(split) == of).groupBy(F.col(field_column).alias("field")).agg(F.count_distinct(row).alias("n_rows"), F.count_distinct(entity).alias("n_entities"))


def rarest_pair(presence: DataFrame, row: str, field_column: str, split: str, pairs: list[tuple[str, str]], min_train: int = 1, min_test: int = 1) -> DataFrame:
    """(a, b, train, test): of the given pairs of attributes, the one that fewest training rows have both of; ties by name."""
    spark = presence.sparkSession
    named = F.broadcast(spark.createDataFrame([tuple(sorted(p)) for p in pairs], "a string, b string"))
    have = presence.groupBy(row, split).agg(F.collect_set(field_column).alias("_have"))  # as many as there are fields
    both = have.crossJoin(named).where(F.array_contains("_have", F.col("a")) & F.array_contains("_have", F.col("b")))
    counts = both.groupBy("a", "b").agg(F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "test").alias("test"))
    return counts.where((F.col("train") >= min_train) & (F.col("test") >= min_test)).orderBy("train", "a", "b").limit(1)


def select_values(rows: DataFrame, term: str, row: str, entity: str, split: str, k: int, band: tuple[int, int] = (3, 15), least: dict[str, int] | None = None, floor: float = 0.0) -> list | None:
    """The ``k`` terms to hold out, None if no choice keeps the floor.

    Eligible are terms with support in ``band`` and at least ``least`` rows in each split (26 of
    them at most, or an error). Chosen is what takes the fewest training rows away, then
    the fewest training entities, then has the most development rows, then comes first by name;
    training rows that have any term must not fall below ``floor`` percent.
    """
    pairs = rows.select(term, row, entity, split).distinct()
    sides = ("train", "dev", "test")
    support = pairs.groupBy(term).agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col(split) == x).alias(x) for x in sides])
    fit = F.col("all").between(*band)
    for x, n in (least or {}).items():
        fit = fit & (F.col(x) >= n)
    eligible_terms = support.where(fit).orderBy(term).limit(27).collect()
    if len(eligible_terms) > 26:
        raise ValueError("more than 26 eligible terms")
    if len(eligible_terms) < k:
        raise ValueError(f"{len(eligible_terms)} eligible terms, {k} wanted")
    names, dev = [r[0] for r in eligible_terms], [r["dev"] for r in eligible_terms]
    train = pairs.where(F.col(split) == "train")
    bit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, 1 << i)]), F.col(term)), F.lit(0))

    def masks(key: str) -> list[tuple[int, int]]:
        """How many rows (entities) have which set of eligible terms: at most as many numbers as sets occur."""
        return [tuple(r) for r in train.groupBy(key).agg(F.bit_or(bit).alias("_m")).groupBy("_m").agg(F.count(F.lit(1)).alias("_n")).collect()]

    by_row, by_entity = masks(row), masks(entity)
    total = sum(n for _, n in by_row)
    lost = lambda own, t: sum(n for m, n in own if m & t)
    best = None
    for c in combinations(range(len(names)), k):
        t = sum(1 << i for i in c)
        gone = lost(by_row, t)
        if total and 100.0 * (total - gone) / total >= floor:
            key = (gone, lost(by_entity, t), -sum(dev[i] for i in c), [names[i] for i in c])
            best = key if best is None else min(best, key)
    return best[3] if best else None


def value_exposure(terms: DataFrame, term: str, split: str) -> DataFrame:
    """(term, exposure): ``seen`` where a training row holds the term, else ``held_out_only``."""
    seen = F.max(F.when(F.col(split) == "train", 1).otherwise(0)) == 1
    return terms.groupBy(term).agg(F.when(seen, "seen").otherwise("held_out_only").alias("exposure"))


# Exposure of operations and compositions


def operation_exposure(tasks: DataFrame, sql: str, held: list[str]) -> DataFrame:
    """(operation, n, scanned): texts that show a held-out operation, and how many were looked at; a null text is an error."""
    checked = F.when(F.col(sql).isNull(), F.raise_error(F.lit("a text is missing"))).otherwise(F.col(sql))
    names = tasks.sparkSession.createDataFrame([(h,) for h in held], "operation string")
    seen = tasks.select(sqltext.operation_families(checked).alias("_f"))
    found = seen.select(F.explode("_f").alias("operation")).groupBy("operation").agg(F.count(F.lit(1)).alias("n"))
    return names.join(F.broadcast(found), "operation", "left").na.fill(0).crossJoin(F.broadcast(seen.agg(F.count(F.lit(1)).alias("scanned"))))


def composition_exposure(components: DataFrame, task: str, component: str, held: list[list[str]]) -> DataFrame:
    """(held, n, scanned): tasks whose parts together use every component of a held-out set (superset rule)."""
    if any(not h for h in held):
        raise ValueError("an empty set is held by every task")
    used = components.groupBy(task).agg(F.array_sort(F.collect_set(component)).alias("_used"))
    names = components.sparkSession.createDataFrame([(sorted(set(h)),) for h in held], "held array<string>")
    hits = used.crossJoin(F.broadcast(names)).groupBy("held").agg(F.count_if(F.size(F.array_except("held", "_used")) == 0).alias("n"), F.count(F.lit(1)).alias("scanned"))
    return names.join(hits, "held", "left").na.fill(0).withColumn("held", F.array_join("held", "+"))


def verified_zero(found: DataFrame, count: str = "n", scanned: str = "scanned") -> int:
    """How many texts or tasks were looked at, where nothing held out was found; a find, or nothing looked at, is an error."""
    r = found.agg(F.sum(count).alias("n"), F.min(scanned).alias("s")).first()
    if r.n or not r.s:
        raise ValueError(f"{r.n} exposures in {r.s} scanned")
    return r.s


def part_union(parts: DataFrame, task: str, components: str) -> DataFrame:
    """(task, components): the union over a task's parts."""
    return parts.groupBy(task).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(components)))).alias("components"))


# Pool


def scope_level(split: str) -> Column:
    """Scopes are nested, so one number says which hold a row: training rows (1) are in all three, development rows (2) in two, all others (3) in one."""
    return F.when(F.col(split) == "train", 1).when(F.col(split) == "dev", 2).otherwise(3)


def holders(rows: DataFrame, keys: list[str], entity: str, split: str) -> DataFrame:
    """(keys, entity, level): one row for each entity of a value, with the narrowest scope that it is in."""
    return rows.where(F.col(entity).isNotNull()).groupBy(*keys, entity).agg(F.min(scope_level(split)).alias("level"))


def listed(rows: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """(keys, by scope a sorted array of entities) from ``holders``; level n is in the n-th scope and all wider ones."""
    all_ = F.sort_array(F.collect_list(F.struct(F.col(entity).cast("string").alias("m"), "level")))
    within = lambda i: F.transform(F.filter("_all", lambda x: x["level"] <= i), lambda x: x["m"])
    return rows.groupBy(*keys).agg(all_.alias("_all")).select(*keys, *[within(i).alias(s) for i, s in enumerate(SCOPES, 1)])


def _held(rows: DataFrame, keys: list[str], entity: str, split: str) -> DataFrame:
    """``holders``, stored; as many tasks as the rows ask for."""
    with tasks_for(rows.sparkSession, rows.count()):
        return stored(holders(rows, keys, entity, split), "pool-holders")


def _golds(held: DataFrame, keys: list[str], entity: str, cap: int) -> DataFrame:
    """(keys, by scope a sorted array of entities, entity_dependent) of the values that 1 to ``cap`` training entities have, from stored ``holders``.

    Supports come first, as counts; only the entities of values that fit are gathered. Both sides of that join
    are stored, so that a value with very many entities is split over tasks while it is dropped; what is left is dealt
    by its keys before it is gathered. The wider scopes' lists grow with what the held-out splits have of a value that fits.
    """
    with tasks_for(held.sparkSession, held.count()):
        fit = stored(held.groupBy(*keys).agg(F.count_if(F.col("level") == 1).alias("_n")).where(F.col("_n").between(1, cap)).select(*keys), "pool-support")
        golds = stored(listed(held.join(fit, keys).repartition(*keys), keys, entity).withColumn("entity_dependent", F.col("full") != F.col("train")), "pool-golds")
    drop_stored(held, fit)
    return golds


def filter_tasks(parent: DataFrame, table: str, entity: str, split: str, fields: list[str], cap: int = LIST_CAP) -> DataFrame:
    """One filter and one count task for each value of each field that 1 to ``cap`` training entities have."""
    long = parent.select(entity, split, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([entity, split], fields, "field", "value").where("value is not null")
    return _listed(_golds(_held(long, ["field", "value"], entity, split), ["field", "value"], entity, cap), F.lit(table), F.col("field"), entity, F.lit(f" FROM {table} WHERE "), F.lit(0), "filter", "count")


def child_tasks(child: DataFrame, parent: str, table: str, key: str, entity: str, split: str, term: str, cap: int = JOIN_CAP) -> DataFrame:
    """The same over the terms of a child table, by one join."""
    rows = child.select(entity, split, F.lit(table).alias("field"), F.col(term).cast("string").alias("value")).where("value is not null")
    source = F.lit(f" FROM {parent} JOIN {table} ON {table}.{key} = {parent}.{key} WHERE ")
    return _listed(_golds(_held(rows, ["field", "value"], entity, split), ["field", "value"], entity, cap), F.lit(table), F.lit(f"{table}.{term}"), entity, source, F.lit(1), "child_filter", "child_count")


def _listed(golds: DataFrame, fields: Column, column: Column, entity: str, source: Column, arity: Column, list_shape: str, count_shape: str) -> DataFrame:
    test = F.concat(column, F.lit(" = "), sqltext.sql_literal(F.col("value")))
    leaf = F.to_json(F.struct(F.lit("eq").alias("op"), F.col("field").alias("field"), F.col("value").alias("value")))
    common = [F.array("field").alias("fields_used"), F.array("value").alias("values_used"), leaf.alias("predicate"), arity.alias("join_arity"), "entity_dependent"]
    rows = golds.select(F.lit(list_shape).alias("shape"), F.concat(F.lit(f"SELECT DISTINCT {entity}"), source, test, F.lit(f" ORDER BY {entity}")).alias("gold_sql"), F.lit("set").alias("answer_type"), F.lit(entity).alias("target"), *common, *SCOPES)
    sizes = [F.array(F.size(s).cast("string")).alias(s) for s in SCOPES]
    counted = [*common[:-1], (F.size("full") != F.size("train")).alias("entity_dependent")]
    counts = golds.select(F.lit(count_shape).alias("shape"), F.concat(F.lit(f"SELECT COUNT(DISTINCT {entity}) AS n"), source, test).alias("gold_sql"), F.lit("scalar").alias("answer_type"), F.lit("n").alias("target"), *counted, *sizes)
    return rows.unionByName(counts)


def breakdown_tasks(parent: DataFrame, table: str, entity: str, split: str, fields: list[str], cap: int = LIST_CAP) -> DataFrame:
    """A group-by and an argmax task for each field with 1 to ``cap`` values in training: ``value|n`` rows in order."""
    long = parent.select(entity, split, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([entity, split], fields, "field", "value").where("value is not null")
    counts = holders(long, ["field", "value"], entity, split).groupBy("field", "value").agg(*[F.count_if(F.col("level") <= i).alias(s) for i, s in enumerate(SCOPES, 1)])
    # Fields with too many values go before anything is ranked or gathered.
    fit = counts.groupBy("field").agg(F.count_if(F.col("train") > 0).alias("_n")).where(F.col("_n").between(1, cap)).select("field")
    n = counts.join(F.broadcast(fit), "field").unpivot(["field", "value"], list(SCOPES), "scope", "n").where("n > 0")  # at most as many as fields
    ranked = n.withColumn("r", F.row_number().over(Window.partitionBy("field", "scope").orderBy(F.desc("n"), "value")))
    row = F.concat_ws("|", "value", "n")

    def shaped(rows: DataFrame, shape: str, kind: str, order: str) -> DataFrame:
        lists = rows.groupBy("field").pivot("scope", list(SCOPES)).agg(F.array_sort(F.collect_list(F.struct(F.col("r") if kind == "top_k" else F.col("value"), row.alias("row")))))
        out = lists.select("field", *[F.coalesce(F.transform(s, lambda x: x["row"]), F.array().cast("array<string>")).alias(s) for s in SCOPES])
        sql = F.concat(F.lit("SELECT "), "field", F.lit(f", COUNT(DISTINCT {entity}) AS n FROM {table} GROUP BY "), "field", F.lit(order))
        return out.select(
            F.lit(shape).alias("shape"), sql.alias("gold_sql"), F.lit(kind).alias("answer_type"), F.concat(F.col("field"), F.lit(",n")).alias("target"), F.array("field").alias("fields_used"), F.array().cast("array<string>").alias("values_used"),
            F.to_json(F.struct(F.lit(shape).alias("op"), "field", F.col("field").alias("value"))).alias("predicate"), F.lit(0).alias("join_arity"), (F.col("full") != F.col("train")).alias("entity_dependent"), *SCOPES,
        )

    grouped = shaped(ranked, "group_by", "set", "")
    return grouped.unionByName(shaped(ranked.where("r = 1"), "argmax", "top_k", " ORDER BY n DESC, 1 LIMIT 1"))


def measure_tasks(parent: DataFrame, table: str, entity: str, split: str, measure: str, ks=(3, 5, 10), cap: int = LIST_CAP) -> DataFrame:
    """Threshold tasks at the training quartiles (those that 1 to ``cap`` rows pass) and top-k tasks."""
    from .stats import at_ranks

    rows = parent.select(entity, measure, split, scope_level(split).alias("level"))
    marks = at_ranks(parent.where(F.col(split) == "train"), measure, {"a": (1, 4), "b": (1, 2), "c": (3, 4)}).select(F.explode(F.array_compact(F.array_distinct(F.array("a", "b", "c")))).alias("value"))
    passed = rows.join(F.broadcast(marks), F.col(measure) > F.col("value"))
    support = passed.where("level = 1").groupBy("value").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(1, cap)).select("value")  # three marks at most
    lists = listed(holders(passed.join(F.broadcast(support), "value"), ["value"], entity, split), ["value"], entity)
    above = lists.select(F.lit("threshold").alias("shape"), F.concat(F.lit(f"SELECT {entity} FROM {table} WHERE {measure} > "), F.col("value").cast("string")).alias("gold_sql"), F.lit("set").alias("answer_type"), F.lit(entity).alias("target"), F.lit("gt").alias("op"), F.col("value").cast("string").alias("value"), *SCOPES)
    spark = parent.sparkSession
    k = F.broadcast(spark.createDataFrame([(int(x),) for x in ks], "k int"))
    top = [rows.where(F.col("level") <= i).orderBy(F.desc(measure), entity).limit(max(ks)).withColumn("scope", F.lit(s)) for i, s in enumerate(SCOPES, 1)]
    best = reduce(DataFrame.unionAll, top).withColumn("r", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc(measure), entity))).join(k, F.col("r") <= F.col("k"))
    ranked = best.groupBy("k").pivot("scope", list(SCOPES)).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws("|", F.col(entity).cast("string"), F.col(measure).cast("string")).alias("row")))), lambda x: x["row"]))
    top = ranked.select(F.lit("topk").alias("shape"), F.concat(F.lit(f"SELECT {entity}, {measure} FROM {table} ORDER BY {measure} DESC, {entity} LIMIT "), F.col("k").cast("string")).alias("gold_sql"), F.lit("top_k").alias("answer_type"), F.lit(f"{entity},{measure}").alias("target"), F.lit("topk").alias("op"), F.col("k").cast("string").alias("value"), *SCOPES)
    both = above.unionByName(top)
    return both.select("shape", "gold_sql", "answer_type", "target", F.array(F.lit(measure)).alias("fields_used"), F.array("value").alias("values_used"), F.to_json(F.struct("op", F.lit(measure).alias("field"), "value")).alias("predicate"), F.lit(0).alias("join_arity"), (~F.col("full").eqNullSafe(F.col("train"))).alias("entity_dependent"), *SCOPES)


def composition_tasks(a: DataFrame, b: DataFrame, parent: str, names: tuple[str, str], entity: str, split: str, terms: tuple[str, str], cap: int = JOIN_CAP) -> DataFrame:
    """A task for each pair of terms of two child tables that 1 to ``cap`` training entities hold both of.

    An entity's level is told before its terms are paired, so the pairs are distinct as they come and are shuffled for their supports and lists only.
    """
    x = _held(a.select(entity, split, F.col(terms[0]).cast("string").alias("va")).where("va is not null"), ["va"], entity, split)
    y = b.select(entity, F.col(terms[1]).cast("string").alias("vb")).where("vb is not null").distinct()
    with tasks_for(a.sparkSession, x.count()):
        held = stored(x.join(y, entity), "pool-holders")
    drop_stored(x)
    golds = _golds(held, ["va", "vb"], entity, cap)
    (ta, tb), (fa, fb) = names, terms
    sql = F.concat(
        F.lit(f"SELECT DISTINCT {parent}.{entity} FROM {parent} JOIN {ta} ON {ta}.{entity} = {parent}.{entity} JOIN {tb} ON {tb}.{entity} = {parent}.{entity} WHERE {ta}.{fa} = "), sqltext.sql_literal(F.col("va")),
        F.lit(f" AND {tb}.{fb} = "), sqltext.sql_literal(F.col("vb")), F.lit(f" ORDER BY {parent}.{entity}"),
    )
    leaf = lambda f, v: F.struct(F.lit("eq").alias("op"), F.lit(f).alias("field"), F.col(v).alias("value"))
    tree = F.to_json(F.struct(F.lit("AND").alias("op"), F.array(leaf(ta, "va"), leaf(tb, "vb")).alias("operands")))
    return golds.select(F.lit("composition").alias("shape"), sql.alias("gold_sql"), F.lit("set").alias("answer_type"), F.lit(entity).alias("target"), F.array(F.lit(ta), F.lit(tb)).alias("fields_used"), F.array("va", "vb").alias("values_used"), tree.alias("predicate"), F.lit(2).alias("join_arity"), "entity_dependent", *SCOPES)


def distinct_sql(pool: DataFrame) -> DataFrame:
    """One row a SQL text. Hashes find the texts that may be there twice, and only those rows are shuffled with their lists."""
    tag = F.xxhash64("gold_sql").alias("_tag")
    twice = stored(pool.groupBy(tag).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_tag"), "pool-twice")
    if twice.isEmpty():
        return pool
    tagged = pool.withColumn("_tag", tag)
    again = tagged.join(twice, "_tag", "left_semi").dropDuplicates(["gold_sql"])
    return tagged.join(twice, "_tag", "left_anti").unionByName(again).select(*pool.columns)


def finished(pool: DataFrame, prefix: str = "task") -> DataFrame:
    """Add task_id (of the SQL text, so the same in every run), operation_family and fingerprint; a SQL text twice is an error elsewhere, here it is one task."""
    family = sqltext.operation_family(F.col("gold_sql"))
    facts = ["operation_family", "fields_used", "values_used", F.parse_json("predicate").alias("predicate"), "join_arity", "answer_type", F.split("target", ",").alias("target_columns"), "entity_dependent"]
    out = distinct_sql(pool).withColumn("operation_family", family)
    return out.withColumn("task_id", F.concat_ws("_", F.lit(prefix), "shape", F.substring(F.sha2("gold_sql", 256), 1, 12))).withColumn("fingerprint", fingerprints(F.to_json(F.struct(*facts))))


# Renders


def prose(answer_type: Column, gold: Column) -> Column:
    """The gold as a sentence: a count, a list, or none."""
    listed = F.when(F.size(gold) == 0, "No companies match.").otherwise(F.concat(F.lit("The companies are: "), F.array_join(gold, "; "), F.lit(".")))
    return F.when(answer_type == "scalar", F.concat(F.lit("The answer is "), F.coalesce(F.try_element_at(gold, F.lit(1)), F.lit("0")), F.lit("."))).when(answer_type == "set", listed)


def examples(tasks: DataFrame, question: Column, answer: Column, system: str) -> DataFrame:
    """Add ``messages``: system, question, answer."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return tasks.withColumn("messages", F.array(turn("system", F.lit(system)), turn("user", question), turn("assistant", answer)))


def passages(df: DataFrame, key: str, fields: list[str], sentinels: tuple[str, ...] = ()) -> DataFrame:
    """(key, text): one passage a row, ``field: value.`` for each field that says something."""
    said = [F.when(F.col(f).isNotNull() & ~F.col(f).cast("string").isin(*sentinels, ""), F.concat(F.lit(f + ": "), F.col(f).cast("string"), F.lit("."))) for f in fields]
    return df.select(key, F.concat_ws(" ", *said).alias("text"))


def factual_questions(df: DataFrame, row: str, entity: str, fields: list[str]) -> DataFrame:
    """(id, entity, field, value, rows, conflicting): one question for each entity and field where all rows agree, else one for each row."""
    long = df.select(row, entity, *[F.col(f).cast("string").alias(f) for f in fields]).withColumn("_r", F.col(row)).unpivot([row, entity], fields, "field", "value") if fields else df
    agreed = long.groupBy(entity, "field").agg(F.count_distinct(F.coalesce("value", F.lit("\0"))).alias("_n"), F.min("value").alias("value"), F.array_sort(F.collect_set(row)).alias("rows"))
    one = agreed.where("_n = 1").select(F.concat_ws("_", F.col(entity).cast("string"), "field").alias("id"), entity, "field", "value", "rows", F.lit(False).alias("conflicting"))
    each = long.join(agreed.where("_n > 1").select(entity, "field"), [entity, "field"], "left_semi")
    return one.unionByName(each.select(F.concat_ws("_", F.col(entity).cast("string"), "field", F.lit("record"), F.col(row).cast("string")).alias("id"), entity, "field", "value", F.array(row).alias("rows"), F.lit(True).alias("conflicting")))


def probes(pool: DataFrame, held_operations: list[str], exposure: DataFrame | None = None) -> DataFrame:
    """Tasks with the probe they belong to: no_match first, then held-out operations, compositions, value exposure, held-in."""
    x = pool
    if exposure is not None:
        x = pool.withColumn("_v", F.try_element_at("values_used", F.lit(1))).join(exposure.select(F.col(exposure.columns[0]).cast("string").alias("_v"), "exposure"), "_v", "left").drop("_v")
    else:
        x = pool.withColumn("exposure", F.lit(None).cast("string"))
    kind = F.when((F.col("answer_type") == "set") & (F.size("full") == 0), "no_match").when(F.col("operation_family").isin(held_operations), "operation").when(F.col("join_arity") >= 2, "composition").when(F.col("exposure") == "held_out_only", "value_exposure").otherwise("held_in")
    return x.withColumn("probe", kind)


def tautologies(tasks: DataFrame, task: str, question: str, gold: str) -> DataFrame:
    """Tasks whose question holds one of its own gold cells."""
    return tasks.select(task, F.lower(question).alias("_q"), F.explode(gold).alias("_g")).where((F.trim("_g") != "") & F.col("_q").contains(F.lower("_g"))).select(task).distinct()


def exposure_labels(labels: Column) -> Column:
    """Sorted distinct labels; no_match excludes all others, trained excludes every held-out one."""
    clean = F.array_sort(F.array_distinct(labels))
    alone = F.array_contains(clean, "no_match") & (F.size(clean) > 1)
    both = F.array_contains(clean, "trained") & F.exists(clean, lambda x: x.startswith("held_out"))
    return F.when(alone | both, F.raise_error(F.concat(F.lit("labels exclude each other: "), F.array_join(clean, ",")))).otherwise(clean)


def paraphrase(question: Column, changes: dict[str, str]) -> Column:
    """A question with phrases exchanged, in order."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), changes.items(), question)


def task_kind(task_id: Column) -> Column:
    """The shape between the second and third underscore-separated parts of an id; ``none`` where there is no such part."""
    found = F.regexp_extract(task_id, r"_v\d+_([a-z]+)_", 1)
    return F.when(found == "", "none").otherwise(found)
