"""Probes of an evaluation: facts asked again and in other words, structured tasks by what of them was held out, values by
their exposure, names that nothing has; and the checks that keep all of these apart from training and from each other.

Probes are rows of one schema (``COLUMNS``), so that families are united, checked and written as one table. Sentences
are a parameter (``Wording``): texts with places in braces.

Defined results: a row without a key or a name makes no fact probe; a fact that repeated rows state
differently makes none either (there is no right answer), one that none of them states is answered by
``Wording.missing``; empty tables give no probes, and every check is a row even then, with 0.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sqltext
from ..sources.stored import once, stored
from .tasks import LIST_CAP, holders, listed

COLUMNS = ("example_id", "family", "scope", "exposure", "entity", "question", "answer", "gold_sql", "fingerprint", "join_arity")


@dataclass(frozen=True)
class Wording:
    """Sentences of probes; places are ``row``, ``entity``, ``field``, ``value`` (``other_field``, ``other_value`` in ``both``)."""

    recall: str = "What is the {field} of {entity} in row {row}?"
    paraphrase: str = "Row {row} is about {entity}. Name its {field}, or say that none is on record."
    missing: str = "None is on record."
    members: str = "Name all whose {field} is {value}."
    size: str = "How many have {value} as their {field}?"
    both: str = "Name all that have {value} as {field} and {other_value} as {other_field}."
    absent: str = "Which rows are named exactly {entity}?"


def filled(template: str, **places: Column | str) -> Column:
    """A sentence with its places filled by columns; null if one of those is."""
    parts = []
    for words, place, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(words))
        if place is not None:
            c = places[place]
            parts.append((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.concat(*parts)


def _spoken(field: Column) -> Column:
    return F.replace(field, F.lit("_"), F.lit(" "))


def _shaped(df: DataFrame) -> DataFrame:
    """The common columns, those that a family lacks as nulls."""
    kinds = {"exposure": "array<string>", "answer": "array<string>", "join_arity": "int"}
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


# Facts


def fact_probes(df: DataFrame, row: str, entity: str, split: str, fields: list[str], table: str, wording: Wording = Wording()) -> DataFrame:
    """Each field of each row asked for: ``dev_fact`` for development rows, else ``fact_recall`` and ``fact_paraphrase``.

    Repeated rows of one key are compared through least and largest values, so that a frequent key is aggregated
    before it is shuffled and no list of its values is made.
    """
    long = df.where(F.col(row).isNotNull() & F.col(entity).isNotNull()).select(
        F.col(row).cast("string").alias("_row"), F.col(entity).cast("string").alias("_entity"), F.col(split).cast("string").alias("_split"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("f"),
    ).select("_row", "_entity", "_split", "f.field", "f.value")
    same = lambda c: F.min(c).eqNullSafe(F.max(c))
    facts = long.groupBy("_row", "field").agg(
        F.min("_entity").alias("entity"), F.min("_split").alias("split"), F.min("value").alias("value"),
        (same("_entity") & same("_split") & same("value") & F.count("value").isin(0, F.count(F.lit(1)))).alias("_agreed"),
    ).where("_agreed")
    dev = F.col("split") == "dev"
    asked = facts.withColumn("_kinds", F.when(dev, F.array(F.lit("dev_fact"))).otherwise(F.array(F.lit("fact_recall"), F.lit("fact_paraphrase"))))
    asked = asked.withColumn("family", F.explode("_kinds"))
    places = {"row": F.col("_row"), "entity": F.col("entity"), "field": _spoken(F.col("field"))}
    key = F.when(F.lit(dict(df.dtypes)[row] == "string"), sqltext.sql_literal(F.col("_row"))).otherwise(F.col("_row"))
    return _shaped(asked.select(
        F.concat_ws("_", "family", "_row", "field").alias("example_id"), "family", F.when(dev, "train_dev").otherwise("full").alias("scope"),
        F.array(F.when(F.col("split") == "train", "trained_fact").otherwise("held_out_entity")).alias("exposure"), "entity",
        F.when(F.col("family") == "fact_paraphrase", filled(wording.paraphrase, **places)).otherwise(filled(wording.recall, **places)).alias("question"),
        F.array(F.coalesce("value", F.lit(wording.missing))).alias("answer"),
        F.concat(F.lit("SELECT "), "field", F.lit(f" AS value FROM {table} WHERE {row} = "), key).alias("gold_sql"),
    ))


# Structured tasks


def reserved(tasks: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` tasks of least id, kept as examples for prompts: no probe may ask them."""
    return tasks.orderBy("task_id").limit(n)


def without(probes: DataFrame, kept_back: DataFrame) -> DataFrame:
    """Probes that ask none of the tasks kept back, by fingerprint and by SQL text (a bounded table: ``reserved``)."""
    for c in ("fingerprint", "gold_sql"):
        probes = probes.join(F.broadcast(kept_back.select(c).where(f"{c} IS NOT NULL")), c, "left_anti")
    return probes


def structured_probes(pool: DataFrame, trained: Column, held_operations: list[str], wording: Wording = Wording(), n_reserved: int = 5) -> DataFrame:
    """Probes from a finished pool (``tasks.finished``): each task has one family, and trained ones a paraphrase beside it.

    ``operation``: its kind of SQL was held out; ``composition``: joins two child tables; ``held_in``: trained (gold of the
    training scope; the others' is of the full one). Tasks that are none of these, and the reserved ones, make no probe.
    The SQL stands for the question where a sentence would only repeat it.
    """
    kind = F.when(F.col("operation_family").isin(held_operations), "operation").when(F.col("join_arity") >= 2, "composition").when(trained, "held_in")
    # The pool is stored before anything is chosen from it: its SQL is scanned, and its fingerprints are made, once.
    tasks = once(pool, "probe-pool").withColumn("family", kind).where("family IS NOT NULL")
    rest = without(tasks, stored(reserved(tasks.where("family = 'held_in'").select("task_id", "gold_sql", "fingerprint"), n_reserved), "probe-reserved"))
    held_in = F.col("family") == "held_in"
    one = (F.size("fields_used") == 1) & (F.size("values_used") == 1) & F.try_variant_get(F.parse_json("predicate"), "$.op", "string").eqNullSafe("eq")
    two = (F.size("fields_used") == 2) & (F.size("values_used") == 2)
    at = lambda c, i: F.get(c, F.lit(i))
    places = {"field": _spoken(at("fields_used", 0)), "value": at("values_used", 0), "other_field": _spoken(at("fields_used", 1)), "other_value": at("values_used", 1)}
    said = F.when(two, filled(wording.both, **places)).when(one & (F.col("answer_type") == "scalar"), filled(wording.size, **places)).when(one, filled(wording.members, **places))
    # A threshold or a ranking is no equality: such a task has no paraphrase here.
    kinds = F.array_compact(F.array(F.col("family"), F.when(held_in & said.isNotNull(), "structured_paraphrase")))
    rows = rest.withColumn("_said", said).withColumn("_own", F.explode(kinds))
    by_sentence = F.col("_own").isin("structured_paraphrase", "composition") & F.col("_said").isNotNull()
    return _shaped(rows.select(
        F.concat_ws("_", "_own", "task_id").alias("example_id"), F.col("_own").alias("family"), F.when(held_in, "train").otherwise("full").alias("scope"),
        F.array(F.when(held_in, "trained").otherwise(F.concat(F.lit("held_out_"), "family"))).alias("exposure"),
        F.when(by_sentence, F.col("_said")).otherwise(F.col("gold_sql")).alias("question"), F.when(held_in, F.col("train")).otherwise(F.col("full")).alias("answer"), "gold_sql", "fingerprint", "join_arity",
    ))


def value_probes(rows: DataFrame, table: str, field: str, entity: str, split: str, wording: Wording = Wording(), cap: int = LIST_CAP) -> DataFrame:
    """Every value of a field in the full scope, labelled by whether training rows have it.

    Up to ``cap`` entities are asked for by name; of a value with more the number is asked, so that no answer grows with
    the table. Counts come first; lists are gathered for values that fit only.
    """
    x = rows.select(entity, split, F.col(field).cast("string").alias("value")).where("value IS NOT NULL")
    held = stored(holders(x, ["value"], entity, split), "probe-holders")
    counts = stored(held.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == 1).alias("n_train")), "probe-values")
    lists = listed(held.join(counts.where(F.col("n") <= cap).select("value"), "value"), ["value"], entity).select("value", "full")
    places = {"field": _spoken(F.lit(field)), "value": F.col("value")}
    test = F.concat(F.lit(f" FROM {table} WHERE {field} = "), sqltext.sql_literal(F.col("value")))
    few = F.col("n") <= cap
    return _shaped(counts.join(lists, "value", "left").select(
        F.concat_ws("_", F.lit("value"), F.lit(field), F.substring(F.sha2("value", 256), 1, 16)).alias("example_id"), F.lit("value_exposure").alias("family"), F.lit("full").alias("scope"),
        F.array(F.when(F.col("n_train") > 0, "seen_in_training").otherwise("held_out_only")).alias("exposure"),
        F.when(few, filled(wording.members, **places)).otherwise(filled(wording.size, **places)).alias("question"),
        F.when(few, F.col("full")).otherwise(F.array(F.col("n").cast("string"))).alias("answer"),
        F.when(few, F.concat(F.lit(f"SELECT DISTINCT {entity}"), test, F.lit(f" ORDER BY {entity}"))).otherwise(F.concat(F.lit(f"SELECT COUNT(DISTINCT {entity}) AS n"), test)).alias("gold_sql"), F.lit(0).alias("join_arity"),
    ))


def no_match_probes(parent: DataFrame, table: str, name: str, n: int, stem: str, wording: Wording = Wording()) -> DataFrame:
    """``n`` questions that nothing answers: the first names ``stem`` and a number that no row has."""
    names = parent.select(F.col(name).alias("entity")).where(F.col("entity").startswith(stem)).distinct()
    made = parent.sparkSession.range(n + names.count()).select(F.col("id"), F.concat_ws(" ", F.lit(stem), F.lpad(F.col("id").cast("string"), 6, "0")).alias("entity"))
    free = made.join(names, "entity", "left_anti").orderBy("id").limit(n)
    return _shaped(free.select(
        F.concat_ws("_", F.lit("no_match"), "id").alias("example_id"), F.lit("no_match").alias("family"), F.lit("full").alias("scope"), F.array(F.lit("no_match")).alias("exposure"), "entity",
        filled(wording.absent, entity="entity").alias("question"), F.array().cast("array<string>").alias("answer"),
        F.concat(F.lit(f"SELECT {name} FROM {table} WHERE {name} = "), sqltext.sql_literal(F.col("entity"))).alias("gold_sql"), F.lit(0).alias("join_arity"),
    ))


# Checks


def probe_checks(probes: DataFrame, trained_questions: DataFrame, kept_back: DataFrame | None = None) -> DataFrame:
    """(check, n): how often each rule is broken; all 0 means that the probes may be used.

    ``trained_questions`` has one column; recall and held-in probes may repeat a trained question, all others must not.
    """
    probes = stored(probes, "probes")
    fact = lambda *kinds: F.col("family").isin(*kinds)
    asked = probes.select("question", (~fact("fact_recall", "held_in")).alias("fresh"), fact("fact_recall").alias("recall"), fact("fact_paraphrase").alias("para"), F.lit(False).alias("taught"))
    taught = trained_questions.select(F.col(trained_questions.columns[0]).alias("question"), *[F.lit(False).alias(c) for c in ("fresh", "recall", "para")], F.lit(True).alias("taught"))
    # One row a question and an entity, whatever the number of probes that share it.
    questions = asked.unionByName(taught).where("question IS NOT NULL").groupBy("question").agg(*[F.max(c).alias(c) for c in ("fresh", "recall", "para", "taught")])
    entities = probes.where("entity IS NOT NULL").groupBy("entity").agg(F.max(fact("dev_fact")).alias("dev"), F.max(fact("fact_recall", "fact_paraphrase")).alias("used"))
    ids = probes.groupBy("example_id").agg(F.count(F.lit(1)).alias("n"))
    found = [
        questions.agg(F.count_if(F.col("fresh") & F.col("taught")).alias("asked_in_training"), F.count_if(F.col("recall") & F.col("para")).alias("paraphrase_is_recall")),
        entities.agg(F.count_if(F.col("dev") & F.col("used")).alias("development_entity_elsewhere")),
        ids.agg(F.count_if(F.col("example_id").isNull() | (F.col("n") > 1)).alias("repeated_or_null_id")),
        probes.agg(
            F.count_if(F.col("question").isNull() | F.col("answer").isNull()).alias("without_question_or_answer"), F.count_if(fact("composition") & ~F.col("join_arity").eqNullSafe(2)).alias("composition_of_other_arity"),
            F.count_if(fact("no_match") & (F.size("answer") > 0)).alias("no_match_with_an_answer"),
        ),
    ]
    if kept_back is not None:
        used = probes.join(F.broadcast(kept_back.select(F.col("gold_sql").alias("_s"), F.col("fingerprint").alias("_f"))), (F.col("gold_sql") == F.col("_s")) | (F.col("fingerprint") == F.col("_f")), "left_semi")
        found.append(used.agg(F.count(F.lit(1)).alias("reserved_task_asked")))
    return reduce(DataFrame.unionAll, [x.unpivot([], x.columns, "check", "n") for x in found])
