"""Grading of SQL answers against gold results: one of eight statuses, and the strict schema judged apart."""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.sqltext import split_statements
from ..plans.guard import DeadlineError, ScopeError, run_sql

#: The statuses an item can end in, one each.
STATUSES = ("correct", "incorrect", "generation_failure", "parse_failure", "SQL_error", "timeout", "truncated_output", "invalid_output")
#: Words that mark a refusal.
REFUSALS = ("i cannot", "i can't", "i am unable", "i'm unable", "as an ai", "sorry", "cannot help", "unable to answer")
ANSWER_TYPES = ("set", "scalar", "top_k", "multi_part")


class MetadataError(ValueError):
    """An item says too little, or contradicts itself."""


class Grade(NamedTuple):
    """``strict``: the result's columns are the gold's, whatever the values."""

    status: str
    strict: bool

    @property
    def correct(self) -> bool:
        return self.status == "correct"


def degenerate(text, truncated: bool = False) -> str | None:
    """The status of a text that must not be parsed, or None. Truncation is told, never guessed, and comes first."""
    if truncated:
        return "truncated_output"
    if not isinstance(text, str) or not text.strip():
        return "generation_failure"
    return "invalid_output" if any(m in text.lower() for m in REFUSALS) else None


def degenerate_status(text: Column, truncated: Column | None = None) -> Column:
    """``degenerate`` as a column expression."""
    low = F.lower(text)
    refused = F.lit(False)
    for m in REFUSALS:
        refused = refused | low.contains(m)
    out = F.when(F.coalesce(F.regexp_replace(text, r"\s+", ""), F.lit("")) == "", "generation_failure").when(refused, "invalid_output")
    return out if truncated is None else F.when(truncated, "truncated_output").otherwise(out)


def metadata(item: dict) -> tuple[str, list[str]]:
    """(answer type, target columns) as the item states them; never inferred."""
    kind, target = item.get("answer_type"), item.get("target_columns")
    if kind not in ANSWER_TYPES:
        raise MetadataError(f"answer_type is one of {', '.join(ANSWER_TYPES)}: {kind!r}")
    if not isinstance(target, list | tuple) or not target or not all(isinstance(c, str) and c for c in target):
        raise MetadataError(f"target_columns is a list of names: {target!r}")
    if kind == "scalar" and len(target) != 1:
        raise MetadataError("a scalar has one target column")
    return kind, list(target)


def _cell(v):
    """Cells compare across number types (exactly: no integer passes through a float); other types by their text."""
    if v is None or isinstance(v, str):
        return ("", v)
    if isinstance(v, bool | int | float | Decimal):
        return ("n", "nan") if v != v else ("n", v)
    return ("t", str(v))


def project(columns, rows, wanted) -> list[tuple]:
    """Rows under the wanted columns only; a missing one is a KeyError."""
    for c in wanted:
        if c not in columns:
            raise KeyError(c)
    at = [list(columns).index(c) for c in wanted]
    return [tuple(_cell(r[i]) for i in at) for r in rows]


def compare(answer_type: str, target: list[str], gold, predicted) -> Grade:
    """set: rows as a set; scalar: the only row; top_k: rows in order; multi_part: each column as a set."""
    (gold_columns, gold_rows), (columns, rows) = gold, predicted
    strict = tuple(gold_columns) == tuple(columns)
    try:
        want = project(gold_columns, gold_rows, target)
    except KeyError:
        return Grade("invalid_output", strict)
    lone = answer_type == "scalar" and len(columns) == 1 and len(rows) == 1
    try:
        got = [(_cell(rows[0][0]),)] if lone else project(columns, rows, target)
    except KeyError:
        return Grade("incorrect", strict)
    if answer_type == "scalar" and len(want) != 1:
        return Grade("invalid_output", strict)
    same = {
        "scalar": lambda: len(got) == 1 and got == want, "top_k": lambda: got == want, "set": lambda: set(got) == set(want),
        "multi_part": lambda: all({r[i] for r in got} == {r[i] for r in want} for i in range(len(target))),
    }[answer_type]()
    return Grade("correct" if same else "incorrect", strict)


def _is_query(text: str) -> bool:
    return text.lower().startswith(("select", "with"))


def _run_and_compare(spark, scopes, scope, item, gold_sql, text, timeout_seconds) -> Grade:
    kind, target = metadata(item)
    if not _is_query(text):
        return Grade("parse_failure", False)
    try:
        gold = run_sql(spark, scopes, scope, gold_sql, timeout_seconds)
        predicted = run_sql(spark, scopes, scope, text.rstrip().rstrip(";"), timeout_seconds)
    except DeadlineError:
        return Grade("timeout", False)
    except ScopeError:
        raise
    except Exception:
        return Grade("SQL_error", False)
    return compare(kind, target, gold, predicted)


def grade(spark, scopes, scope: str, item: dict, text: str | None, *, truncated: bool = False, timeout_seconds: float = 5.0) -> Grade:
    """Grade one prediction for ``item`` (gold_sql, answer_type, target_columns); gold_sql by part where it is multi_part."""
    several = isinstance(item.get("gold_sql"), dict)
    if several != (item.get("answer_type") == "multi_part"):
        raise MetadataError("gold_sql is given by part if and only if answer_type is multi_part")
    if several:
        return grade_multipart(spark, scopes, scope, item, text, truncated=truncated, timeout_seconds=timeout_seconds)[0]
    metadata(item)
    status = degenerate(text, truncated)
    return Grade(status, False) if status else _run_and_compare(spark, scopes, scope, item, item["gold_sql"], text.strip(), timeout_seconds)


def grade_multipart(spark, scopes, scope: str, item: dict, text: str | None, *, truncated: bool = False, timeout_seconds: float = 5.0) -> tuple[Grade, dict[str, Grade]]:
    """(grade, grades by part): statements by position.

    The first part that can't be judged gives the status, before any that is only wrong; an
    omitted or empty statement is a parse failure; extra statements cost the strict metric alone.
    """
    parts = item.get("parts") or []
    names = [p.get("part_id") for p in parts]
    if not parts or len(set(names)) != len(names):
        raise MetadataError("parts need part_ids of their own")
    for p in parts:
        metadata(p)
    if set(names) - set(item["gold_sql"]):
        raise MetadataError("a part has no gold")
    status = degenerate(text, truncated)
    if status:
        return Grade(status, False), {}
    given = split_statements(text.strip())
    done = {}
    for i, p in enumerate(parts):
        own = given[i] if i < len(given) else ""
        done[p["part_id"]] = _run_and_compare(spark, scopes, scope, p, item["gold_sql"][p["part_id"]], own, timeout_seconds)
    failed = [g for g in done.values() if g.status not in ("correct", "incorrect")]
    if failed:
        return Grade(failed[0].status, False), done
    extra = any(given[len(parts) :])
    right = all(g.correct for g in done.values())
    return Grade("correct" if right else "incorrect", all(g.strict for g in done.values()) and not extra), done


def grade_parts(spark, scopes, scope: str, items: list[dict], text: str | None, **kw) -> Grade:
    """``grade_multipart`` over a plain list of items."""
    parts = [{**x, "part_id": str(i)} for i, x in enumerate(items)]
    whole = {"answer_type": "multi_part", "target_columns": ["-"], "parts": parts, "gold_sql": {p["part_id"]: p["gold_sql"] for p in parts}}
    return grade_multipart(spark, scopes, scope, whole, text, **kw)[0]
