"""SQL texts without a parser: one scanner for comments, strings and quoted names, and what follows from it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Opening mark -> closing mark; a doubled closing mark stays inside (not for brackets).
QUOTES = {"'": "'", '"': '"', "`": "`", "[": "]"}


_QUOTED = "|".join(rf"{a}[^{b}]*+(?:{b}{b}[^{b}]*+)*+{b}" for a, b in QUOTES.items() if a != "[")
_SPAN = re.compile(rf"--[^\n]*+|/\*(?s:.*?)\*/|{_QUOTED}|\[[^\]]*+\]")


def _kind(opening: str) -> str:
    return "comment" if opening in "-/" else "string" if opening == "'" else "name"


def spans(sql: str) -> list[tuple[str, int, int]]:
    """(kind, from, to) of every comment, string and quoted name, left to right; an unclosed quote is code."""
    return [(_kind(sql[m.start()]), *m.span()) for m in _SPAN.finditer(sql)]


def masked(sql: str, fill: str = " ", keep_length: bool = False) -> str:
    """``sql`` with each span replaced by ``fill`` (once, or for each of its characters)."""
    return _SPAN.sub((lambda m: fill * len(m[0])) if keep_length else (lambda m: fill), sql)


def split_statements(sql: str) -> list[str]:
    """Statements between top-level semicolons; an inner empty one stays as the empty text, empty ones at the end go."""
    code, parts, at = masked(sql, "_", True), [], 0
    for cut in [i for i, c in enumerate(code) if c == ";"] + [len(sql)]:
        parts.append(sql[at:cut].strip())
        at = cut + 1
    while parts and not parts[-1]:
        parts.pop()
    return parts


def constructs(sql: str) -> dict[str, bool | int]:
    """Which of the clauses a text has (outside spans), and how many joins."""
    code = masked(sql)
    has = lambda words: re.search(r"\b" + r"\s+".join(words.split()) + r"\b", code, re.I) is not None
    return {"group": has("group by"), "order": has("order by"), "limit": has("limit"), "where": has("where"), "joins": len(re.findall(r"\bjoin\b", code, re.I))}


def family(sql: str) -> str:
    """One operation family, the first that fits."""
    c = constructs(sql)
    return "argmax_topk" if c["order"] and c["limit"] else "group_by" if c["group"] else "limit_only" if c["limit"] else "filter"


def families(sql: str) -> list[str]:
    """Every family but ``filter`` whose clauses are there."""
    c = constructs(sql)
    found = {"argmax_topk": c["order"] and c["limit"], "group_by": c["group"], "limit_only": c["limit"] and not c["order"]}
    return sorted(k for k, v in found.items() if v)


def required(sql: str) -> list[str]:
    """The constructs a task's SQL must show."""
    c = constructs(sql)
    found = [name for name, there in (("JOIN", c["joins"]), ("GROUP BY", c["group"]), ("ORDER BY", c["order"]), ("LIMIT", c["limit"]), ("WHERE", c["where"])) if there]
    return found or ["SELECT"]


def literal(value) -> str:
    """A value as SQL text; prefer parameters where the query is run."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


@F.pandas_udf(StringType())
def mask_sql(s: pd.Series) -> pd.Series:
    """Comments, strings and quoted names of SQL texts as single spaces."""
    return s.map(lambda t: None if t is None else masked(t))


def _has(code: Column, words: str) -> Column:
    return F.rlike(code, F.lit(r"(?i)\b" + words.replace(" ", r"\s+") + r"\b"))


def operation_family(sql: Column) -> Column:
    s = mask_sql(sql)
    return F.when(_has(s, "order by") & _has(s, "limit"), "argmax_topk").when(_has(s, "group by"), "group_by").when(_has(s, "limit"), "limit_only").otherwise("filter")


def operation_families(sql: Column) -> Column:
    """Array of all families present but ``filter``."""
    s = mask_sql(sql)
    order, limit = _has(s, "order by"), _has(s, "limit")
    return F.array_compact(F.array(F.when(order & limit, F.lit("argmax_topk")), F.when(_has(s, "group by"), F.lit("group_by")), F.when(limit & ~order, F.lit("limit_only"))))


def join_arity(sql: Column) -> Column:
    return F.regexp_count(mask_sql(sql), F.lit(r"(?i)\bjoin\b"))


def sql_literal(c: Column) -> Column:
    """A text column as a SQL string literal."""
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
