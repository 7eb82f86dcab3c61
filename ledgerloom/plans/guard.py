"""Guarded SQL: one scope, one read-only statement, a deadline; checked on the parsed plan.

Text is parsed, not executed, first; the walk over the unresolved plan refuses everything but
queries over the logical tables, so comments, quotes and aliases can't hide a name.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


class PolicyError(Exception):
    """The statement is not one permitted read-only query."""


class ScopeError(Exception):
    """Unknown scope."""


class DeadlineError(Exception):
    """The query ran past its deadline."""


#: The plan nodes a query may have; anything else (commands, table functions, scripts) is refused.
ALLOWED_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "SubqueryAlias", "UnresolvedSubqueryColumnAliases",
    "UnresolvedRelation", "UnresolvedWith", "Join", "LateralJoin", "Union", "Except", "Intersect", "UnresolvedHaving", "OneRowRelation", "WithWindowDefinition", "Window",
    "Pivot", "Unpivot", "UnresolvedInlineTable", "UnresolvedOrderBy", "Generate", "Sample",
}
#: Groups of built-in functions a query may call. Left out are the groups that read the
#: environment, run other code, or make tables ("misc_funcs", "table_funcs" and the like).
FUNCTION_GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs", "hash_funcs", "json_funcs", "lambda_funcs",
    "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "window_funcs",
}
#: And of the left-out groups, functions that only look at their arguments, one array or map at a time.
FUNCTIONS = {"typeof", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer"}
#: Expressions of the analysed plan that some words without parentheses stand for.
REFUSED_EXPRESSIONS = {"CurrentUser", "CurrentCatalog", "CurrentDatabase", "CurrentSchema", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "SparkVersion", "CallMethodViaReflection", "TryReflect", "RaiseError"}


def _seq(jseq):
    it = jseq.iterator()
    while it.hasNext():
        yield it.next()


def _permitted(jvm, name: str) -> bool:
    registry = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    info = registry.lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    return info.isDefined() and (info.get().getGroup() in FUNCTION_GROUPS or name in FUNCTIONS)


def _expressions(node):
    """All expressions of one node, subexpressions included."""
    stack = list(_seq(node.expressions()))
    while stack:
        x = stack.pop()
        yield x
        stack += list(_seq(x.children()))


def _walk(jvm, root, tables: set[str]) -> None:
    """Refuse what is not a query over ``tables``; names of common table expressions hold only where they are in scope."""
    todo = [(root, frozenset())]
    while todo:
        node, visible = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind.rstrip("$") not in ALLOWED_NODES:
            raise PolicyError(f"refused: {kind}")
        if kind == "UnresolvedRelation":
            parts = list(_seq(node.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in tables | visible:
                raise PolicyError(f"refused relation: {'.'.join(parts)}")
        for x in _expressions(node):
            name = x.getClass().getSimpleName()
            if name == "UnresolvedFunction":
                called = [p.lower() for p in _seq(x.nameParts())]
                if len(called) != 1 or not _permitted(jvm, called[0]):
                    raise PolicyError(f"refused function: {'.'.join(called)}")
            if name == "UnresolvedGenerator" and (x.name().database().isDefined() or not _permitted(jvm, x.name().funcName().lower())):
                raise PolicyError(f"refused function: {x.name().unquotedString()}")
            if name in ("ListQuery", "Exists", "ScalarSubquery", "LateralSubquery"):
                todo.append((x.plan(), visible))
        if kind == "UnresolvedWith":
            for pair in _seq(node.cteRelations()):
                name = pair.productElement(0).lower()
                if name in tables:
                    raise PolicyError(f"a common table expression hides a table: {name}")
                todo.append((pair.productElement(1), visible | {name} if node.allowRecursion() else visible))
                visible = visible | {name}
        todo += [(child, visible) for child in _seq(node.children())]


def check_policy(spark: SparkSession, sql: str, tables: set[str]) -> None:
    """Raise ``PolicyError`` unless ``sql`` is one SELECT/WITH over ``tables``."""
    # The parser reads the settings of the active session: that must be the one which will run the text.
    sessions = spark._jvm.org.apache.spark.sql.classic.SparkSession
    before = sessions.getActiveSession()
    sessions.setActiveSession(spark._jsparkSession)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise PolicyError(f"cannot be parsed as one statement: {str(e).splitlines()[0][:160]}") from None
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())
        else:
            sessions.clearActiveSession()
    _walk(spark._jvm, plan, {t.lower() for t in tables})


def _check_analysed(df: DataFrame, tables: dict[str, DataFrame]) -> None:
    """Every leaf of the analysed plan must be one of the scope's own tables', or hold only constants."""
    def leaves(plan, seen):
        todo = [plan]
        while todo:
            node = todo.pop()
            seen.append(node)
            todo += list(_seq(node.children()))
            todo += [x.plan() for x in _expressions(node) if x.getClass().getSimpleName() in ("ListQuery", "Exists", "ScalarSubquery", "LateralSubquery")]
        return seen

    own = [n for t in tables.values() for n in leaves(t._jdf.queryExecution().analyzed(), []) if not n.children().size()]
    nodes = leaves(df._jdf.queryExecution().analyzed(), [])
    for node in nodes:
        found = {x.getClass().getSimpleName() for x in _expressions(node)} & REFUSED_EXPRESSIONS
        if found and not any(node.sameResult(n) for n in own):
            raise PolicyError(f"refused function: {sorted(found)[0]}")
        kind = node.getClass().getSimpleName().rstrip("$")
        if not node.children().size() and kind not in ("OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef") and not any(node.sameResult(n) for n in own):
            raise PolicyError(f"refused relation: {kind}")


def bind(spark: SparkSession, scopes: dict[str, dict[str, DataFrame]], scope: str) -> SparkSession:
    """A session of its own in which only the tables of ``scope`` are bound."""
    if scope not in scopes:
        raise ScopeError(scope)
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    # Inline tables stay as written until they have been checked.
    session.conf.set("spark.sql.parser.eagerEvalOfUnresolvedInlineTable", "false")
    session.conf.set("spark.sql.ansi.enabled", "true")
    session.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    for name, df in scopes[scope].items():
        # Rebind the plan in the new session.
        jdf = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().logical())
        DataFrame(jdf, session).createOrReplaceTempView(name)
    return session


def guarded(spark: SparkSession, scopes: dict[str, dict[str, DataFrame]], scope: str, sql: str) -> DataFrame:
    """The frame of a permitted query, not yet run."""
    session = bind(spark, scopes, scope)
    check_policy(session, sql, set(scopes[scope]))
    out = session.sql(sql)
    _check_analysed(out, scopes[scope])
    return out


def run_sql(spark: SparkSession, scopes, scope: str, sql: str, timeout_seconds: float = 5.0):
    """(columns, rows): the complete result, or PolicyError, ScopeError, DeadlineError, or Spark's own error.

    The deadline covers analysis as well; a query whose analysis alone takes longer is not run.
    """
    if isinstance(timeout_seconds, bool) or not 0 < timeout_seconds < float("inf"):
        raise ValueError("timeout_seconds must be a positive number")
    sc, group, late = spark.sparkContext, uuid.uuid4().hex, threading.Event()

    def stop():
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(timeout_seconds, stop)
    timer.start()
    try:
        df = guarded(spark, scopes, scope, sql)
        sc.setJobGroup(group, "guarded query", interruptOnCancel=True)
        if late.is_set():
            raise DeadlineError(f"more than {timeout_seconds} s")
        return tuple(df.columns), [tuple(r) for r in df.collect()]
    except (PolicyError, ScopeError, DeadlineError):
        raise
    except Exception:
        if late.is_set():
            raise DeadlineError(f"more than {timeout_seconds} s") from None
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def execute_pair(spark: SparkSession, scopes, scope: str, gold: str, predicted: str, timeout_seconds: float = 5.0):
    return run_sql(spark, scopes, scope, gold, timeout_seconds), run_sql(spark, scopes, scope, predicted, timeout_seconds)
