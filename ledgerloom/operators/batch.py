"""Grading of a table of SQL predictions: equal queries run once, results are compared where they lie.

1. Every item becomes *units*, one a part (an ordinary item has one): the gold statement and the predicted one, in one scope.
   What a text alone decides (truncation, silence, refusal, no query, a wrong number of statements) needs no run.
2. Distinct (scope, statement) texts are planned one after the other. Statements whose plans have the same result,
   whatever their spelling and aliases, share one run; a run writes its rows to the shared folder and nothing else.
3. All units are compared in one job: rows under the target columns, cells in a form that is the same for
   equal values, as sets, as lists, or as one row. No row of a result comes to the driver.
4. Statuses go back to the items: parts by position, then one row a prediction.

The driver plans every distinct statement, which is what running it takes; it holds a plan and a number for each.
Doubles compare with decimals by their shortest spelling; a number never equals a text.
"""

from __future__ import annotations

import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sqltext import split_statements
from ..plans import guard
from ..sources.stored import dealt, shared_folder, stored
from .grade import degenerate_status
from .records import ensure

RESULT = "result long, place long, cells array<string>"
OUTCOME = "statement long, result long, status string, columns array<string>"


@F.pandas_udf(T.ArrayType(T.StringType()))
def statements_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else split_statements(t))


def cell(c: Column, kind: T.DataType) -> Column:
    """A value as a text that is the same for equal values; null stays null."""
    if isinstance(kind, T.StringType):
        return F.concat(F.lit("s"), c)
    if isinstance(kind, T.BooleanType):
        return F.concat(F.lit("n"), c.cast("int").cast("string"))
    if isinstance(kind, T.DoubleType | T.FloatType):
        whole, spelled = (c == F.floor(c)) & (F.abs(c) < 1e18), F.abs(c).between(1e-6, 1e15)
        exact = F.regexp_replace(c.cast("string").try_cast("decimal(38,20)").cast("string"), r"0+$", "")
        return F.concat(F.lit("n"), F.when(F.isnan(c), "nan").when(whole, c.cast("bigint").cast("string")).when(spelled, exact).otherwise(c.cast("string")))
    if isinstance(kind, T.DecimalType):
        return F.concat(F.lit("n"), F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    if isinstance(kind, T.IntegralType):
        return F.concat(F.lit("n"), c.cast("string"))
    return F.concat(F.lit("t"), c.cast("string") if not isinstance(kind, T.ArrayType | T.MapType | T.StructType) else F.to_json(c))


class Runner:
    """Plans statements, and runs each that has a result of its own, at most ``seconds`` long."""

    def __init__(self, spark: SparkSession, scopes: dict[str, dict[str, DataFrame]], seconds: float):
        self.spark, self.scopes, self.seconds = spark, scopes, seconds
        self.path = f"{shared_folder(spark)}/ledgerloom/batch-results-{uuid.uuid4().hex}"
        self.sessions: dict[str, SparkSession] = {}
        self.known: dict[tuple[str, int], list] = {}
        self.runs: list = []
        self.lock = threading.Lock()

    def planned(self, scope: str, sql: str) -> tuple[str | None, DataFrame | None]:
        try:
            with self.lock:
                if scope not in self.sessions:
                    self.sessions[scope] = guard.bind(self.spark, self.scopes, scope)
                session = self.sessions[scope]
                guard.check_policy(session, sql, set(self.scopes[scope]))
                out = session.sql(sql)
                guard._check_analysed(out, self.scopes[scope])
                return None, out
        except guard.ScopeError:
            raise
        except Exception:
            return "SQL_error", None

    def number(self, scope: str, df: DataFrame) -> tuple[int, bool]:
        """The run that a plan belongs to, and whether it is new; columns go by their places, so that names don't matter."""
        plan = df.toDF(*[f"c{i}" for i in range(len(df.columns))])._jdf.queryExecution().optimizedPlan()
        own = self.known.setdefault((scope, plan.semanticHash()), [])
        for other, n in own:
            if other.sameResult(plan):
                return n, False
        n = sum(len(x) for x in self.known.values())
        own.append((plan, n))
        return n, True

    def write(self, n: int, df: DataFrame) -> str:
        sc, group, late = self.spark.sparkContext, uuid.uuid4().hex, threading.Event()

        def stop():
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(self.seconds, stop)
        timer.start()
        try:
            sc.setJobGroup(group, "graded query", interruptOnCancel=True)
            named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
            cells = F.array(*[cell(F.col(f.name), f.dataType) for f in named.schema.fields]).cast("array<string>")
            named.select(F.lit(n).cast("long").alias("result"), F.monotonically_increasing_id().alias("place"), cells.alias("cells")).write.parquet(f"{self.path}/run={n}")
            return "done"
        except Exception:
            return "timeout" if late.is_set() else "SQL_error"
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def results(self) -> DataFrame:
        done = [f"{self.path}/run={n}" for n, status in self.runs if status == "done"]
        if not done:
            return self.spark.createDataFrame([], RESULT)
        return self.spark.read.schema(RESULT).parquet(*done)


def run_statements(spark: SparkSession, scopes, statements: DataFrame, seconds: float, workers: int) -> tuple[DataFrame, DataFrame]:
    """(OUTCOME rows, RESULT rows) of distinct statements: frame of (statement, scope, sql)."""
    runner, outcome = Runner(spark, scopes, seconds), []
    with ThreadPoolExecutor(workers) as pool:
        waiting = []
        for r in statements.toLocalIterator():
            status, df = runner.planned(r.scope, r.sql)
            if df is None:
                outcome.append((r.statement, None, status, None))
                continue
            n, new = runner.number(r.scope, df)
            if new:
                waiting.append((n, pool.submit(runner.write, n, df)))
            outcome.append((r.statement, n, None, df.columns))
        runner.runs = [(n, f.result()) for n, f in waiting]
    ended = dict(runner.runs)
    rows = [(s, n, status or ended[n], columns) for s, n, status, columns in outcome]
    return spark.createDataFrame(rows, OUTCOME), runner.results()


def units_of(items: DataFrame, predictions: DataFrame, key: str, item: str, text: str, truncated: str | None, scope: str) -> DataFrame:
    """One row a part: key, part, parts, early (a status that the text decides), scope, gold, sql, kind, target, extra."""
    x = dealt(items, key).select(F.col(key).alias("key"), F.parse_json(item).alias("item")).join(predictions.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(truncated) if truncated else F.lit(False)).alias("cut")), "key")
    of = lambda path, kind="string": F.try_variant_get("item", path, kind)
    x = x.withColumns({"several": F.coalesce(of("$.answer_type") == "multi_part", F.lit(False)), "ways": of("$.parts", "array<variant>"), "golds": of("$.gold_sql", "map<string,string>")})
    one = F.array(F.struct(F.lit("").alias("id"), of("$.gold_sql").alias("gold"), of("$.answer_type").alias("kind"), of("$.target_columns", "array<string>").alias("target")))
    part = lambda p: F.try_variant_get(p, "$.part_id", "string")
    many = F.transform("ways", lambda p: F.struct(part(p).alias("id"), F.try_element_at("golds", part(p)).alias("gold"), F.try_variant_get(p, "$.answer_type", "string").alias("kind"), F.try_variant_get(p, "$.target_columns", "array<string>").alias("target")))
    x = x.withColumn("units", F.when(F.col("several"), many).otherwise(one))
    u = F.col("units")
    bad = (F.coalesce(F.size(u), F.lit(0)) <= 0) | (F.size(F.array_distinct(F.transform(u, lambda s: s["id"]))) != F.size(u)) | F.exists(u, lambda s: s["gold"].isNull() | ~F.coalesce(s["kind"].isin("set", "scalar", "top_k"), F.lit(False)) | (F.coalesce(F.size(s["target"]), F.lit(0)) <= 0) | ((s["kind"] == "scalar") & (F.size(s["target"]) != 1)))
    x = x.withColumn("units", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("an item says too little or contradicts itself: "), F.coalesce(F.col("key").cast("string"), F.lit("null"))))).otherwise(u))
    x = x.withColumns({"given": statements_of(F.trim("text")), "stop": degenerate_status(F.col("text"), F.col("cut")), "n": F.size("units")})
    # As many statements as parts, or the answer as a whole is none.
    early = F.when(F.col("stop").isNotNull(), F.col("stop")).when(F.col("several") & (F.size("given") != F.col("n")), "invalid_output")
    sql = F.when(F.col("several"), F.get("given", F.col("part"))).otherwise(F.regexp_replace(F.trim("text"), r"[\s;]+\z", ""))
    x = x.select("key", "n", "given", "text", "several", early.alias("early"), F.coalesce(of("$.scope"), F.lit(scope)).alias("scope"), F.posexplode("units").alias("part", "u")).withColumn("sql", sql)
    query = F.coalesce(F.lower("sql").rlike("^(select|with)"), F.lit(False))
    return x.select("key", "part", "several", "scope", "u.gold", "sql", "u.kind", "u.target", F.coalesce("early", F.when(~query, "parse_failure")).alias("early"))


def compared(units: DataFrame, results: DataFrame) -> DataFrame:
    """(key, part, status, strict) of units whose statements both ran: gold_result, gold_columns, result, columns.

    Units that ask the same of the same two results are one comparison, however many there are.
    """
    asked = ["kind", "target", "gold_result", "gold_columns", "result", "columns"]
    pairs = stored(units.select(*asked).distinct().withColumn("pair", F.monotonically_increasing_id()), "batch-pairs")
    met = reduce(lambda a, c: a & (F.col(f"u.{c}") == F.col(f"p.{c}")), asked, F.lit(True))
    return units.alias("u").join(_verdicts(pairs, results).alias("p"), met).select("u.key", "u.part", "p.status", "p.strict")


def _verdicts(pairs: DataFrame, results: DataFrame) -> DataFrame:
    at = lambda columns: F.transform("target", lambda t: F.array_position(columns, t) - 1)
    lone = F.col("kind").eqNullSafe("scalar") & (F.size("columns") == 1)
    x = pairs.withColumns({"gold_at": at(F.col("gold_columns")), "at": F.when(lone, F.array(F.lit(0).cast("long"))).otherwise(at(F.col("columns")))})
    side = lambda which, result, places: x.select("pair", "kind", F.lit(which).alias("side"), F.col(result).alias("result"), F.col(places).alias("places"))
    rows = side(0, "gold_result", "gold_at").unionByName(side(1, "result", "at")).join(results, "result")
    rows = rows.withColumn("row", F.to_json(F.transform("places", lambda i: F.get("cells", i.cast("int")))))
    lists = rows.where("kind = 'top_k'").withColumn("row", F.concat_ws(" ", F.row_number().over(Window.partitionBy("pair", "side").orderBy("place")).cast("string"), "row"))
    met = rows.where("kind <> 'top_k'").select("pair", "side", "row").unionByName(lists.select("pair", "side", "row"))
    per = met.groupBy("pair", "row").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    sums = per.groupBy("pair").agg(F.sum("a").alias("n_gold"), F.sum("b").alias("n_own"), F.count_if((F.col("a") == 0) != (F.col("b") == 0)).alias("apart"))
    y = x.join(sums, "pair", "left").na.fill(0, ["n_gold", "n_own", "apart"])
    absent = lambda places: F.exists(places, lambda i: i < 0)
    # A lone cell is the value whatever its name; with several rows it needs its name after all.
    unnamed = F.when(lone & (F.col("n_own") != 1), absent(at(F.col("columns")))).otherwise(absent("at"))
    status = (
        F.when(absent("gold_at"), "invalid_output").when(unnamed, "incorrect").when((F.col("kind") == "scalar") & (F.col("n_gold") != 1), "invalid_output")
        .when((F.col("kind") == "scalar") & (F.col("n_own") != 1), "incorrect").when(F.col("apart") > 0, "incorrect").otherwise("correct")
    )
    return y.select(*pairs.columns, status.alias("status"), (F.col("gold_columns") == F.col("columns")).alias("strict"))


def graded_sql(spark: SparkSession, scopes: dict[str, dict[str, DataFrame]], items: DataFrame, predictions: DataFrame, key: str, item: str, text: str, scope: str, truncated: str | None = None, seconds: float = 5.0, workers: int = 4) -> DataFrame:
    """(key, status, strict, parts): every prediction graded, as ``grade`` does one; parts are statuses by position.

    ``item``: a JSON text with gold_sql, answer_type and target_columns (by part where it is multi_part) and maybe a scope of its own.
    """
    units = stored(units_of(items, predictions, key, item, text, truncated, scope), "batch-units")
    open_ = units.where("early IS NULL")
    texts = open_.select("scope", F.col("gold").alias("sql")).union(open_.select("scope", "sql")).distinct()
    numbered = stored(texts.withColumn("statement", F.monotonically_increasing_id()), "batch-statements")
    outcome, results = run_statements(spark, scopes, numbered, seconds, workers)
    told = stored(numbered.join(outcome, "statement").select("scope", "sql", "result", "status", "columns"), "batch-outcome")
    gold = told.select("scope", F.col("sql").alias("gold"), F.col("result").alias("gold_result"), F.col("status").alias("gold_status"), F.col("columns").alias("gold_columns"))
    ran = open_.drop("early").join(told, ["scope", "sql"]).join(gold, ["scope", "gold"])
    # The gold runs first, so its failure is told first.
    failed = F.when(F.col("gold_status") != "done", F.col("gold_status")).when(F.col("status") != "done", F.col("status"))
    ran = ran.withColumn("failed", failed)
    done = compared(ran.where("failed IS NULL"), results)
    several = units.where("several").select("key").distinct().withColumn("several", F.lit(True))
    judged = units.where("early IS NOT NULL").select("key", "part", F.col("early").alias("status"), F.lit(False).alias("strict"))
    judged = judged.unionByName(ran.where("failed IS NOT NULL").select("key", "part", F.col("failed").alias("status"), F.lit(False).alias("strict"))).unionByName(done)
    parts = judged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "status", "strict"))).alias("p")).join(several, "key", "left")  # as many as an item has parts
    broken = F.get(F.filter("p", lambda s: ~s["status"].isin("correct", "incorrect")), F.lit(0))["status"]
    right = F.forall("p", lambda s: s["status"] == "correct")
    status = F.coalesce(broken, F.when(right, "correct").otherwise("incorrect"))
    return parts.select(F.col("key").alias(key), status.alias("status"), ((broken.isNull() | F.col("several").isNull()) & F.forall("p", lambda s: s["strict"])).alias("strict"), F.transform("p", lambda s: s["status"]).alias("parts"))


def final_run(spark: SparkSession, scopes, items: DataFrame, predictions: DataFrame, key: str, item: str, text: str, scope: str, same: tuple[str, ...] = (), truncated: str | None = None, seconds: float = 5.0, wording=None) -> DataFrame:
    """(key, mode, status, strict) of a whole run: items with gold_sql by their SQL, all others by their answers.

    Every item has exactly one prediction, which agrees with it in the columns of ``same`` (condition, seed, question); else reading fails.
    """
    from .answers import Wording, graded_answers, graded_parts

    once = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(text).alias("_text"), F.first(F.col(truncated) if truncated else F.lit(False)).alias("_cut"), *[F.first(c).alias(f"_p_{c}") for c in same])
    both = items.groupBy(key).agg(F.count(F.lit(1)).alias("_m"), F.first(item).alias("_item"), *[F.first(c).alias(f"_i_{c}") for c in same]).join(once, key, "full_outer")
    wrong = F.col("_n").isNull() | F.col("_m").isNull() | (F.col("_n") > 1) | (F.col("_m") > 1)
    for c in same:
        wrong = wrong | ~F.col(f"_p_{c}").eqNullSafe(F.col(f"_i_{c}"))
    both = stored(ensure(both, wrong, F.concat(F.lit("not one prediction that fits its item: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).select(key, "_item", "_text", "_cut"), "batch-run")
    kind = F.try_variant_get(F.parse_json("_item"), "$.answer_type", "string")
    has_sql = F.try_variant_get(F.parse_json("_item"), "$.gold_sql", "variant")
    sql = F.coalesce(F.schema_of_variant(has_sql) != "VOID", F.lit(False))
    # Stored, so that the checks of SQL items never see another one.
    by_sql, rest = stored(both.where(sql), "batch-run-sql"), both.where(~sql)
    a = graded_sql(spark, scopes, by_sql.select(key, "_item"), by_sql.select(key, "_text", "_cut"), key, "_item", "_text", scope, "_cut", seconds).select(key, F.lit("sql").alias("mode"), "status", "strict")
    said = Wording() if wording is None else wording
    alone, several = stored(rest.where(kind != "multi_part"), "batch-run-one"), stored(rest.where(kind == "multi_part"), "batch-run-parts")
    b = graded_answers(alone, "_text", "_item", "_cut", True, said).select(key, F.lit("memory").alias("mode"), F.col("graded.status").alias("status"), F.col("graded.strict").alias("strict"))
    c = graded_parts(several, key, "_text", "_item", "_cut", True, said).select(key, F.lit("memory").alias("mode"), "status", "strict")
    return a.unionByName(b).unionByName(c)


def run_summary(graded: DataFrame, items: DataFrame, key: str, item: str, family: str) -> DataFrame:
    """(family, n, correct, failed, no_match, valid_no_match) of a run, the whole under a null family."""
    gold = F.try_variant_get(F.parse_json(item), "$.gold_value", "variant")
    rows = F.coalesce(F.try_variant_get(gold, "$.rows", "array<variant>"), F.try_variant_get(gold, "$", "array<variant>"))
    none = (F.try_variant_get(F.parse_json(item), "$.answer_type", "string") == "set") & (F.size(rows) == 0)
    x = graded.join(items.select(key, F.col(family).alias("family"), F.coalesce(none, F.lit(False)).alias("none")), key)
    right = F.col("status") == "correct"
    return x.rollup("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct"), F.count_if(~F.col("status").isin("correct", "incorrect")).alias("failed"), F.count_if("none").alias("no_match"), F.count_if(F.col("none") & right).alias("valid_no_match"))
