"""Graded tables of predictions, exact selection, bootstrap in parts and best fit over a histogram against plain computations."""

import bisect
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import batch, chat, grade, relational as rel, stats

ROWS = [("Acme", 1, 1.5), ("Acme", 2, 2.0), ("Beta", 2, -0.5), ("Gamma", None, 0.1), (None, 5, 1e20)]


@pytest.fixture(scope="module")
def scopes(spark):
    t = spark.createDataFrame(ROWS, "company string, n int, x double")
    return {"full": {"t": t}, "train": {"t": t.where("n = 2")}}


ITEMS = [
    {"gold_sql": "SELECT DISTINCT company FROM t", "answer_type": "set", "target_columns": ["company"]},
    {"gold_sql": "SELECT count(*) AS n FROM t", "answer_type": "scalar", "target_columns": ["n"]},
    {"gold_sql": "SELECT company, n FROM t ORDER BY n DESC NULLS LAST, company", "answer_type": "top_k", "target_columns": ["company", "n"]},
    {"gold_sql": "SELECT n FROM t", "answer_type": "scalar", "target_columns": ["n"]},
    {"gold_sql": "SELECT company AS c FROM t", "answer_type": "set", "target_columns": ["company"]},
    {"gold_sql": "SELECT x FROM t", "answer_type": "set", "target_columns": ["x"]},
    {"gold_sql": "SELECT company FROM t WHERE n > 100", "answer_type": "set", "target_columns": ["company"]},
]
SAID = [
    "SELECT DISTINCT company FROM t", "select company from t group by company ;", "SELECT company, 1 AS one FROM t", "SELECT company FROM t WHERE n = 2", "SELECT count(*) AS n FROM t", "SELECT 5 AS m", "SELECT 5.0 AS m", "SELECT '5' AS n", "SELECT n FROM t WHERE n = 5", "SELECT n FROM t",
    "SELECT company, n FROM t ORDER BY n DESC NULLS LAST, company", "SELECT company, n FROM t ORDER BY n, company", "SELECT n, company FROM t ORDER BY n DESC NULLS LAST, company LIMIT 10", "SELECT CAST(x AS DECIMAL(38, 10)) AS x FROM t", "SELECT x FROM t UNION ALL SELECT x FROM t",
    "SELECT company FROM t WHERE false", "SELECT nothing FROM t", "SELECT user()", "DROP TABLE t", "hello", "", None, "I'm sorry, I cannot", "WITH a AS (SELECT * FROM t) SELECT DISTINCT company FROM a", "SELECT company AS company, company AS other FROM t",
]


def test_a_table_is_graded_like_each_prediction(spark, scopes):
    cases = [(i, j) for i in range(len(ITEMS)) for j in range(len(SAID))]
    items = spark.createDataFrame([(f"{i}/{j}", json.dumps(ITEMS[i])) for i, j in cases], "k string, item string")
    said = spark.createDataFrame([(f"{i}/{j}", SAID[j], j == 3 and i == 0) for i, j in cases], "k string, t string, cut boolean")
    got = {r.k: (r.status, r.strict) for r in batch.graded_sql(spark, scopes, items, said, "k", "item", "t", "full", "cut", seconds=120.0).collect()}
    assert len(got) == len(cases)
    ran = {}
    real = grade.run_sql
    grade.run_sql = lambda s, sc, scope, sql, seconds: ran[sql] if sql in ran else ran.setdefault(sql, real(s, sc, scope, sql, 120.0))
    try:
        for i, j in cases:
            want = grade.grade(spark, scopes, "full", ITEMS[i], SAID[j], truncated=j == 3 and i == 0, timeout_seconds=120.0)
            assert got[f"{i}/{j}"] == tuple(want), (ITEMS[i], SAID[j])
    finally:
        grade.run_sql = real


def test_parts_scopes_and_faults(spark, scopes):
    a, b = {"part_id": "a", "answer_type": "set", "target_columns": ["company"]}, {"part_id": "b", "answer_type": "scalar", "target_columns": ["n"]}
    gold = {"a": "SELECT DISTINCT company FROM t", "b": "SELECT count(*) AS n FROM t"}
    item = {"answer_type": "multi_part", "target_columns": ["-"], "parts": [a, b], "gold_sql": gold}
    said = [f"{gold['a']}; {gold['b']} ;", f"{gold['a']}; {gold['b']}; SELECT 1", gold["a"], f"{gold['a']}; SELECT 7 AS n", f"SELECT nothing FROM t; {gold['b']}", f"{gold['a']}; hello", "x"]
    run = lambda item, said, **k: {r.k: (r.status, r.strict, r.parts) for r in batch.graded_sql(spark, scopes, spark.createDataFrame([(i, json.dumps(item)) for i in range(len(said))], "k int, item string"), spark.createDataFrame(list(enumerate(said)), "k int, t string"), "k", "item", "t", "full", **k).collect()}
    got = run(item, said, seconds=120.0)
    assert [got[i][:2] for i in range(7)] == [("correct", True), ("invalid_output", False), ("invalid_output", False), ("incorrect", True), ("SQL_error", False), ("parse_failure", False), ("invalid_output", False)]
    assert got[3][2] == ["correct", "incorrect"] and got[5][2] == ["correct", "parse_failure"]
    one = {"gold_sql": "SELECT count(*) AS n FROM t", "answer_type": "scalar", "target_columns": ["n"], "scope": "train"}
    assert run(one, ["SELECT 2 AS n", "SELECT 5 AS n"], seconds=120.0) == {0: ("correct", True, ["correct"]), 1: ("incorrect", True, ["incorrect"])}
    slow = "SELECT count(*) AS n FROM range_ r1 CROSS JOIN range_ r2 WHERE sha2(CAST(r1.id * r2.id AS STRING), 512) = 'x'"
    big = {"full": {"range_": spark.range(0, 6_000, 1, 4)}}
    late = batch.graded_sql(spark, big, spark.createDataFrame([(0, json.dumps({"gold_sql": "SELECT 1 AS n", "answer_type": "scalar", "target_columns": ["n"]}))], "k int, item string"), spark.createDataFrame([(0, slow)], "k int, t string"), "k", "item", "t", "full", seconds=3.0)
    assert late.first().status == "timeout"
    for bad in ({"answer_type": "sets"}, {"target_columns": []}, {"answer_type": "multi_part"}, {"answer_type": "scalar", "target_columns": ["a", "b"]}):
        with pytest.raises(Exception):
            run(ITEMS[0] | bad, ["SELECT 1"])
    with pytest.raises(Exception):
        run(item | {"parts": [a, a]}, ["SELECT 1"])


def test_equal_queries_run_once(spark, scopes):
    texts = spark.createDataFrame([(0, "full", "SELECT company FROM t WHERE n = 2"), (1, "full", "select c.company AS x from t c where 2 = c.n"), (2, "full", "SELECT company FROM t WHERE n = 3"), (3, "train", "SELECT company FROM t WHERE n = 2"), (4, "full", "SELEC")], "statement long, scope string, sql string")
    outcome, results = batch.run_statements(spark, scopes, texts, 120.0, 2)
    of = {r.statement: (r.result, r.status, r.columns) for r in outcome.collect()}
    assert of[0][0] == of[1][0] != of[2][0] and of[3][0] not in (of[0][0], of[2][0]) and of[1][2] == ["x"] and of[4] == (None, "SQL_error", None)
    assert {r.result for r in results.collect()} == {of[0][0], of[3][0]}


def test_a_run_needs_every_prediction_once(spark, scopes):
    item = json.dumps(ITEMS[1])
    items = spark.createDataFrame([(0, item, 1), (1, json.dumps({"answer_type": "scalar", "gold_value": "x"}), 1), (2, json.dumps({"answer_type": "multi_part", "gold_value": {"p": []}, "parts": [{"part_id": "p", "answer_type": "set"}]}), 1)], "k int, item string, seed int")
    said = [(0, "SELECT 5 AS n", 1), (1, "X", 1), (2, '{"p": []}', 1)]
    run = lambda rows: batch.final_run(spark, scopes, items, spark.createDataFrame(rows, "k int, t string, seed int"), "k", "item", "t", "full", ("seed",), seconds=120.0)
    assert {r.k: (r.mode, r.status) for r in run(said).collect()} == {0: ("sql", "correct"), 1: ("memory", "correct"), 2: ("memory", "correct")}
    for wrong in (said[:2], [*said, said[0]], [*said, (9, "x", 1)], [said[0], said[1], (2, "{}", 2)]):
        with pytest.raises(Exception):
            run(wrong).collect()


@pytest.mark.parametrize("kind", ["many", "one value", "integers", "steps"])
def test_selection_narrows_to_the_exact_place(spark, kind):
    rng = random.Random(8)
    make = {"many": lambda: rng.gauss(0, 1e6), "one value": lambda: 7.0 if rng.random() < 0.9 else rng.random(), "integers": lambda: rng.randrange(-10**12, 10**12), "steps": lambda: rng.choice([1.0, 2.0, float("inf"), -0.5])}[kind]
    rows = [(g, make()) for g in ["a", "b", None] for _ in range(4000)] + [("c", make()), ("d", None)]
    df = spark.createDataFrame(rows, f"g string, x {'long' if kind == 'integers' else 'double'}")
    ranks = {"q1": (1, 4), "q2": (1, 2), "p99": (99, 100), "last": (999, 1000)}
    want = {}
    for g in ["a", "b", None, "c"]:
        own = sorted(x for h, x in rows if h == g and x is not None)
        want[g] = (own[0], own[-1], *(own[len(own) * a // b] for a, b in ranks.values()))
    for most in (100, 10**6):
        assert {r.g: tuple(r)[1:] for r in stats.at_ranks(df, "x", ranks, "g", most=most).collect()} == want
    every = sorted(x for _, x in rows if x is not None)
    assert tuple(stats.at_ranks(df, "x", {"q": (1, 3)}, most=50).first()) == (every[0], every[-1], every[len(every) // 3])


def test_bootstrap_in_parts_agrees(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.gauss(0.3, 1) if i % 10 else None,) for i in range(3000)], "d double")
    whole, parts = stats.bootstrap(df, "d", 2000).first(), stats.bootstrap(df, "d", 2000, most=100).first()
    assert parts.mean == pytest.approx(whole.mean) and parts.n == whole.n == 2700
    assert parts.low == pytest.approx(whole.low, abs=0.01) and parts.high == pytest.approx(whole.high, abs=0.01)
    assert tuple(stats.bootstrap(df, "d", 300, most=100).first()) == pytest.approx(tuple(stats.bootstrap(df.repartition(5), "d", 300, most=100).first()))


def sequential(rows, size):
    """Best-fit decreasing, one item after the other."""
    room, out, opened = [], {}, 0
    for n, key in sorted(rows, key=lambda r: (-r[0], r[1])):
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            space, b = room.pop(at)
        else:
            space, b, opened = size, opened, opened + 1
        if space > n:
            bisect.insort(room, (space - n, b))
        out[key] = b
    return out


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_plan_is_the_sequential_rule(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 20, 100])
    lengths = [min(size, max(1, int(rng.expovariate(1 / (size / rng.choice([2, 4, 10])))))) for _ in range(rng.choice([1, 30, 400]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    got = {}
    rank = {}
    for key, n in sorted(enumerate(lengths), key=lambda x: x[0]):
        rank[key] = rank.get(("n", n), 0)
        rank["n", n] = rank[key] + 1
    for n, first, places, start, each in chat.best_fit_plan(counts, size):
        for key, m in enumerate(lengths):
            if m == n and first <= rank[key] < first + places:
                got[key] = start + (rank[key] - first) // each
    assert got == sequential([(n, k) for k, n in enumerate(lengths)], size)


def test_best_fit_over_all_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 5, 5, 5, 9, 30, 64, 70, 200])) for i in range(700)]
    df = spark.createDataFrame(rows, "k long, n long")
    for parts in (1, 9):
        got = {r.k: r.bin for r in chat.pack_best_fit(df.repartition(parts), "k", "n", 64).collect()}
        assert {k: b for k, b in got.items() if rows[k][1]} == sequential([(min(n, 64), k) for k, n in rows if n], 64)


def test_ranges_hold_even_where_one_value_is_nine_rows_in_ten(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 10 < 9 THEN 5 ELSE id % 7 END AS v", "id")
    sizes = [r["count"] for r in df.withColumn("p", rel.range_part(df, F.struct("v", "id"), 8)).groupBy("p").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 2 * 20_000 / 8
    spread = rel.with_position(df, "v", "id", parts=8).orderBy("v", "id").collect()
    assert [r.position for r in spread] == list(range(20_000))
    few = df.withColumn("p", rel.range_part(df, F.col("v"), 4)).groupBy("p").agg(F.count_distinct("v").alias("n")).collect()
    assert 2 <= len(few) and sum(r.n for r in few) == 7
