"""The engine's queries against DuckDB, and unit tests of guard, grading and statistics."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import queries as engine
from ledgerloom.functions import sqltext, text as tx
from ledgerloom.operators import answers, chat, grade, literals, records, relational as rel, stats, tasks
from ledgerloom.plans import guard
from ledgerloom.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    df = df.astype(object).where(df.notna(), None)
    return list(df.columns), sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    assert rows(engine.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(engine.ORACLE_SQL[name]).df())


def test_best_fit_keeps_everything_within_bins(spark):
    out = engine.QUERIES["t_best_fit"](spark, SF).toPandas()
    assert out.doc_id.is_unique and len(out) == 200
    assert out.groupby("bin").n.sum().max() <= 8192


@pytest.mark.parametrize("sizes", [[2], [5, 1], [4, 4, 1], [2047, 2], [2049], [1], [0, 3]])
def test_stream_chunks_lose_nothing(spark, sizes):
    df = spark.createDataFrame([("q", i, n) for i, n in enumerate(sizes)], "q string, i long, n long")
    got = [r.n for r in chat.stream_chunks(df, "q", "i", "n", 4).orderBy("chunk").collect()]
    assert sum(got) == sum(sizes) and all(0 < n <= 5 for n in got)
    assert sum(sizes) == 1 or 1 not in got[-1:]


def scopes(spark):
    t = spark.createDataFrame([(1, "a", 3), (2, "b", 5), (3, "a", None)], "row_id long, company string, n long")
    return {"train": {"companies": t.where("row_id < 3")}, "full": {"companies": t}}


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT 1; SELECT 2", "DROP TABLE companies", "INSERT INTO companies VALUES (4, 'x', 1)", "SELECT * FROM parquet.`/tmp/x`", "SELECT java_method('java.lang.System', 'exit', 1)",
        "SELECT reflect('java.util.UUID', 'randomUUID')", "SELECT * FROM range(5)", "SELECT * FROM default.companies", "SELECT * FROM other", "SET spark.sql.ansi.enabled=false",
        "WITH companies AS (SELECT 1 AS n) SELECT * FROM companies", "SELECT * FROM companies WHERE n IN (SELECT n FROM hidden)", "SHOW TABLES", "", "EXPLAIN SELECT 1",
        "SELECT (WITH hiddent AS (SELECT 1) SELECT count(*) FROM hiddent) AS a, count(*) FROM hiddent", "SELECT * FROM (WITH hiddent AS (SELECT 1) SELECT * FROM hiddent) x, hiddent", "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
        "SELECT user()", "SELECT current_user", "SELECT current_catalog()", "SELECT current_database()", "SELECT version()", "SELECT uuid()", "SELECT try_reflect('java.util.UUID', 'randomUUID')", "SELECT monotonically_increasing_id() FROM companies",
        "SELECT * FROM companies WHERE EXISTS (SELECT 1 FROM hidden)", "SELECT * FROM spark_catalog.default.companies", "SELECT stack(2, 1, 2)", "SELECT * FROM VALUES (user()) t(a)", "CACHE TABLE companies", "SELECT /* x */ 1 /*", "DESCRIBE companies", "USE default", "TRUNCATE TABLE companies", "DELETE FROM companies",
        "SELECT * FROM (SELECT * FROM parquet.`/tmp/x`) t", "WITH t AS (SELECT * FROM hidden) SELECT * FROM t", "CREATE TEMP VIEW v AS SELECT 1",
    ],
)
def test_guard_refuses(spark, sql):
    with pytest.raises(guard.PolicyError):
        guard.guarded(spark, scopes(spark), "train", sql)


def test_guard_runs_in_scope(spark):
    q = "WITH t AS (SELECT company FROM companies /* c */) SELECT count(DISTINCT company) AS n FROM t"
    assert guard.run_sql(spark, scopes(spark), "train", q) == (("n",), [(2,)])
    assert guard.run_sql(spark, scopes(spark), "full", 'SELECT "company", count(*) AS k FROM companies GROUP/**/BY company ORDER BY 1')[1] == [("a", 2), ("b", 1)]
    with pytest.raises(guard.ScopeError):
        guard.run_sql(spark, scopes(spark), "nowhere", "SELECT 1")
    for bad in (0, -1, True):
        with pytest.raises(ValueError):
            guard.run_sql(spark, scopes(spark), "full", "SELECT 1", bad)


def test_guard_permits_generators_and_samples(spark):
    own = {"s": {"t": spark.range(10).selectExpr("id", "array(id, id + 1) AS a")}}
    for sql, n in (("SELECT explode(a) AS x FROM t", 20), ("SELECT x FROM t LATERAL VIEW OUTER posexplode(a) e AS p, x", 20), ("SELECT typeof(id) FROM t", 10)):
        assert len(guard.run_sql(spark, own, "s", sql, 60.0)[1]) == n
    assert len(guard.run_sql(spark, own, "s", "SELECT * FROM t TABLESAMPLE (5 ROWS)", 60.0)[1]) == 5
    for sql in ("SELECT x FROM t LATERAL VIEW reflect('java.lang.System', 'getProperty', 'user.home') e AS x", "SELECT * FROM range(5)", "SELECT version()"):
        with pytest.raises(guard.PolicyError):
            guard.run_sql(spark, own, "s", sql, 60.0)


def test_guard_never_reads_the_catalog(spark):
    spark.sql("DROP TABLE IF EXISTS hiddent")
    spark.createDataFrame([(41,)], "secret int").write.saveAsTable("hiddent")
    try:
        for sql in ("SELECT * FROM (WITH hiddent AS (SELECT 1 AS secret) SELECT * FROM hiddent) x JOIN hiddent USING (secret)", "WITH x AS (WITH hiddent AS (SELECT 1) SELECT * FROM hiddent) SELECT * FROM hiddent", "SELECT * FROM hiddent"):
            with pytest.raises(guard.PolicyError):
                guard.guarded(spark, scopes(spark), "train", sql)
        inner = "WITH hiddent AS (SELECT 7 AS secret) SELECT max(secret) AS m FROM (WITH other AS (SELECT * FROM hiddent) SELECT * FROM other)"
        assert guard.run_sql(spark, scopes(spark), "train", inner)[1] == [(7,)]
    finally:
        spark.sql("DROP TABLE IF EXISTS hiddent")


@pytest.mark.parametrize("sql", ["SELECT count(*) FROM companies a JOIN companies b USING (row_id)", "WITH RECURSIVE r AS (SELECT 1 AS i UNION ALL SELECT i + 1 FROM r WHERE i < 3) SELECT max(i) FROM r", "SELECT row_id FROM companies UNION SELECT 9", "SELECT sum(n) OVER (PARTITION BY company) FROM companies", "SELECT company, CASE WHEN n > 1 THEN upper(company) END FROM companies WHERE n IN (SELECT max(n) FROM companies)", "SELECT * FROM companies EXCEPT SELECT * FROM companies", "SELECT * FROM VALUES (1), (2) AS t(a)"])
def test_guard_permits_queries(spark, sql):
    guard.run_sql(spark, scopes(spark), "full", sql, 60.0)


def test_execute_pair(spark):
    gold, own = guard.execute_pair(spark, scopes(spark), "train", "SELECT count(*) AS n FROM companies", "SELECT max(row_id) AS m FROM companies", 60.0)
    assert (gold, own) == ((("n",), [(2,)]), (("m",), [(2,)]))
    with pytest.raises(guard.ScopeError):
        guard.execute_pair(spark, scopes(spark), "other", "SELECT 1", "SELECT 2")


def test_select_values_equals_brute_force(spark):
    import random
    from itertools import combinations

    rng = random.Random(5)
    data = [(f"t{t}", r, r % 40, ("train", "dev", "test")[r % 3]) for r in range(120) for t in range(9) if rng.random() < 0.08 + 0.01 * t]
    df = spark.createDataFrame(data, "term string, row int, entity int, split string")
    for k, floor in ((1, 0.0), (2, 60.0), (3, 80.0), (3, 99.9)):
        rows = {}
        for t, r, e, s in data:
            rows.setdefault(t, set()).add((r, e, s))
        fit = sorted(t for t, x in rows.items() if 3 <= len(x) <= 15 and sum(s == "train" for *_, s in x) >= 2)
        total, best = len({r for t, r, e, s in data if s == "train"}), None
        for c in combinations(fit, k):
            own = set().union(*[rows[t] for t in c])
            gone = {r for r, _, s in own if s == "train"}
            if 100 * (total - len(gone)) / total >= floor:
                key = (len(gone), len({e for _, e, s in own if s == "train"}), -sum(s == "dev" for t in c for *_, s in rows[t]), list(c))
                best = key if best is None else min(best, key)
        assert len(fit) >= 3 and tasks.select_values(df, "term", "row", "entity", "split", k, least={"train": 2}, floor=floor) == (best and best[3])
    with pytest.raises(ValueError):
        tasks.select_values(df, "term", "row", "entity", "split", 3, band=(1000, 2000))


def test_answer_forms_and_paraphrases(spark):
    df = spark.createDataFrame([("  Ｆull  Straße.. ", "Which companies do x?")], "a string, q string")
    r = df.select(tx.answer_form(F.col("a")).alias("a"), tasks.paraphrase(F.col("q"), {"Which companies": "What firms", "x": "y"}).alias("q")).first()
    assert tuple(r) == ("full strasse", "What firms do y?")


def test_verified_zero(spark):
    sql = spark.createDataFrame([("SELECT a FROM t GROUP BY a",), ("SELECT 'group by'",)], "q string")
    assert tasks.verified_zero(tasks.operation_exposure(sql, "q", ["argmax_topk"])) == 2
    for bad in (tasks.operation_exposure(sql, "q", ["group_by"]), tasks.operation_exposure(sql.limit(0), "q", ["group_by"])):
        with pytest.raises(ValueError):
            tasks.verified_zero(bad)


def test_deadline(spark):
    big = spark.range(200_000)
    with pytest.raises(guard.DeadlineError):
        guard.run_sql(spark, {"s": {"t": big}}, "s", "SELECT count(*) FROM t a CROSS JOIN t b WHERE a.id * b.id % 7 = 3", 1.0)


def test_grading(spark):
    item = {"gold_sql": "SELECT DISTINCT company FROM companies", "answer_type": "set", "target_columns": ["company"]}
    g = lambda t, **k: grade.grade(spark, scopes(spark), "full", item, t, timeout_seconds=60.0, **k)
    assert g(item["gold_sql"]) == ("correct", True) and g(item["gold_sql"] + " ;").correct
    assert g("SELECT company, count(*) AS n FROM companies GROUP BY company") == ("correct", False)
    assert g("SELECT company FROM companies WHERE n = 5") == ("incorrect", True)
    assert g("SELECT nothing FROM companies")[0] == "SQL_error" and g("SELECT user()")[0] == "SQL_error"
    assert g("  ")[0] == g(None)[0] == "generation_failure" and g("hello")[0] == "parse_failure"
    assert g("SELECT 1", truncated=True)[0] == g("", truncated=True)[0] == "truncated_output"
    assert g("I'm sorry, as an AI I cannot")[0] == g("SELECT 'sorry'")[0] == "invalid_output"
    for wrong in ({"answer_type": "sets"}, {"target_columns": []}, {"answer_type": "scalar", "target_columns": ["a", "b"]}, {"gold_sql": {"a": "SELECT 1"}}):
        with pytest.raises(grade.MetadataError):
            grade.grade(spark, scopes(spark), "full", item | wrong, "SELECT 1")


@pytest.mark.parametrize(
    "kind,target,gold,predicted,want",
    [
        ("scalar", ["n"], (("n",), [(2,)]), (("m",), [(2.0,)]), ("correct", False)),
        ("scalar", ["n"], (("n",), [(2,)]), (("n", "x"), [(2, 5)]), ("correct", False)),
        ("scalar", ["n"], (("n",), [(2,)]), (("x", "y"), [(2, 2)]), ("incorrect", False)),
        ("scalar", ["n"], (("n",), [(2,), (3,)]), (("n",), [(2,)]), ("invalid_output", True)),
        ("scalar", ["n"], (("n",), [(2,)]), (("n",), [(2,), (2,)]), ("incorrect", True)),
        ("scalar", ["n"], (("m",), [(2,)]), (("n",), [(2,)]), ("invalid_output", False)),
        ("scalar", ["n"], (("n",), [(9007199254740993,)]), (("n",), [(9007199254740992,)]), ("incorrect", True)),
        ("set", ["a"], (("a",), [(1,), (1,), (None,)]), (("a",), [(None,), (1.0,)]), ("correct", True)),
        ("set", ["a"], (("a",), []), (("a",), []), ("correct", True)),
        ("set", ["a"], (("a",), [("1",)]), (("a",), [(1,)]), ("incorrect", True)),
        ("top_k", ["a"], (("a",), [(1,), (2,)]), (("a",), [(2,), (1,)]), ("incorrect", True)),
        ("top_k", ["a"], (("a",), [(1,), (1,)]), (("a",), [(1,)]), ("incorrect", True)),
        ("multi_part", ["a", "b"], (("a", "b"), [(1, 2), (2, 2)]), (("a", "b"), [(2, 2), (1, 2)]), ("correct", True)),
        ("multi_part", ["a", "b"], (("a", "b"), [(1, 2)]), (("a", "b"), [(1, 3)]), ("incorrect", True)),
    ],
)
def test_comparison(kind, target, gold, predicted, want):
    assert grade.compare(kind, target, gold, predicted) == want


def test_multipart_grading(spark):
    one = {"part_id": "a", "answer_type": "set", "target_columns": ["company"]}
    two = {"part_id": "b", "answer_type": "scalar", "target_columns": ["n"]}
    gold = {"a": "SELECT DISTINCT company FROM companies", "b": "SELECT count(*) AS n FROM companies"}
    item = {"answer_type": "multi_part", "target_columns": ["-"], "parts": [one, two], "gold_sql": gold}
    g = lambda t, **k: grade.grade(spark, scopes(spark), "full", item, t, timeout_seconds=60.0, **k)
    assert g("SELECT DISTINCT company FROM companies; SELECT count(*) AS n FROM companies WHERE ';' = ';' -- ; x") == ("correct", True)
    assert g(f"{gold['a']}; {gold['b']}; SELECT 1") == ("correct", False)
    assert g(f"{gold['a']};; {gold['b']}")[0] == "parse_failure"  # the second part is omitted, not shifted
    assert g(gold["a"])[0] == "parse_failure" and g(f"SELECT company FROM companies WHERE n = 5; DROP TABLE x")[0] == "parse_failure"
    assert g(f"SELECT company FROM companies WHERE n = 5; SELECT nothing FROM companies")[0] == "SQL_error"
    assert g(f"SELECT company FROM companies WHERE n = 5; {gold['b']}")[0] == "incorrect"
    assert g(f"sorry; {gold['b']}")[0] == "invalid_output" and g("x", truncated=True)[0] == "truncated_output" and g("")[0] == "generation_failure"
    assert grade.grade_parts(spark, scopes(spark), "full", [one | {"gold_sql": gold["a"]}, two | {"gold_sql": gold["b"]}], f"{gold['a']};{gold['b']};", timeout_seconds=60.0) == ("correct", True)
    for wrong in ({"parts": []}, {"parts": [one, one]}, {"parts": [one, two | {"target_columns": []}]}, {"gold_sql": {"a": gold["a"]}}, {"gold_sql": gold["a"]}):
        with pytest.raises(grade.MetadataError):
            grade.grade(spark, scopes(spark), "full", item | wrong, "SELECT 1; SELECT 2")


@pytest.mark.parametrize(
    "sql,want",
    [("SELECT 1", ["SELECT 1"]), ("a;b;", ["a", "b"]), ("a;;b", ["a", "", "b"]), ("';';b", ["';'", "b"]), ("'it''s;';b", ["'it''s;'", "b"]), ('"a;b" ; [c;d];`e;f`', ['"a;b"', "[c;d]", "`e;f`"]), ("a -- ;\n;b /* ; */", ["a -- ;", "b /* ; */"]), ("'open;b", ["'open", "b"]), (";;", []), ("", [])],
)
def test_statements(sql, want):
    assert sqltext.split_statements(sql) == want


def test_sql_text():
    assert sqltext.masked("a 'x' /* y */ b -- z") == "a     b  " and sqltext.masked("GROUP/**/BY") == "GROUP BY"
    assert sqltext.family("SELECT 1 ORDER/**/BY 1 LIMIT 2") == "argmax_topk" and sqltext.family("SELECT 'limit'") == "filter"
    assert sqltext.required("SELECT a FROM t JOIN u USING (a) WHERE b = 'group by'") == ["JOIN", "WHERE"]
    assert sqltext.literal("it's") == "'it''s'" and sqltext.literal(3) == "3" and sqltext.literal(None) == "NULL"


SET = {"answer_type": "set", "gold_value": ["Alpha", "Beta"], "attribute": "processes", "target_columns": ["company"], "company": "Acme"}
ONE = {"answer_type": "scalar", "gold_value": "Tier 1", "attribute": "category", "company": "Acme Inc."}


CASES = [
    ('["Alpha", "Beta"]', SET, "correct", True, True, ()),
    ('[" beta. ", "ALPHA"]', SET, "correct", True, True, ()),
    ('["Alpha", "Beta", "Gamma"]', SET, "incorrect", False, True, ()),
    ('["Alpha"]', SET, "incorrect", False, True, ()),
    ('```json\n["Alpha", "Beta"]\n```', SET, "correct", False, False, ()),
    ('```\n["Alpha", "Beta"]', SET, "parse_failure", False, False, ()),
    ('{"Company": ["Alpha", "Beta"]}', SET, "correct", False, False, ("named_object_unwrap",)),
    ('{"other": ["Alpha", "Beta"]}', SET, "parse_failure", False, False, ()),
    ('["\\"Alpha\\"", "Beta"]', SET, "correct", False, True, ("surplus_quote_strip",)),
    ('["\\"\\"Alpha\\"\\"", "Beta"]', SET, "incorrect", False, True, ("surplus_quote_strip",)),
    ("Alpha; Beta", SET, "correct", False, False, ()),
    ("- Alpha\n- Beta", SET, "correct", False, False, ()),
    ("The companies are: Alpha; Beta.", SET, "correct", False, False, ()),
    ("Acme's recorded processes are: Alpha; Beta", SET, "correct", False, False, ()),
    ("No companies match.", SET, "incorrect", False, False, ()),
    ("No companies match.", SET | {"gold_value": []}, "correct", False, False, ()),
    ("[]", SET | {"gold_value": []}, "correct", True, True, ()),
    ('"Alpha"', SET, "parse_failure", False, False, ()),
    ('"tier 1"', ONE, "correct", True, True, ()),
    ("Tier 1.", ONE, "correct", False, False, ()),
    ("The answer is Tier 1", ONE, "correct", False, False, ()),
    ("Acme Inc. is classified in the Tier 1 category.", ONE, "correct", False, False, ()),
    ("Other Inc. is classified in the Tier 1 category.", ONE, "incorrect", False, False, ()),
    ('"\\"Tier 1\\""', ONE, "correct", False, True, ("surplus_quote_strip",)),
    ('{"category": "Tier 1"}', ONE, "correct", False, False, ("named_object_unwrap",)),
    ('["Tier 1"]', ONE, "incorrect", False, False, ()),
    ("“Tier 1”", ONE, "correct", False, False, ("surplus_quote_strip",)),
    ("“Tier 1\"", ONE, "incorrect", False, False, ()),
    ("12", ONE | {"gold_value": 12}, "correct", True, True, ()),
    ("NaN", ONE | {"gold_value": "nan"}, "correct", False, False, ()),
    ("", ONE, "generation_failure", False, False, ()),
    ("I cannot help with it", ONE, "invalid_output", False, False, ()),
    ('["a"] and more', SET, "incorrect", False, False, ()),
    ('{"category": "Tier 1", "x": 1}', ONE, "incorrect", False, False, ()),
    ("1. Alpha\n2. Beta\n", SET | {"gold_value": ["1. Alpha", "beta"]}, "correct", False, False, ()),
]

WORDING = answers.Wording(("The answer is", "The companies are:", "{entity}'s recorded processes are:"), (". This is all.",), ("no companies match",), {"category": "{entity} is classified in the {value} category."})


def graded(spark, cases, **more):
    import json

    df = spark.createDataFrame([(i, t, json.dumps(x), cut) for i, (t, x, cut) in enumerate(cases)], "i int, t string, item string, cut boolean")
    return [r.graded for r in answers.graded_answers(df, "t", "item", "cut", wording=WORDING, **more).orderBy("i").collect()]


def test_answers(spark):
    for g, (text, _, *want) in zip(graded(spark, [(t, x, False) for t, x, *_ in CASES]), CASES):
        assert [g.status, g.strict, g.contract, tuple(g.repairs)] == want, text


def test_structured_answers(spark):
    import json

    gold = {"columns": ["a", "b"], "rows": [["x", None], ["y", 2]]}
    top, rows = {"answer_type": "top_k", "gold_value": gold}, {"answer_type": "set", "gold_value": gold}
    right, turned, twice = '[["X", null], ["y", 2]]', '[["y", 2], ["x", null]]', '[["x", null], ["y", 2], ["y", 2]]'
    got = graded(spark, [(right, top, False), (turned, top, False), (turned, rows, False), ('[["x", "null"], ["y", 2]]', rows, False), ('[["x"]]', rows, False), ("x", rows, False), (twice, rows, False), (right, top, True), ('[["x", null], [["y"], 2]]', rows, False), ("[]", rows, False)])
    assert [(g.status, g.strict) for g in got] == [("correct", True), ("incorrect", False), ("correct", True), ("incorrect", False), ("incorrect", False), ("parse_failure", False), ("correct", True), ("truncated_output", False), ("incorrect", False), ("incorrect", False)]
    once = graded(spark, [(twice, rows, False), ('["Alpha", "alpha", "Beta"]', SET, False)], unique=True)
    assert [(g.status, g.strict, g.contract, g.duplicates) for g in once] == [("correct", False, False, 1), ("correct", False, False, 1)]
    half = graded(spark, [('["Alpha", "Gamma", "Delta"]', SET, False)])[0]
    assert (half.precision, half.recall, half.missing, half.extra) == (1 / 3, 1 / 2, ["beta"], ["delta", "gamma"])
    parts = {"answer_type": "multi_part", "gold_value": {"p": ["a"], "q": 3}, "parts": [{"part_id": "p", "answer_type": "set"}, {"part_id": "q", "answer_type": "scalar"}]}
    said = ['{"q": 3, "p": ["a"]}', '{"q": 4, "p": ["a"]}', '{"p": ["a"]}', '{"q": 3, "p": ["a"]', '{"q": 3, "p": ["a"], "r": 1}', "", '{"q": {"x": 3}, "p": "a"}']
    df = spark.createDataFrame([(i, t, json.dumps(parts)) for i, t in enumerate(said)], "k int, t string, item string")
    got = {r.k: (r.status, r.strict, [(p.part_id, p.status) for p in r.parts or []]) for r in answers.graded_parts(df, "k", "t", "item").collect()}
    assert got == {0: ("correct", True, [("p", "correct"), ("q", "correct")]), 1: ("incorrect", False, [("p", "correct"), ("q", "incorrect")]), 2: ("incorrect", False, []), 3: ("parse_failure", False, []), 4: ("incorrect", False, []), 5: ("generation_failure", False, []), 6: ("incorrect", False, [("p", "parse_failure"), ("q", "incorrect")])}
    with pytest.raises(Exception):
        answers.graded_parts(df.withColumn("item", F.lit(json.dumps(parts | {"gold_value": {"p": ["a"]}}))), "k", "t", "item").collect()
    assert '"p"' in answers.contract_prompt(parts) and "[]" in answers.contract_prompt(SET)
    with pytest.raises(ValueError):
        answers.contract_prompt({"answer_type": "other"})


def test_fingerprints():
    leaf = lambda f, v: {"op": "eq", "field": f, "value": v}
    a, b = leaf("x", "1"), leaf("y", "2")
    one = lambda op, *t: tasks.fingerprint({"predicate": {"op": op, "operands": list(t)}})
    assert one("AND", a, b) == one("AND", b, a) != one("OR", a, b) and one("AND", a, {"op": "OR", "operands": [b, a]}) == one("AND", {"op": "OR", "operands": [a, b]}, a)
    for bad in (None, {}, {"op": "AND"}, {"op": "AND", "operands": []}, {"op": "eq", "field": "x"}, {"op": "AND", "operands": [a, {}]}):
        with pytest.raises(ValueError):
            tasks.fingerprint({"predicate": bad})


def test_eligibility():
    base = {"gold_sql": "SELECT DISTINCT company FROM companies JOIN processes ON processes.row_id = companies.row_id WHERE term = 'a, b; c'", "join_arity": 1, "operation_family": "filter", "fields_used": ["processes"], "values_used": ["x"]}
    names = {"companies", "processes", "services"}
    ok = lambda **k: tasks.eligible(base | k, names, {"group_by"}, [{"processes", "services"}], {"f": {"held"}}, {"processes", "services"})
    assert ok() == (True, None) and ok(values_used=["held"]) == (False, "held_out_value:f")
    assert ok(gold_sql="SELECT company FROM companies GROUP BY company", join_arity=0, operation_family="group_by", fields_used=[]) == (False, "held_out_operation")
    assert ok(gold_sql="SELECT a FROM companies JOIN processes ON 1=1 JOIN services ON 1=1", join_arity=2, fields_used=["processes", "services"]) == (False, "held_out_composition")
    for wrong in ('SELECT a FROM "companies"', "SELECT a FROM (SELECT 1)", "WITH x AS (SELECT 1) SELECT a FROM companies", "SELECT a FROM companies; SELECT 1", "SELECT a FROM other", "SELECT a FROM main.companies", "SELECT a FROM companies, processes", " ", None, "SELECT a FROM companies ORDER BY a LIMIT 1"):
        with pytest.raises(tasks.EligibilityError):
            ok(gold_sql=wrong, join_arity=0, fields_used=[])


def test_records_fail_closed(spark):
    df = spark.createDataFrame([(1, "correct", "g"), (2, "odd", None), (2, None, "g")], "id long, status string, grader string")
    assert records.verify(df, "id", ["status"], "status", 4, "g", "grader") == ["3 records, 4 expected", "1 repeated or null ids", "1 records lack required fields", "2 records have unknown statuses", "1 records come from another grader"]
    assert records.verify(df.where("id = 1"), "id", ["status"], "status", 1, "g", "grader") == []
    for broken in (lambda: records.accounting(df, "status"), lambda: records.asserted_join(df, df.select("id").limit(0), "id", []), lambda: records.seed_scores(df.withColumn("s", df.id % 2), "s", "id", "id"), lambda: records.final_run(df.select("id", "status"), df.selectExpr("id", "'{}' AS i").distinct(), "id", "status", "i"), lambda: rel.fill_sentinels(df, "grader", [], None), lambda: df.select(tasks.exposure_labels(F.array(F.lit("no_match"), F.lit("trained")))), lambda: df.select(chat.within_reserve(F.lit(90), 20, 100)), lambda: tasks.operation_exposure(df.selectExpr("CAST(NULL AS string) AS q"), "q", ["group_by"])):
        with pytest.raises(Exception):
            broken().collect()
    for pruned in (records.asserted_join(df, df.select("id").limit(0), "id", []), records.seed_scores(df.withColumn("s", df.id % 2), "s", "id", "id")):
        with pytest.raises(Exception):
            pruned.agg(F.count(F.lit(1))).collect()
    with pytest.raises(KeyError):
        rel.project(df, ["id", "missing"])
    with pytest.raises(PermissionError):
        records.classify_artifact("x", "0", {}, set())
    assert records.classify_artifact("x", "0", {"0": "dev"}, {"0"}) == "sealed" and records.classify_artifact("x", "0", {"0": "dev"}, set()) == "dev"


def test_regrade_multipart(spark):
    import json

    table = lambda c, r: {"columns": c, "rows": r}
    base = {"answer_type": "multi_part", "parts": [{"part_id": "a", "answer_type": "scalar", "target_columns": ["n"]}], "gold": {"a": table(["n"], [[1]])}, "result": {"parts": {"a": table(["n"], [[1]])}, "extra_present": False}}
    cases = [base, base | {"result": base["result"] | {"extra_present": True}}, base | {"result": {"parts": base["result"]["parts"]}}, base | {"result": None}, {"answer_type": "scalar", "mode": "memory", "raw_output": '"x"', "gold": "x"}, {"answer_type": "set", "status": "timeout"}]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, r string")
    out = [(r.regrade, r.new_status, r.new_strict) for r in records.regraded(df, "r", "g").orderBy("i").collect()]
    assert out == [("recomputed", "correct", True), ("recomputed", "correct", False), ("insufficient_evidence", None, None), ("insufficient_evidence", None, None), ("recomputed", "correct", True), ("recomputed", "timeout", False)]


def test_chat_encoding_refuses(spark):
    import public_tokenizers

    ids = chat.library_ids(public_tokenizers.path("byte_bpe_50k.json"))
    turns = lambda *t: [{"role": r, "content": c} for r, c in t]
    fine = turns(("system", "a b"), ("user", "c"), ("assistant", "dd ee"))
    make = lambda m, limit=100: spark.createDataFrame([(m,)], "m array<struct<role string, content string>>").select(chat.encode_chat(F.col("m"), ids, limit).alias("e"))
    e = make(fine).first().e
    assert len(e.input_ids) == len(e.labels) == len(e.attention_mask) and e.labels[: -2].count(-100) >= 3 and e.labels[-1] == e.input_ids[-1]
    for bad in (fine[::-1], fine[:2], turns(("system", "a"), ("user", " "), ("assistant", "b"))):
        with pytest.raises(Exception):
            make(bad).collect()
    with pytest.raises(Exception):
        make(fine, 2).collect()


def test_sources(spark, tmp_path):
    import hashlib
    import json
    import zipfile

    (tmp_path / "a.jsonl").write_text('{"k": 1, "t": "x"}\n\nnot json\n{"k": 2}\n{"k": NaN}\n')
    bad = [(r.line, r.value) for r in tables.bad_lines(spark, str(tmp_path / "a.jsonl")).orderBy("line").collect()]
    assert bad == [(3, "not json"), (5, '{"k": NaN}')] and tables.bad_lines(spark, str(tmp_path / "a.jsonl")).where("error is null").count() == 0
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.StringType())])
    assert [r.k for r in tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).where("k is not null").orderBy("k").collect()] == [1, 2]
    df = spark.createDataFrame([(2, "b|c", None), (1, "a, \"q\"", 2.5)], "k long, t string, a double")
    tables.write_csv(df, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in tables.read_csv(spark, str(tmp_path / "c"), df.schema).collect()) == [(1, 'a, "q"', 2.5), (2, "b|c", None)]
    tables.write_jsonl(df, str(tmp_path / "j"), ["k"])
    lines = [x for f in (tmp_path / "j").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == ['{"a":2.5,"k":1,"t":"a, \\"q\\""}', '{"a":null,"k":2,"t":"b|c"}']
    md, js = tables.report("R", {"t": df.orderBy("k")})
    assert "b\\|c" in md and json.loads(js)["t"][0]["k"] == 1
    with pytest.raises(ValueError):
        tables.report("R", {"t": df}, 1)
    with pytest.raises(Exception):
        tables.write_csv(df, str(tmp_path / "c"))
    want = hashlib.sha256((tmp_path / "a.jsonl").read_bytes()).hexdigest()
    assert tables.file_digest(spark, str(tmp_path / "a.jsonl")) == want == tables.file_digests(spark, str(tmp_path / "a.jsonl")).first().sha256
    tables.pinned(spark, {str(tmp_path / "a.jsonl"): want})
    with pytest.raises(ValueError):
        tables.pinned(spark, {str(tmp_path / "a.jsonl"): "0" * 64})
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row r="3"><c r="B3"><v>7</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><r><t>na</t></r><r><t>me</t></r></si></sst>')
    assert [tuple(r)[1:] for r in tables.read_xlsx(spark, str(tmp_path / "w.xlsx"), ["name", "n"]).collect()] == [(3, None, "7")]
    with pytest.raises(Exception):
        tables.read_xlsx(spark, str(tmp_path / "w.xlsx"), ["other", "n"]).collect()


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "t string, k long")
    manifest = records.export(df, str(tmp_path / "e"), {"model": "m"}, "k")
    assert manifest["rows"] == 2 and manifest["model"] == "m" and records.export(df.orderBy("t"), str(tmp_path / "e2"), {}, "k")["digest"] == manifest["digest"]
    with pytest.raises(Exception):
        records.export(df, str(tmp_path / "e"), {}, "k")


def test_packing_strategies(spark):
    df = spark.createDataFrame([(0, i, list(range(n))) for i, n in enumerate([3, 9, 4, 1, 12])], "s int, k long, ids array<int>")
    split = chat.pack(df, "bfd_split", "k", "ids", 8, "s").collect()
    assert sorted(sum((r.seq_lengths for r in split), [])) == [1, 1, 3, 4, 4, 8, 8] and all(sum(r.seq_lengths) <= 8 and len(r["keys"]) == len(r.seq_lengths) for r in split)
    cut = chat.pack(df, "bfd", "k", "ids", 8, "s").collect()
    assert sorted(sum((r.seq_lengths for r in cut), [])) == [1, 3, 4, 8, 8]
    wrapped = chat.pack(df, "wrapped", "k", "ids", 8, "s").orderBy("chunk").collect()
    assert [len(r.ids) for r in wrapped] == [8, 8, 8, 5]
    with pytest.raises(ValueError):
        chat.pack(df, "other", "k", "ids", 8, "s")
    assert chat.is_conversational(spark.createDataFrame([], "messages array<struct<role string, content string>>").schema) and not chat.is_conversational(df.schema)
    assert chat.drop_unsupervised(spark.createDataFrame([([-100],), ([-100, 4],), ([],)], "l array<int>"), "l").count() == 1


def test_streamed_accounting(spark, tmp_path):
    from ledgerloom.streaming import records as live

    (tmp_path / "in").mkdir()
    line = lambda i, s, t: f'{{"example_id": "{i}", "status": "{s}", "finished": "2026-01-01T00:{t:02d}:00"}}\n'
    (tmp_path / "in" / "a.json").write_text(line(1, "correct", 1) + line(1, "correct", 1) + line(2, "timeout", 2) + "broken\n" + line(3, "odd", 3) + line(4, "correct", 20))
    stream = live.read_records(spark, str(tmp_path / "in"))
    query = live.status_counts(stream, window="10 minutes", late="5 minutes").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    got = {(r.start.minute, r.status): r.n for r in spark.table("counts").collect()}
    assert got == {(0, "correct"): 1, (0, "timeout"): 1, (0, "invalid_output"): 1, (20, "correct"): 1}


def test_set_equalities(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(2, None), (1, "x"), (1, "x")], "k int, v string")
    assert rel.same_rows(a, b) and not rel.same_rows(a, b.distinct())
    assert not rel.same_rows(a.withColumn("position", F.monotonically_increasing_id()), b.withColumn("position", F.monotonically_increasing_id() + 1), ordered=True)
    groups = rel.with_position(spark.range(300).withColumn("g", F.nullif(F.col("id") % 7, F.lit(0))), "id", by=("g",), parts=5).collect()
    assert all(r.position == (r.id // 7) for r in groups) and len(groups) == 300
    placed = rel.with_position(spark.range(1000).withColumn("h", F.hash("id")), "h", "id", parts=7).orderBy("position").collect()
    assert [r.position for r in placed] == list(range(1000)) and [(r.h, r.id) for r in placed] == sorted((r.h, r.id) for r in placed)


def test_statistics(spark):
    assert stats.effect_size([2.0, 2.0]) is None and stats.effect_size([0.0, 2.0]) == pytest.approx(1 / math.sqrt(2))
    assert stats.mean_sd([3.0]) == {"mean": 3.0, "n": 1, "sd": None} == stats.mean_sd([3.0], True) and stats.mean_sd([1.0, 3.0])["sd"] == pytest.approx(math.sqrt(2))
    for bad in (lambda: stats.effect_size([1.0, math.nan]), lambda: stats.effect_size([1.0]), lambda: stats.mean_sd([]), lambda: stats.mean_sd([1.0, 1.0], True)):
        with pytest.raises(ValueError):
            bad()
    assert stats.mcnemar(0, 0) == 1.0 and stats.mcnemar(1, 9) == pytest.approx(0.021484375)
    df = spark.createDataFrame([(i, 1.0) for i in range(10)], "i long, d double")
    out = stats.bootstrap(df, "d", 50).first()
    assert (out.low, out.high, out.mean, out.n) == (1.0, 1.0, 1.0, 10)


def test_text(spark):
    df = spark.createDataFrame([("b; A ;a;; B;c", "Atlanta, Fulton County", "Foo Bar, Inc. LLC", "a b b", "b b c")], "t string, loc string, name string, x string, y string")
    from pyspark.sql import functions as F

    city, county = tx.city_county(F.col("loc"))
    r = df.select(tx.terms(F.col("t")).alias("t"), city.alias("c"), county.alias("k"), tx.name_key(F.col("name")).alias("n"), tx.token_f1(tx.tokens(F.col("x")), tx.tokens(F.col("y"))).alias("f"), tx.nfkc_casefold(F.lit("Ｓtraße  X")).alias("z")).first()
    assert (r.t, r.c, r.k, r.n, r.z) == (["A", "b", "c"], "Atlanta", "Fulton County", "foo bar", "strasse x")
    assert r.f == pytest.approx(2 / 3)


def test_publish(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(ValueError):
        tables.publish(df, str(tmp_path / "out"), [("rows", lambda x: x.count() == 4)])
    assert not (tmp_path / "out").exists()
    tables.publish(df, str(tmp_path / "out"), [("rows", lambda x: x.count() == 3)])
    with pytest.raises(FileExistsError):
        tables.publish(df, str(tmp_path / "out"), [])


def test_key_sets_and_changes(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    assert tuple(rel.key_sets(a, b, "k").first()) == (1, 1, 1, 1, 0)


@pytest.mark.parametrize("threshold", [0.86, 0.7, 0.5])
def test_fuzzy_pairs_equal_brute_force(spark, threshold):
    import random
    import re
    from difflib import SequenceMatcher

    rng = random.Random(3)
    names = ["colour works", "color works", "Straße 1", "STRASSE 1", "Acme", "acme holdings of the far north", "", "--", "a", "aa", "aaa", "aaaaaaa", "aaaaaaaa", "E-mail Co", "Email Co", "x" * 230, "x" * 229 + "y"]
    for _ in range(60):
        base = list(rng.choice(["red widget", "small bolt", "Northern Steel Works", "blue gear company", "abcabcabc"]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(base))
            base[at : at + rng.randint(0, 1)] = rng.choice(["", "s", "E", " ", "ß"])
        names.append("".join(base))
    cut = lambda s: re.sub("[^a-z0-9 ]", " ", s.casefold()).split()
    want = {}
    for i, x in enumerate(names):
        for j in range(i + 1, len(names)):
            p, q = cut(x), cut(names[j])
            ratio, begun = SequenceMatcher(None, x.casefold(), names[j].casefold()).ratio(), p == q[: len(p)] or q == p[: len(q)]
            if begun or ratio >= threshold:
                want[i, j] = (ratio, begun)
    got = rel.fuzzy_pairs(spark.createDataFrame([*enumerate(names), (999, None)], "k long, name string"), "k", "name", threshold).collect()
    assert len(got) == len(want) and {(r.a, r.b): (r.ratio, r.token_prefix) for r in got} == want


def test_exposure_normalises(spark):
    import unicodedata
    from collections import Counter

    norm = lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split())
    literals_ = [(1, "Große Straße"), (2, "two  words"), (3, "Ｆｕｌｌ width"), (4, ""), (5, " \n"), (6, None), (7, "a"), (8, "the same first sixteen, then one"), (9, "the same first sixteen, then two"), (7, "straße")]
    literals_ += [(1000 + i, f"filler {i}") for i in range(10_001)]
    docs = ["the GROSSE\nSTRASSE", "two\u00a0words two words", "full   WIDTH", "The same first\tsixteen, then TWO", "filler 10000", "", None]
    want = {}
    for i, needle in literals_:
        n = sum(norm(needle) in norm(t) for t in docs if t is not None) if needle and norm(needle) else 0
        if n:
            want[i] = want.get(i, 0) + n
    args = spark.createDataFrame([(t,) for t in docs], "t string"), "t", spark.createDataFrame(literals_, "i long, l string"), "i", "l"
    assert {r.i: r.n_docs for r in literals.exposed(*args).collect()} == want
    assert {r.i: r.n_docs for r in literals.exposed(*args, exact=True).collect()} == {i: n for i, n in Counter(i for i, x in literals_ if x for t in docs if t and x in t).items()}


def test_whole_residual_and_union(spark, duck):
    a, b = [(1, 2.0), (1, 2.0), (1, 3.0), (2, 1.0), (None, 1.0), (1, None)], [(1, 2.0), (1, 4.0), (2, 1.0), (3, 1.0), (1, None)]
    want = sum(k == m and v != w for k, v in a for m, w in b if None not in (k, v, m, w))
    x, y = spark.createDataFrame(a, "k int, v double"), spark.createDataFrame(b, "k int, v double")
    assert rel.residual_pairs(x, y, ("k", "v"), ("k", "v")).first().n == want
    assert rel.residual_pairs(x.limit(0), y, ("k", "v"), ("k", "v")).first().n == 0
    for name in ("j_residual", "a_smallest_union"):
        for sf in ("sf0.01", "sf0.1"):
            sql = engine.ORACLE_SQL[name].replace("customer", f"'/root/testdata/{sf}/customer.parquet'").replace("supplier", f"'/root/testdata/{sf}/supplier.parquet'")
            assert rows(engine.QUERIES[name](spark, f"/root/testdata/{sf}").toPandas()) == rows(duck.execute(sql).df())


def test_bootstrap_draws_ten_thousand(spark):
    import inspect
    import random

    assert inspect.signature(stats.bootstrap).parameters["resamples"].default == 10_000
    diffs = [random.Random(1).choice([-1.0, 0.0, 0.0, 2.0]) for _ in range(3)] + [1.0, -1.0, 0.0, 3.0] * 25
    df = spark.createDataFrame([*enumerate(diffs)], "i long, d double")
    out, again = stats.bootstrap(df, "d").first(), stats.bootstrap(df.orderBy("d"), "d").first()
    mean = sum(diffs) / len(diffs)
    half = 1.959964 * math.sqrt(sum((d - mean) ** 2 for d in diffs)) / len(diffs)
    assert out == again and out.mean == pytest.approx(mean) and out.n == len(diffs)
    assert out.low == pytest.approx(mean - half, abs=0.03) and out.high == pytest.approx(mean + half, abs=0.03)
    assert tuple(stats.bootstrap(df.limit(0), "d").first()) == (None, None, None, 0)
    labels = engine.QUERIES["a_bootstrap"](spark, SF)
    d = tables.load(spark, SF, "labels").selectExpr("quality - toxic AS diff", "doc_id")
    assert labels.first() == stats.bootstrap(d, "diff", 10_000).first()


def test_digest_order_ranks_every_row(spark):
    out = engine.QUERIES["w_digest_order"](spark, SF).toPandas()
    assert len(out) == tables.load(spark, SF, "customer").count() and all(sorted(g) == list(range(1, len(g) + 1)) for _, g in out.groupby("c_mktsegment")["rank"])


def test_best_fit_split_loses_nothing(spark):
    out = engine.QUERIES["t_best_fit_split"](spark, SF).toPandas()
    want = tables.load(spark, SF, "documents", ["doc_id", "n_chars"]).toPandas().set_index("doc_id").n_chars
    got = out.groupby("doc_id").n.sum()
    assert len(got) == len(want) and (got == want[got.index]).all() and out.groupby("bin").n.sum().max() <= 8192
    assert not out.duplicated(["doc_id", "part"]).any() and (out.groupby("doc_id").part.max() == (-(-want // 8192) - 1).clip(lower=0)).all()
    with pytest.raises(ValueError):
        chat.pack_best_fit(spark.range(1), "id", "id", 1, "drop")
