"""Findings of round 3: pools whose steps are dealt by their rows, and probes that read a pool once."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.functions import sqltext
from ledgerloom.operators import probes, tasks
from ledgerloom.sources import stored as steps

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_probes_read_a_pool_that_is_made_once(spark, monkeypatch):
    """the pool is stored before probes and reserved tasks are taken from it."""
    seen = []
    monkeypatch.setattr(probes, "structured_probes", lambda pool, *a, f=probes.structured_probes, **k: seen.append(pool) or f(pool, *a, **k))
    made = []
    monkeypatch.setattr(tasks, "fingerprints", lambda c, f=tasks.fingerprints: made.append(c) or f(c))
    entry.queries()["t_probe_checks"](spark, SF)
    assert len(made) == 1 and "ArrowEvalPython" not in plan(seen[0]) and steps.once(seen[0], "again") is seen[0]


def test_probes_scan_no_sql(spark, monkeypatch):
    """families of a pool that isn't stored are told from the stored one, so no SQL is scanned twice."""
    names = []
    monkeypatch.setattr(probes, "stored", lambda df, name, f=probes.stored: names.append((name, df.columns)) or f(df, name))
    monkeypatch.setattr(steps, "stored", lambda df, name, f=steps.stored: names.append((name, df.columns)) or f(df, name))
    pool = spark.createDataFrame([("a", "SELECT 1", "f", 0), ("b", "SELECT 2", "g", 2)], "task_id string, gold_sql string, fingerprint string, join_arity int")
    wide = pool.withColumns({"fields_used": F.array(F.lit("x")), "values_used": F.array(F.lit("y")), "predicate": F.lit('{"op":"eq"}'), "answer_type": F.lit("set"), "train": F.array(F.lit("t")), "full": F.array(F.lit("t")), "operation_family": sqltext.operation_family(F.col("gold_sql"))})
    out = probes.structured_probes(wide, F.col("join_arity") < 2, [], n_reserved=0)
    assert [n for n, _ in names] == ["probe-pool", "probe-reserved"] and names[1][1] == ["task_id", "gold_sql", "fingerprint"] and "ArrowEvalPython" not in plan(out)
    assert sorted(r.example_id for r in out.collect()) == ["composition_b", "held_in_a", "structured_paraphrase_a"]


def test_spans_of_odd_sql():
    """one expression finds what the scanner found."""
    for sql, want in {
        "a 'b''c' d": [("string", 2, 8)], "'a''": [("string", 2, 4)], "'a'''": [("string", 0, 5)], "x -- 'y\n'z'": [("comment", 2, 7), ("string", 8, 11)], "/*'": [], "/* ' */ \"a\"\"\"": [("comment", 0, 7), ("name", 8, 13)],
        "[a]]b] `c``": [("name", 0, 3), ("name", 9, 11)], "-- end": [("comment", 0, 6)], "[": [], "": [], "/*a\nb*/'\n'": [("comment", 0, 7), ("string", 7, 10)],
    }.items():
        assert sqltext.spans(sql) == want, sql
        assert sqltext.masked(sql, "_", True) == "".join("_" if any(a <= i < b for _, a, b in want) else c for i, c in enumerate(sql))
    assert sqltext.masked("'" + "''" * 200_000 + "'") == " "


@pytest.mark.parametrize("name", ["t_composition_pool", "t_prose", "t_ranked_pool", "t_task_pool"])
def test_steps_of_a_pool_are_dealt_by_their_rows(spark, monkeypatch, name):
    """F10, F12 to F14: holders, supports, pairs and lists are shuffled over as many tasks as their rows ask for; the session's number stays."""
    key = "spark.sql.shuffle.partitions"
    before, seen = spark.conf.get(key), []
    monkeypatch.setattr(steps, "ROWS_A_TASK", 100)
    monkeypatch.setattr(tasks, "stored", lambda df, n, f=tasks.stored: seen.append((n, int(spark.conf.get(key)))) or f(df, n))
    entry.queries()[name](spark, SF)
    of = [p for n, p in seen if n in ("pool-holders", "pool-support", "pool-golds")]
    # 10 suppliers keep the session's number; 6,000 lines are 60 tasks.
    assert 60 in of and len(of) >= 6 and spark.conf.get(key) == before


def test_pairs_are_shuffled_only_to_be_counted_and_listed(spark, monkeypatch):
    """levels are told before terms are paired, so pairs aren't grouped to be made distinct."""
    seen = {}
    monkeypatch.setattr(tasks, "stored", lambda df, n, f=tasks.stored: seen.update({n: df}) or f(df, n))
    a = spark.createDataFrame([(1, "train", "x"), (1, "dev", "x"), (1, "train", None), (2, "test", "x"), (3, "dev", "z"), (None, "train", "x")], "e long, split string, t string")
    b = spark.createDataFrame([(1, "k"), (1, "k"), (1, None), (2, "k"), (2, "l"), (3, "k")], "e long, u string")
    got = tasks.composition_tasks(a, b, "p", ("held", "other"), "e", "split", ("t", "u")).collect()
    assert [(r.values_used, r.train, r.train_dev, r.full, r.entity_dependent) for r in got] == [(["x", "k"], ["1"], ["1"], ["1", "2"], True)]
    pairs = seen["pool-holders"]
    assert set(pairs.columns) == {"e", "va", "level", "vb"} and "min(" not in plan(pairs)


def test_one_task_a_text_without_shuffling_lists(spark):
    """texts that occur once are not shuffled; of those that occur twice one stays."""
    shape = "shape string, gold_sql string, train array<string>"
    once = tasks.distinct_sql(spark.createDataFrame([("a", "Q1", ["x"]), ("b", "Q2", [])], shape))
    assert "Exchange" not in plan(once) and once.count() == 2
    rows = [("a", "Q1", ["x"]), ("a", "Q1", ["x"]), ("b", "Q2", []), ("c", None, []), ("c", None, [])]
    assert sorted(map(str, tasks.distinct_sql(spark.createDataFrame(rows, shape)).collect())) == sorted(map(str, spark.createDataFrame([rows[0], rows[2], rows[3]], shape).collect()))
    assert tasks.distinct_sql(spark.createDataFrame([], shape)).count() == 0
