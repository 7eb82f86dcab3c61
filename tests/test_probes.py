"""Evaluation probes: awkward rows by value, and each check broken on purpose."""

from pyspark.sql import functions as F

from ledgerloom.operators import probes

KB = "row_id long, name string, split string, city string, kind string"


def test_fact_probes_on_awkward_rows(spark):
    rows = [
        (1, "Ann", "train", "Oslo", None), (1, "Ann", "train", "Oslo", None),  # repeated: one fact
        (2, "Bo", "dev", "Rome", "x"), (2, "Bo", "dev", "Paris", "x"),  # city told in two ways: no probe
        (3, "Cy", "test", None, "y"), (3, "Cy", "test", "Bonn", "y"),  # told and not told: no probe
        (None, "Di", "train", "Oslo", "x"), (4, None, "train", "Oslo", "x"), (5, "E's", "train", "", "z" * 100_000),
    ]
    got = probes.fact_probes(spark.createDataFrame(rows, KB), "row_id", "name", "split", ["city", "kind"], "t").collect()
    want = {
        ("fact_recall", "1", "city", "Oslo"), ("fact_paraphrase", "1", "city", "Oslo"), ("fact_recall", "1", "kind", "None is on record."), ("fact_paraphrase", "1", "kind", "None is on record."),
        ("dev_fact", "2", "kind", "x"), ("fact_recall", "3", "kind", "y"), ("fact_paraphrase", "3", "kind", "y"),
        ("fact_recall", "5", "city", ""), ("fact_paraphrase", "5", "city", ""), ("fact_recall", "5", "kind", "z" * 100_000), ("fact_paraphrase", "5", "kind", "z" * 100_000),
    }
    assert {(r.family, *r.example_id[len(r.family) + 1 :].split("_"), r.answer[0]) for r in got} == want and len(got) == len(want)
    assert {r.exposure[0] for r in got if r.entity == "Cy"} == {"held_out_entity"} and {r.scope for r in got if r.entity == "Bo"} == {"train_dev"}
    assert {r.gold_sql for r in got if r.entity == "Ann"} == {"SELECT city AS value FROM t WHERE row_id = 1", "SELECT kind AS value FROM t WHERE row_id = 1"}
    assert probes.fact_probes(spark.createDataFrame([], KB), "row_id", "name", "split", ["city"], "t").count() == 0


def test_value_probes_ask_for_the_number_above_the_cap(spark):
    rows = [(i, f"n{i}", "train" if i else "test", "Oslo" if i < 9 else "Rome", None) for i in range(12)] + [(99, "n99", "test", "O'Hara", None), (100, None, "test", "Rome", None)]
    got = {r.question: r for r in probes.value_probes(spark.createDataFrame(rows, KB), "t", "city", "name", "split", cap=5).collect()}
    assert got["How many have Oslo as their city?"].answer == ["9"] and got["Name all whose city is Rome."].answer == ["n10", "n11", "n9"]
    odd = got["Name all whose city is O'Hara."]
    assert odd.exposure == ["held_out_only"] and odd.gold_sql == "SELECT DISTINCT name FROM t WHERE city = 'O''Hara' ORDER BY name" and len(got) == 3


def test_no_match_names_are_free(spark):
    taken = spark.createDataFrame([("X 000000",), ("X 000002",), ("X 000002",), ("X 1",), (None,)], "name string")
    got = probes.no_match_probes(taken, "t", "name", 3, "X").collect()
    assert sorted(r.entity for r in got) == ["X 000001", "X 000003", "X 000004"] and all(r.answer == [] for r in got)


def test_structured_probes_keep_reserved_tasks_back(spark):
    leaf = '{"op":"%s","field":"city","value":"%s"}'
    pool = [(f"t{i:02}", "filter", ["city"], [str(i)], leaf % ("gt" if i == 7 else "eq", i), 0, "scalar" if i % 2 else "set", ["a"], ["a", "b"], f"Q{i}", f"f{i % 9}") for i in range(10)]
    pool += [("u1", "argmax_topk", ["city"], [], leaf % ("argmax", ""), 0, "top_k", ["a"], ["b"], "Q90", "g1"), ("u2", "filter", ["p", "q"], ["1", "2"], leaf % ("AND", ""), 2, "set", ["a"], ["b"], "Q91", "g2"), ("u3", "filter", ["p"], ["1"], leaf % ("eq", 1), 0, "set", ["a"], ["b"], "Q0", "g3")]
    df = spark.createDataFrame(pool, "task_id string, operation_family string, fields_used array<string>, values_used array<string>, predicate string, join_arity int, answer_type string, train array<string>, full array<string>, gold_sql string, fingerprint string")
    trained = F.col("task_id").startswith("t")
    got = {r.example_id: r for r in probes.structured_probes(df, trained, ["argmax_topk"], n_reserved=2).collect()}
    # t00 and t01 are kept back, t09 has the fingerprint of t00; t07 compares, so it has no paraphrase; u3 is none of the families.
    held = {f"t{i:02}" for i in range(2, 9)}
    assert set(got) == {f"held_in_{t}" for t in held} | {f"structured_paraphrase_{t}" for t in held - {"t07"}} | {"operation_u1", "composition_u2"}
    assert got["structured_paraphrase_t03"].question == "How many have 3 as their city?" and got["structured_paraphrase_t04"].question == "Name all whose city is 4."
    assert got["composition_u2"].question == "Name all that have 1 as p and 2 as q." and got["composition_u2"].answer == ["b"] and got["held_in_t02"].answer == ["a"]


def test_every_check_tells_its_fault(spark):
    shape = "example_id string, family string, entity string, question string, answer array<string>, gold_sql string, fingerprint string, join_arity int"
    good = [("0", "fact_recall", "A", "q0", ["x"], "s0", None, None), ("1", "fact_recall", "A", "q1", ["x"], "s1", None, None), ("2", "fact_paraphrase", "A", "q2", ["x"], "s1", None, None), ("3", "dev_fact", "B", "q3", ["x"], "s3", None, None), ("4", "composition", None, "q4", ["x"], "s4", "f4", 2), ("5", "no_match", "C", "q5", [], "s5", None, 0)]
    bad = {
        "asked_in_training": ("6", "value_exposure", None, "taught", ["x"], "s6", None, 0), "paraphrase_is_recall": ("6", "fact_paraphrase", "A", "q1", ["x"], "s6", None, None),
        "development_entity_elsewhere": ("6", "fact_recall", "B", "q6", ["x"], "s6", None, None), "repeated_or_null_id": ("5", "held_in", None, "q6", ["x"], "s6", None, 0),
        "without_question_or_answer": ("6", "held_in", None, None, ["x"], "s6", None, 0), "composition_of_other_arity": ("6", "composition", None, "q6", ["x"], "s6", None, None),
        "no_match_with_an_answer": ("6", "no_match", "D", "q6", ["x"], "s6", None, 0), "reserved_task_asked": ("6", "held_in", None, "q6", ["x"], "kept", None, 0),
    }
    taught = spark.createDataFrame([("taught",), ("q0",), (None,)], "anything string")
    kept = spark.createDataFrame([("kept", "f9")], "gold_sql string, fingerprint string")
    checks = lambda rows: {r.check: r.n for r in probes.probe_checks(spark.createDataFrame(rows, shape), taught, kept).collect()}
    assert checks(good) == dict.fromkeys(bad, 0) == checks([])
    for name, row in bad.items():
        assert checks([*good, row]) == {**dict.fromkeys(bad, 0), name: 1}, name
