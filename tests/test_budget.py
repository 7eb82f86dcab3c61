"""Budgets and evidence sets against the sequential rules they stand for."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import relational as rel


def greedy(rows, budget):
    """Whole cycles, then always the next row of the stratum that is furthest behind its share (ties: the larger name)."""
    total = sum(t for _, _, t in rows)
    cycles, rest = divmod(budget, total)
    queues = defaultdict(list)
    for k, s, t in sorted(rows, key=lambda r: (hashlib.sha256(f"s\0{r[0]}".encode()).hexdigest(), r[0])):
        queues[s].append((k, t))
    weight = {s: sum(t for _, t in q) for s, q in queues.items()}
    used, out, spent = dict.fromkeys(queues, 0), [k for k, _, _ in rows] * cycles, 0
    while spent < rest:
        s = max((s for s in queues if queues[s]), key=lambda s: (Fraction(rest * weight[s], total) - used[s], s))
        k, t = queues[s].pop(0)
        out.append(k)
        used[s] += t
        spent += t
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_repetition_equals_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    # One stratum holds most rows.
    rows = [(i, rng.choice("aaaaaaab"), rng.randint(1, 9)) for i in range(400)]
    total = sum(r[2] for r in rows)
    for budget in (total // 3, 2 * total + total // 7, total):
        df = spark.createDataFrame(rows, "k long, s string, tok long")
        assert sorted(r.k for r in rel.repeat_to_budget(df, "k", "s", "tok", budget, "s").collect()) == greedy(rows, budget)


def test_repetition_of_large_counts_and_nothing(spark):
    big = spark.createDataFrame([(i, "ab"[i % 2], 4 * 10**17) for i in range(6)], "k long, s string, tok long")
    assert rel.repeat_to_budget(big, "k", "s", "tok", 48 * 10**17 + 1, "s").count() == 13
    with pytest.raises(ValueError):
        rel.repeat_to_budget(big.limit(0), "k", "s", "tok", 5, "s")


def test_evidence_sets_equal_a_plain_search(spark):
    rng = random.Random(5)
    rows = [(f"t{rng.randrange(12):02}", rng.randrange(60)) for _ in range(500)] + [("t00", e) for e in range(60)] + [(None, 1), ("t01", None), ("a", 3), ("a", 3)]
    got = {r.term: (r.matches, r.other) for r in rel.evidence_sets(spark.createDataFrame(rows, "term string, e long"), "term", "e").collect()}
    held = defaultdict(set)
    for t, e in rows:
        if t is not None and e is not None:
            held[t].add(e)
    first = sorted(t for t in held if len(held[t]) >= 2)[:8]
    everyone = sorted({e for _, e in rows if e is not None})
    assert got == {t: (sorted(held[t])[:2], next((e for e in everyone if e not in held[t]), None)) for t in first}
    assert rel.evidence_sets(spark.createDataFrame([], "term string, e long"), "term", "e").count() == 0


def test_ranked_caps_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = rel.capped(df, "g", 5, F.md5(F.col("id").cast("string")), "id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
