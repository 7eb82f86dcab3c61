"""Identity groups, group splits and literals in texts against plain computations."""

import random
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import identity, literals, relational as rel


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "path", "hot", "none"])
def test_components_equal_union_find(spark, shape):
    rng = random.Random(2)
    if shape == "random":
        links = [(rng.randrange(150), f"n{rng.randrange(300):03}") for _ in range(330)]
    elif shape == "path":
        order = rng.sample(range(300), 300)
        links = [(i, f"n{order[j]:03}") for i in range(299) for j in (i, i + 1)]
    else:
        links = [(0, f"n{i:04}") for i in range(2000)] + [(1, "n0007"), (1, "zz")] if shape == "hot" else []
    hubs = defaultdict(list)
    for h, n in links:
        hubs[h].append(n)
    want = union_find([(ns[0], n) for ns in hubs.values() for n in ns], {n for _, n in links})
    got = identity.components(spark.createDataFrame(links, "hub long, name string")).collect()
    assert {r.name: r.group for r in got} == want and len(got) == len(want)


NAMES = ["Acme Inc.", "ACME", "Acme Holdings North America", "Acme Tooling", "Beta Works", "Beta-Works LLC", "Colour Works", "Color Works", "Delta", "Delta Parts", "Delta Parts Usa", "Straße 1", "STRASSE 1", "--", "Epsilon", "Group", "Co"]


def test_candidates_hold_every_pair_of_the_sweeps(spark):
    cut = lambda s: re.sub("[^a-z0-9 ]", " ", s.casefold()).split()
    got = defaultdict(set)
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    for r in identity.collision_candidates(df).collect():
        got[r.sweep, r.hub].add(r.name)
    for sweep, same in (
        ("first_token", lambda p, q, a, b: p[:1] == q[:1] != []), ("token_prefix", lambda p, q, a, b: p and q and (q == p[: len(q)] or p == q[: len(p)])),
        ("ratio", lambda p, q, a, b: SequenceMatcher(None, a.casefold(), b.casefold()).ratio() >= 0.86),
    ):
        want = {(a, b) for i, a in enumerate(sorted(NAMES)) for b in sorted(NAMES)[i + 1 :] if same(cut(a), cut(b), a, b)}
        held = [names for (s, _), names in got.items() if s == sweep]
        for a, b in want:
            assert any({a, b} <= names for names in held), (sweep, a, b)
        if sweep != "token_prefix":
            assert {(a, b) for names in held for a in names for b in names if a < b} == want
    keys = {frozenset(v) for (s, _), v in got.items() if s == "suffix_key"}
    assert frozenset(["Beta Works", "Beta-Works LLC"]) in keys and frozenset(["Group", "Co", "--"]) in keys


def test_review_and_references(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    found = spark.createDataFrame([("s", h, n) for h, ns in {"1": "ab", "2": "abc", "3": "bc", "4": "cd", "5": "de", "6": "ef"}.items() for n in ns], "sweep string, hub string, name string")
    sets = lambda d: spark.createDataFrame([(k, n) for k, ns in d.items() for n in ns], "label string, name string")
    got = {r.hub: r.disposition for r in identity.dispositions(found, sets({"x": "ab", "y": "bcq"}), sets({"z": "abc", "u": "cd", "v": "bc", "w": "dex"})).collect()}
    assert got == {"1": "approved", "2": "reviewed", "3": "reviewed", "4": "reviewed", "5": "reviewed_subset", "6": "unmapped"}
    by = {r.name: r.group for r in identity.approved_groups(names, sets({"acme": ["Acme Inc.", "ACME"]})).collect()}
    assert by["ACME"] == by["Acme Inc."] == "acme" and by["Delta"] == "Delta" and len(by) == len(NAMES)
    for bad in ({"x": ["ACME"], "y": ["ACME"]}, {"x": ["nobody"]}):
        with pytest.raises(ValueError):
            identity.approved_groups(names, sets(bad))
    rows = spark.createDataFrame([("Delta",), ("Not specified",), (None,), ("Delta Parts",), ("Delta and Omega",)], "r string")
    assert {r.name for r in identity.referenced_names(names, rows, "r").collect()} == {"Delta", "Delta Parts"}
    assert [tuple(r) for r in identity.uncovered_references(names, rows, "r").collect()] == [("Delta and Omega", ["and", "omega"])]


def test_no_group_is_in_two_splits(spark):
    rng = random.Random(4)
    rows = [(i, None if i % 97 == 0 else f"g{int(rng.random() ** 3 * 60)}", rng.choice(["s", "t", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "i long, g string, s string")
    forced = spark.createDataFrame([("g0",), ("g5",), ("absent",), (None,)], "g string")
    out = identity.assign_group_splits(df, "i", "g", "s", "salt", forced, 0.2, 0.3)
    got = out.collect()
    assert len(got) == len(rows) and identity.split_checks(out.withColumn("n", F.col("g")), "n", "g", "i").first().asDict() == {"names_apart": 0, "groups_apart": 0, "repeated_rows": 0, "misplaced": 0, "empty_splits": 0}
    of = {r.g: r.split for r in got}
    assert of[None] == of["g0"] == of["g5"] == "train" and {r.g for r in got if r.held_in} == {"g0", "g5"}
    first = {}
    for i, g, s in rows:
        first.setdefault(g, s)
    for s, n in Counter(s for g, s in first.items() if g not in (None, "g0", "g5")).items():
        own = Counter(of[g] for g, x in first.items() if x == s and g not in (None, "g0", "g5"))
        assert (own["dev"], own["test"]) == (round(n * 0.2), round(n * 0.3))
    plain = rel.assign_splits(df, "g", "s", "salt", 0.2, 0.3).collect()
    assert len(plain) == len(rows) and len({(r.g, r.split) for r in plain}) == len({r.g for r in plain})


def test_anchors_of_a_literal_are_anchors_of_the_text():
    rng = np.random.default_rng(1)
    for g in (1, 2, 4, 8, 32, 64):
        text = rng.integers(0, 3, 400).astype("<u4")
        at, h = literals.anchors(text, g)
        k, w = literals.gram(g), g - literals.gram(g) + 1
        all_ = literals.gram_hashes(text, k)
        assert set(at.tolist()) == {i for i in range(len(all_)) if any(all_[i] == all_[a : a + w].min() for a in range(max(0, i - w + 1), min(i, len(all_) - w) + 1))}
        for a in range(0, 300, 37):
            own, own_h = literals.anchors(text[a : a + g + g // 2], g)
            assert len(own) and set(zip((own + a).tolist(), own_h.tolist())) <= set(zip(at.tolist(), h.tolist()))


def test_a_hundred_thousand_literals(spark):
    import ahocorasick

    rng = random.Random(6)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(300)]
    docs = [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(300)] + ["", None, "é😀" * 500]
    needles = [d[a : a + rng.choice([1, 2, 3, 5, 8, 13, 40, 100, 300])] for d in docs[:300] for a in [rng.randrange(len(d)) for _ in range(40)]]
    needles += ["".join(rng.choices("abcde f", k=rng.randint(3, 60))) for _ in range(88_000)] + ["é😀é", "😀" * 2, None, ""]
    auto = ahocorasick.Automaton()
    for n in needles:
        if n:
            auto.add_word(n, n)
    auto.make_automaton()
    hits = Counter(n for d in docs if d for n in {n for _, n in auto.iter(d)})
    want = {i: hits[n] for i, n in enumerate(needles) if n and hits[n]}
    df = spark.createDataFrame([(d,) for d in docs], "t string").repartition(7)
    lit = spark.createDataFrame(list(enumerate(needles)), "i long, l string")
    assert {r.i: r.n_docs for r in literals.exposed(df, "t", lit, "i", "l", exact=True).collect()} == want
    assert literals.exposed(df.limit(0), "t", lit, "i", "l").count() == literals.exposed(df, "t", lit.limit(0), "i", "l").count() == 0
