"""Findings of round 4: rows that grow faster than the input."""

import itertools
import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.functions import text as tx
from ledgerloom.operators import gazetteer, identity, relational as rel


def recorded(monkeypatch, module):
    kept = []
    monkeypatch.setattr(module, "stored", lambda df, name, f=module.stored: kept.append((name, f(df, name))) or kept[-1][1])
    return kept


def test_a_form_goes_on_once_a_text(spark, monkeypatch):
    """runs are settled before they are stored; a text's runs that lie in longer names, or come again, make no rows."""
    kept = recorded(monkeypatch, gazetteer)
    names = spark.createDataFrame([(n,) for n in ("ash oak", "ash oak fir", "oak fir", "fir")], "name string")
    df = spark.createDataFrame([(1, "Ash oak fir, x. " * 50), (2, "oak fir x fir y fir " * 20), (3, "elm")], "i int, t string")
    got = {r.i: r.names for r in gazetteer.named_in(df, "t", names, "name").collect()}
    assert got == {1: ["ash oak fir"], 2: ["fir", "oak fir"], 3: []}
    runs = [t for name, t in kept if name == "gazetteer-runs"]
    assert [t.count() for t in runs] == [3]


@pytest.mark.parametrize("bits", [6, 8, 12])
def test_runs_that_pass_by_chance_take_no_place(spark, monkeypatch, bits):
    """where the filter lets through what is no form, the text's runs all go on and are settled after the join."""
    kept = recorded(monkeypatch, gazetteer)
    monkeypatch.setattr(gazetteer, "LEAST_BITS", bits)
    monkeypatch.setattr(gazetteer, "MOST_BITS", bits)
    rng = random.Random(bits)
    phrase = lambda n: " ".join(rng.choice(["ash", "oak", "fir", "elm", "Söl", "inc", "of", "yew"]) for _ in range(n))
    names = sorted({phrase(rng.randint(1, 4)) for _ in range(40)} | {"oak oak"})
    df = spark.createDataFrame([(i, phrase(rng.randint(0, 30)), rng.choice([None, phrase(3)])) for i in range(120)] + [(120, None, None), (121, "oak oak oak oak", None)], "i int, t string, q string")
    table = spark.createDataFrame([(n,) for n in names], "name string")
    for ignore in (None, "q"):
        got = {r.i: r.names for r in gazetteer.named_in(df, "t", table, "name", ignore).collect()}
        assert got == {r.i: r.names for r in tx.names_in(df, "t", names, ignore).collect()}
    assert bits > 8 or any(name == "gazetteer-doubtful" for name, _ in kept)


def subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        row = list(itertools.accumulate(range(len(b)), lambda left, k: max(left, row[k + 1], row[k] + (x == b[k])), initial=0))
    return row[-1]


@pytest.mark.parametrize("block,together", [(100_000, 1_000_000), (9, 50)])
def test_names_left_to_measure_have_a_common_subsequence(spark, monkeypatch, block, together):
    """what goes on to be measured has the letters in order, and each pair goes on once; a cell of many names is many parts."""
    monkeypatch.setattr(rel, "BLOCK", block)
    monkeypatch.setattr(rel, "TOGETHER", together)
    monkeypatch.setattr(rel, "LEAST_BLOCK", 20)
    kept = recorded(monkeypatch, rel)
    rng = random.Random(block)
    spell = lambda k: "".join(rng.choice(["an", "jo", "el", "ma", "ber", "koe"]) for _ in range(k))
    names = sorted({f"{spell(rng.randint(1, 3))} {spell(rng.randint(1, 4))}" for _ in range(150)} | {"".join(p) for p in itertools.permutations("abcd")} | {"", "x" * 70, "x" * 71, "x" * 64, "x" * 65})
    got = {(r.a, r.b): r.ratio for r in rel.ratio_pairs(spark.createDataFrame(list(enumerate(names)), "k long, name string"), "k", "name", 0.8).collect()}
    ratio = lambda i, j: SequenceMatcher(None, names[i], names[j]).ratio()
    assert got == {(i, j): ratio(i, j) for i, j in itertools.combinations(range(len(names)), 2) if ratio(i, j) >= 0.8}
    tables = dict(kept)
    f = {r._i: r.f for r in tables["signed"].collect()}
    near = [(f[r.i], f[r.j]) for r in tables["near-names"].collect()]
    assert len(near) == len({frozenset(p) for p in near})
    assert all(subsequence(a, b) >= 0.4 * len(a + b) - 1e-9 for a, b in near)


def test_subsequences_and_blocks_equal_the_plain_ones():
    """the bits give the common subsequence's length, and matched characters are those of difflib."""
    rng = random.Random(3)
    names = ["".join(rng.choice("abé ") for _ in range(rng.choice([0, 1, 5, 12, 63, 64, 65]))) for _ in range(60)]
    n = np.array([len(x) for x in names])
    i, j = (np.array(x) for x in zip(*itertools.product(range(60), repeat=2)))
    got = rel.common_subsequence(rel.letter_codes(pa.chunked_array([names]), n), n, i, j)
    for a, b, size in zip(i, j, got.tolist()):
        assert size == (subsequence(names[a], names[b]) if max(n[a], n[b]) <= 64 else np.iinfo(np.int64).max)
        assert tx.matched_characters(names[a], names[b]) == sum(m.size for m in SequenceMatcher(None, names[a], names[b]).get_matching_blocks())


def test_pairs_are_stars_around_their_first_names(spark, monkeypatch):
    """pairs are not a hub each; names that hold the mark between two names stay apart."""
    seen = []
    monkeypatch.setattr(identity, "components", lambda links, f=identity.components: seen.append(links) or f(links))
    pairs = [("a", "b"), ("a", "c"), ("c", "d"), ("e\0x", "f"), ("e", "g")]
    rows = [("ratio", "\0".join(p), n) for p in pairs for n in p]
    names = spark.createDataFrame([(n,) for n in ["a", "b", "c", "d", "e", "e\0x", "f", "g", "h"]], "name string")
    got = {r.name: r.group for r in identity.identity_groups(names, spark.createDataFrame(rows, "sweep string, hub string, name string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "g": "e", "e\0x": "e\0x", "f": "e\0x", "h": "h"}
    assert seen[0].select("hub").distinct().count() == 4
