"""Versions of tables and names in texts against plain computations."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.functions import text as tx
from ledgerloom.operators import artifacts, gazetteer
from ledgerloom.sources import pins

SF = "/root/testdata/sf0.001"
ROWS = "k int, v string, w double"


def plain_changes(before, now):
    was, is_, out = Counter(before), Counter(now), {}
    for row in was.keys() | is_.keys():
        lost, gained = max(0, was[row] - is_[row]), max(0, is_[row] - was[row])
        if lost or gained:
            a, b, new = out.get(row[0], (0, 0, False))
            out[row[0]] = (a + lost, b + gained, new or was[row] == 0)
    name = lambda a, b, new: "changed" if a and b else "lost" if a else "added" if new else "doubled"
    return {(k, name(*v), v[0], v[1]) for k, v in out.items()}


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def sample(n, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(n), rng.choice(["a", "b", None, "", "é\n"]), rng.choice([0.5, None, 2.0])) for _ in range(n)]
    return rows + rows[: n // 10] + [(None, None, None)] * 3 + [(7, "hot", 1.0)] * n


@pytest.mark.parametrize("leaf", [4, 4096])
def test_changes_are_located(spark, tmp_path, leaf):
    before = sample(300, 1)
    now = [r for r in before[40:] if r[0] != 11] + [(5, "changed", 1.0), (1000, "new", None), (None, None, None)] + before[50:53]
    path = str(tmp_path / "t")
    for state in (before, now):
        made = pins.publish_version(spark.createDataFrame(state, ROWS), path, ["k"], leaf=leaf)
    assert made["rows"] == len(now) and made["version"] == 2 and (made["depth"] > 0) == (leaf == 4)
    assert rows_of(pins.compare_versions(spark, path, 1, 2)) == plain_changes(before, now)
    assert rows_of(pins.compare_versions(spark, path, 2, 1)) == plain_changes(now, before)
    assert Counter(map(tuple, pins.read_version(spark, path, 1).collect())) == Counter(before)
    assert not rows_of(pins.verify_version(spark, path)) and not rows_of(pins.compare_versions(spark, path, 1, 1))


def test_only_parts_that_differ_are_read(spark, tmp_path):
    path, rows = str(tmp_path / "t"), [(i, str(i), 0.0) for i in range(500)]
    a = pins.publish_version(spark.createDataFrame(rows, ROWS), path, ["k"], leaf=8)
    b = pins.publish_version(spark.createDataFrame([*rows[:-1], (499, "x", 0.0)], ROWS).repartition(3), path, ["k"], leaf=8)
    trees = [pins.read_tree(spark, f"{path}/{m['tree']}") for m in (a, b)]
    assert a["depth"] == 2 and pins.differing_parts(*trees, 2).count() <= 2 and a["root"] != b["root"]
    again = pins.publish_version(spark.createDataFrame(rows[::-1], ROWS).repartition(5), path, ["k"], leaf=8)
    assert again["root"] == a["root"]


def test_empty_tables_and_other_depths(spark, tmp_path):
    path, rows = str(tmp_path / "t"), [(i, "x", 1.0) for i in range(100)]
    empty = pins.publish_version(spark.createDataFrame([], ROWS), path, ["k"], leaf=4)
    pins.publish_version(spark.createDataFrame(rows, ROWS), path, ["k"], leaf=4)
    assert empty["rows"] == 0 and empty["root"] is None and pins.read_version(spark, path, 1).count() == 0
    assert rows_of(pins.compare_versions(spark, path, 1, 2)) == plain_changes([], rows)
    assert rows_of(pins.compare_versions(spark, path, 2, 1)) == plain_changes(rows, [])


def test_a_publish_that_dies_leaves_the_version_before(spark, tmp_path):
    path, df = tmp_path / "t", spark.createDataFrame([(1, "a", 1.0)], ROWS)
    pins.publish_version(df, str(path), ["k"], note={"by": "test"})
    with pytest.raises(ValueError, match="gates failed: rows"):
        pins.publish_version(df, str(path), ["k"], (("rows", lambda x: x.count() > 1),))
    whole = (path / "_versions" / f"{1:010}").read_text()
    (path / "_versions" / f"{2:010}").write_text(whole[: len(whole) // 2])
    assert pins.manifest(spark, str(path))["version"] == 1 and pins.manifest(spark, str(path))["note"] == {"by": "test"}
    with pytest.raises(FileNotFoundError):
        pins.manifest(spark, str(path), 2)
    (path / "data-of-a-dead-publish").mkdir()
    assert "data-of-a-dead-publish" in pins.sweep(spark, str(path)) and pins.read_version(spark, str(path)).count() == 1
    assert pins.publish_version(df, str(path), ["k"])["version"] == 3
    with pytest.raises(FileNotFoundError):
        pins.manifest(spark, str(tmp_path / "nothing"))


def test_files_changed_after_publishing_are_found(spark, tmp_path):
    path, rows = str(tmp_path / "t"), [(i, str(i), 0.0) for i in range(50)]
    made = pins.publish_version(spark.createDataFrame(rows, ROWS), path, ["k"], leaf=8)
    other = [*rows[1:20], (20, "other", 0.0), *rows[21:], rows[30]]
    spark.createDataFrame(other, ROWS).write.mode("overwrite").parquet(f"{path}/{made['data']}")
    assert rows_of(pins.verify_version(spark, path)) == {(0, "lost", 1, 0), (20, "changed", 1, 1), (30, "doubled", 0, 1)}


def test_versions_query_equals_located_changes(spark):
    q = entry.queries()
    found = rows_of(q["s_versions"](spark, SF))
    assert found and found == rows_of(q["s_located_changes"](spark, SF))


WORDS = ["ash", "oak", "Élan", "inc", "co", "fir", "elm", "of", "Söl"]


def plain_names(df, names, ignore=None):
    return sorted(map(tuple, tx.names_in(df, "t", names, ignore).select("i", "names").collect()), key=repr)


@pytest.mark.parametrize("seed,stretch,hot", [(1, 500_000, 256), (2, 7, 3), (3, 1, 10**9)])
def test_names_equal_the_dictionary(spark, monkeypatch, seed, stretch, hot):
    monkeypatch.setattr(gazetteer, "STRETCH", stretch)
    monkeypatch.setattr(gazetteer, "HOT", hot)
    rng = random.Random(seed)
    phrase = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    names = sorted({phrase(rng.randint(1, 4)) for _ in range(60)} | {"Ash & Oak", "ash and oak", "...", "oak  oak"})
    texts = [phrase(rng.randint(0, 40)) + rng.choice([".", "", " & Oak", "\n"]) for _ in range(150)] + [None, "", "oak oak oak", "oak oak oak oak", "ash and oak"]
    rows = [(i, t, rng.choice([None, "", phrase(3)]), "keep") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0]], "i int, t string, q string, names string")
    table = spark.createDataFrame([(n,) for n in [*names, names[0]]] + [(None,)], "name string")
    for ignore in (None, "q"):
        got = sorted(map(tuple, gazetteer.named_in(df, "t", table, "name", ignore).select("i", "names").collect()), key=repr)
        assert got == plain_names(df, names, ignore)


def test_no_names_no_texts(spark):
    df = spark.createDataFrame([(1, "ash")], "i int, t string")
    none = spark.createDataFrame([], "name string")
    assert gazetteer.named_in(df, "t", none, "name").collect()[0].names == []
    assert gazetteer.named_in(df.limit(0), "t", spark.createDataFrame([("ash",)], "name string"), "name").count() == 0


def test_many_names(spark):
    """More names than one dictionary takes: equal to a set of the texts' own runs of words."""
    names = spark.range(300_000).select(F.concat(F.lit("n"), (F.col("id") % 3000).cast("string"), F.lit(" m"), F.floor(F.col("id") / 3000).cast("string")).alias("name"))
    rng = random.Random(4)
    texts = [" ".join(f"{rng.choice('nm')}{rng.randrange(3100)}" for _ in range(200)) + f" n{i} m{i % 90} x" for i in range(300)]
    got = {r.i: r.names for r in gazetteer.named_in(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", names, "name").collect()}
    fits = lambda a, b: a[0] == "n" and b[0] == "m" and int(a[1:]) < 3000 and int(b[1:]) < 100
    for i, t in enumerate(texts):
        w = t.split()
        assert got[i] == sorted({f"{a} {b}" for a, b in zip(w, w[1:]) if fits(a, b)})


def test_phrases_query_equals_the_dictionary(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    names = sorted({" ".join((t or "").split()[:n]) for (_, t) in docs.collect() for n in (2, 3, 4)})
    want = tx.names_in(docs, "text", names).select("doc_id", F.size("names"), F.sha2(F.array_join("names", ","), 256))
    assert rows_of(entry.queries()["f_phrases_in_documents"](spark, SF)) == rows_of(want)


KNOWN = "artifact_id string, path string, kind string, sha256 string"
FILES = "path string, sha256 string"


def test_artifacts_by_path_and_content(spark):
    rows = [("a", "/d/a.json", "dev", "1"), ("a", "/d/./a.json", "dev", "1"), ("b", "/d/b.json", "sealed", "2"), ("c", "/d/c.json", "dev", "3"), ("e", "/d/x/../c.json", "sealed", "3"), ("f", "/d/f.json", "dev", "4"), ("f", "/d/g.json", "dev", "4")]
    known = artifacts.registrations(spark.createDataFrame(rows, KNOWN))
    assert rows_of(artifacts.conflicts(known)) == {("path", "/d/c.json", 2), ("artifact_id", "f", 2)}
    files = [("file:///d//a.json", "1"), ("/../d/b.json", "2"), ("/d/a.json", "2"), ("/d/a.json", None), ("/d/c.json", "3"), ("/d/g.json", "4"), ("d/a.json", "1"), (None, "1"), ("", "1")]
    got = [tuple(r)[1:] for r in artifacts.classified(spark.createDataFrame(files, FILES).coalesce(1), known).collect()]
    no = lambda s: (None, None, s)
    assert sorted(got, key=repr) == sorted([("a", "dev", "registered"), ("b", "sealed", "registered"), no("altered"), no("altered"), no("conflicting"), no("conflicting"), *[no("unregistered")] * 3], key=repr)
    assert artifacts.admitted(spark.createDataFrame(files[:1], FILES), known, ["dev"]).count() == 1
    for bad, why in ((files[1], "is sealed"), (files[2], "is altered"), (files[4], "is conflicting"), (files[6], "is unregistered"), (files[7], "null is unregistered")):
        with pytest.raises(Exception, match=why):
            artifacts.admitted(spark.createDataFrame([bad], FILES), known, ["dev"]).count()
    with pytest.raises(Exception, match="lacks"):
        artifacts.registrations(spark.createDataFrame([("a", None, "dev", "1")], KNOWN)).count()
