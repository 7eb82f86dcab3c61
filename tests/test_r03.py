"""Findings of round 3: odd inputs, bounded batches and parts."""

import itertools
from difflib import SequenceMatcher

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from ledgerloom.operators import answers, batch, chat, gazetteer, relational as rel


def test_names_of_a_text_whose_runs_are_dealt_over_batches():
    """F1, F8: runs are rows; a text's runs may end in a later batch."""
    assert not hasattr(gazetteer.asserted_names, "returnType")  # no function of whole lists
    runs = [(1, 0, 0, 1, "ash", "Ash"), (1, 0, 1, 3, "oak fir", "Oak Fir"), (1, 0, 2, 3, "fir", "Fir"), (1, 1, 0, 1, "ash", "Ash"), (7, 0, 0, 1, "fir", "Fir"), (9, 1, 0, 1, "fir", "Fir")]
    for size in (1, 2, 4, 6):
        cut = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*runs[i : i + size])], names=["_row", "side", "first", "after", "form", "name"]) for i in range(0, len(runs), size)]
        got = [tuple(r.values()) for b in gazetteer.asserted_names(iter(cut)) for r in b.to_pylist()]
        assert got == [(1, ["Oak Fir"]), (7, ["Fir"]), (9, [])]
    assert list(gazetteer.asserted_names(iter([]))) == []


def test_exposure_is_that_of_its_sql(spark, tmp_path):
    """white space, compatibility forms, sharp s and letters of their own small form count as the SQL counts them."""
    items = ["two  words here", "one\nline", "STRASSE", "straße", "ﬁne print", "fine print", "İstanbul", "istanbul", "ΟΔΟΣ", "οδος", "οδοσ", "", None, "a"]
    texts = ["Two words here.", "two  WORDS here", "one line", "ONE\nLINE", "Die Straße", "die strasse", "the ﬁne print", "FINE PRINT", "in İSTANBUL", "istanbul", "ΟΔΟΣ", "οδος", "", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    for t in ("benchmark", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = sorted(c.execute(entry.oracle_sql()["g_exposure"]).fetchall())
    assert want and sorted(map(tuple, entry.queries()["g_exposure"](spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("threshold", [0.86, 0.6])
def test_names_alike_over_blocks(spark, monkeypatch, threshold):
    """names are compared block by block, each pair once, and what the signatures leave is little."""
    names = ["".join(p) for p in itertools.product(("Jo", "Jó", "El"), ("da", "sama ", "ni"), ("Guko", "Ber"), ("son", "sön", ""))] + ["", "E", "JODASON"]
    monkeypatch.setattr(rel, "BLOCK", 7)
    near = []
    monkeypatch.setattr(rel, "stored", lambda df, name, f=rel.stored: near.append((name, f(df, name))) or near[-1][1])
    df = spark.createDataFrame([*enumerate(names), (None, "Jodaber"), (99, None)], "k long, name string")
    got = {(r.a, r.b): r.ratio for r in rel.ratio_pairs(df, "k", "name", threshold).collect()}
    ratio = lambda i, j: SequenceMatcher(None, names[i].casefold(), names[j].casefold()).ratio()
    assert got == {(i, j): ratio(i, j) for i, j in itertools.combinations(range(len(names)), 2) if ratio(i, j) >= threshold}
    found = dict(near)["near-names"]
    assert found.count() == found.distinct().count() and (threshold < 0.8 or found.count() < len(names) ** 2 / 4)


def test_lists_keep_their_nulls_and_sizes():
    """Arrow arrays in, Arrow arrays out, a few texts as Python objects at a time."""
    import public_tokenizers
    from tokenizers import Tokenizer

    kind = pa.list_(pa.string())
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = pa.array([["a b", None, ""], None, [], ["ñ"]], kind)
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids
    assert chat.library_ids(path).func(texts[0:0]).to_pylist() == []
    for part in (texts, texts.slice(1), texts.slice(3)):
        assert chat.library_ids(path).func(part).to_pylist() == [None if t is None else [ids(x) for x in t] for t in part.to_pylist()]
    lists = pa.array([[["A  b..", None], None], None, [], [[], ["ﬁ."]]], pa.list_(kind))
    assert answers.answer_forms.func(lists).to_pylist() == [[["a b", None], None], None, [], [[], ["fi"]]]
    assert answers.answer_forms.func(lists.slice(3)).to_pylist() == [[[], ["fi"]]]


@pytest.mark.parametrize("name", ["n_multipart", "g_graded_sql"])
def test_costly_rows_of_one_file_are_many_tasks(spark, monkeypatch, name):
    """F7, F16: the one part of a small file is dealt over the cores before its rows are read."""
    seen = []
    for module in (answers, batch):
        monkeypatch.setattr(module, "dealt", lambda df, key, f=module.dealt: seen.append(f(df, key)) or seen[-1])
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert seen and seen[0].rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
