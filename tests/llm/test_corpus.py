"""The corpus operators against brute force, and on awkward and empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from ledgerloom.llm import bpe, fingerprints, jaccard_join, packing, quality, repeats, sharding, statistics, substring_dedup, suffix_dedup, topk, url_filter, windows
from ledgerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def write(folder, name, rows, schema):
    pq.write_table(pa.Table.from_pylist(rows, schema=schema), folder / f"{name}.parquet")


DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("size", pa.string()), ("batch", pa.string()), ("n", pa.string()), ("score", pa.string())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("rule", pa.string())])
VECS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("rank", pa.string())])


@pytest.fixture(scope="module", params=["awkward", "empty"])
def folder(request, tmp_path_factory):
    """Nulls in any column, empty and long texts, repeated rows, extra columns with clashing names; or no rows."""
    d = tmp_path_factory.mktemp(request.param)
    base = " ".join(f"word{i}x" for i in range(400))
    texts = [None, "", " \n\t ", base, base, base.replace("word7x", "other"), "a b c", "é" * 300, "x " * 30_000, base[500:1500] + " tail é", "<|endoftext|> it's  10 \r\n", "ＡＢ\x1c\x85 ok"]
    docs = [dict(doc_id=i, text=t, lang="en" if i % 3 else None, source=None if i == 2 else f"s{i % 2}", n_chars=i, size="x", batch="y", n=None, score="z") for i, t in enumerate(texts)]
    docs += [docs[3], dict(docs[6], doc_id=None), dict(docs[0], doc_id=None)]
    labels = [dict(doc_id=i, quality=None if i == 4 else i % 2, toxic=0) for i in range(12)] + [dict(doc_id=None, quality=1, toxic=None)]
    pages = [dict(page_id=i, url=u, host="h", rule=None) for i, u in enumerate([None, "", "nothing", "http://A.Example.com/en/x?q#f", "https://www.example.com/en/", "x://b.net/es/1", "x://net", "://org?a=b&c", "http://org#x/y", "http://notexample.com/en/"])]
    vecs = [dict(vec_id=i, embedding=v, label=0, rank="r") for i, v in enumerate([[0.5, 0.25], [0.5, 0.25], None, [None, 1.0], [float("nan"), 0.0], [-0.1, 0.3], [], [float("inf"), 1.0]])]
    vecs += [dict(vecs[0], vec_id=100), dict(vecs[0], vec_id=100), dict(vecs[0], vec_id=None)]
    keep = (lambda r: r) if request.param == "awkward" else (lambda r: [])
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, LABELS), ("pages", pages, PAGES), ("embeddings", vecs, VECS)):
        write(d, name, keep(rows), schema)
    return d, len(keep(docs))


def order_key(doc_id) -> int:
    return 2**63 - 1 if doc_id is None or doc_id != doc_id else int(doc_id)


def without_repeats(docs, unit):
    """(doc_id, symbols, removed flags, raw text) by looking at every window."""
    low: dict = {}
    seqs = []
    for i, t in docs:
        raw = (t or "").encode()
        seq = WORD.findall(raw) if unit == "words" else raw
        keys = [tuple(seq[p : p + 50]) if unit == "words" else seq[p : p + 50] for p in range(len(seq) - 49)]
        seqs.append((i, seq, keys))
        for k in keys:
            low[k] = min(low.get(k, 2**63), order_key(i))
    for i, seq, keys in seqs:
        gone = bytearray(len(seq))
        for p, k in enumerate(keys):
            if low[k] < order_key(i):
                gone[p : p + 50] = b"\1" * 50
        yield i, seq, gone


def repeat_rows(docs, unit):
    out = []
    for i, seq, gone in without_repeats(docs, unit):
        kept = b" ".join(w for w, g in zip(seq, gone) if not g) if unit == "words" else bytes(w for w, g in zip(seq, gone) if not g)
        row = [order_key(i), len(seq), sum(gone), hashlib.sha256(kept).hexdigest()]
        out.append(tuple(row if unit == "words" else [*row[:3], len(re.findall(rb"\x01+", bytes(gone))), row[3]]))
    return sorted(out)


def shingle_sets(docs):
    sets = []
    for _, t in docs:
        w = (t or "").encode().split()
        sets.append((b" ".join(w), frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return sets


def near_groups(docs):
    """(links, class links, representative class id, group id) of each row, from all pairs of texts."""
    sets = shingle_sets(docs)
    classes: dict = {}
    for (i, _), (words, s) in zip(docs, sets):
        c = classes.setdefault(words, dict(set=s, size=0, first=2**63 - 1))
        c["size"] += 1
        c["first"] = min(c["first"], order_key(i))
    names = list(classes)
    root = {w: w for w in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near: dict = {w: [] for w in names}
    for x, a in enumerate(names):
        for b in names[x + 1 :]:
            s, t = classes[a]["set"], classes[b]["set"]
            if s and t and (n := len(s & t)) >= 0.8 * (len(s) + len(t) - n) - 1e-9:
                near[a].append(b)
                near[b].append(a)
                root[find(b)] = find(a)
    low: dict = {}
    for w in names:
        low[find(w)] = min(low.get(find(w), 2**63 - 1), classes[w]["first"])
    return [(order_key(i), classes[w]["size"] - 1 + sum(classes[o]["size"] for o in near[w]), len(near[w]), classes[w]["first"], low[find(w)]) for (i, _), (w, _) in zip(docs, sets)]


def best_scores(rows):
    """op4 by all pairs; components saturate at the ends of a long, as scores do."""
    bound = lambda s: max(-(2**63), min(2**63 - 1, s))
    fine = [(r, i, [bound(int(np.floor(float(np.float32(x)) * 1024))) for x in v]) for r, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for r, i, v in fine:
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), j, q) for q, j, w in fine if q != r and len(w) == len(v))[:10]
            out += [(i, n + 1, j, bound(-x)) for n, (x, j, _) in enumerate(s)]
    return sorted(out)


def plain_rows(frame, *columns):
    return sorted(tuple(None if x is None or x != x else x for x in r) for r in frame[list(columns)].itertuples(index=False))


def pieces_fit(out, docs):
    """Every id of every document in exactly one piece, sequences without gaps and padding."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want[order_key(i), len(ids), int(ids.astype(np.int64).sum())] += 1
    assert out.length.sum() == sum(n * k for (_, n, _), k in want.items())
    assert Counter(out.drop_duplicates(["doc_id", "start", "sequence_id", "offset"]).groupby(out.doc_id.map(order_key)).length.sum().to_dict()) == Counter({i: sum(n * k for (j, n, _), k in want.items() if j == i) for i in {w[0] for w in want}})
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]]
    size = out.groupby("sequence_id").length.sum()
    assert ((size == 2048) | ((size & (size - 1)) == 0)).all()


@pytest.mark.parametrize("name", [*(q for q in QUERIES if q not in ("op12_lexical", "op13_cobucket")), "pipeline"])  # those two: test_new.py
def test_awkward_tables(spark, folder, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, n = folder
    out = (corpus_pipeline.run if name == "pipeline" else QUERIES[name])(spark, str(path)).toPandas()
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(path / "documents.parquet").to_pylist()]
    if name not in ("op1_url_filter", "op4_topk", "op8_packing", "pipeline"):
        assert len(out) == n and sorted(map(order_key, out.doc_id)) == sorted(order_key(i) for i, _ in docs)
    if name == "op1_url_filter":
        rows = pq.read_table(path / "pages.parquet").num_rows
        got = {r.page_id: (r.host, r.path, r.rule) for r in out.itertuples()}
        assert len(out) == rows and out.verdict.isin(["allow", "block"]).all()
        want = {0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("a.example.com", "/en/x", "example.com/en/"), 4: ("www.example.com", "/en/", "www.example.com/en/"), 5: ("b.net", "/es/1", "net/es/"), 6: ("net", "", None), 7: ("org", "", None), 8: ("org", "", None), 9: ("notexample.com", "/en/", "com/")}
        assert not rows or got == want
    elif name in ("op2_substring_dedup", "op7_suffix_dedup"):
        out["doc_id"] = out.doc_id.map(order_key)
        words = name.startswith("op2")
        assert plain_rows(out, *(["doc_id", "n_words", "n_removed", "kept_sha256"] if words else ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])) == repeat_rows(docs, "words" if words else "bytes")
    elif name == "op3_sharding":
        raw = lambda t: (t or "").encode()
        out["doc_id"] = out.doc_id.map(order_key)
        assert plain_rows(out, "doc_id", "size", "text_crc32") == sorted((order_key(i), len(raw(t)) + 8, zlib.crc32(raw(t))) for i, t in docs)
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard")) and (out.groupby("text_crc32").shard.nunique() == 1).all()
    elif name == "op4_topk":
        assert plain_rows(out, "query_id", "rank", "vec_id", "score") == best_scores([(r["vec_id"], r["embedding"]) for r in pq.read_table(path / "embeddings.parquet").to_pylist()])
    elif name == "op5_fingerprints":
        assert Counter(out.n_chars) == Counter(len(t or "") for _, t in docs) and out.near_edited.between(0, 1).all() and out.near_next.between(0, 1).all()
    elif name == "op6_jaccard_join":
        for c in ("doc_id", "class_id", "group_id"):
            out[c] = out[c].map(order_key)
        want = [r for r, (_, s) in zip(near_groups(docs), shingle_sets(docs)) if s]
        got = out[out.doc_id.map(lambda i: i in {r[0] for r in want}) & (out.group_id.isin([r[4] for r in want]))]
        assert Counter(plain_rows(got, "doc_id", "n_links", "n_class_links", "class_id", "group_id")) >= Counter(want)
    elif name == "op8_packing":
        pieces_fit(out, docs)
    elif name == "op9_quality":
        assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
        crc = lambda i: zlib.crc32(b"" if order_key(i) == 2**63 - 1 else str(int(i)).encode()) % 5 == 0
        assert (out.held_out == out.doc_id.map(crc)).all()
        same = out.merge(pd.DataFrame(docs, columns=["doc_id", "text"]).dropna().drop_duplicates(), on="doc_id")
        assert (same.groupby("text").score.nunique() == 1).all()
    elif name == "op10_bpe":
        lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        want = []
        for i, t in docs:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            want.append((order_key(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        out["doc_id"] = out.doc_id.map(order_key)
        assert plain_rows(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)
    else:
        assert (len(out) > 0) == (n > 0) and set(out.doc_id.dropna()) <= {i for i, _ in docs}


def documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    return d.sort_values("doc_id").reset_index(drop=True)


def test_url_rules(spark):
    from pyspark.sql import functions as F

    urls = {
        "http://A.Example.com/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "x://b.net/es/1": ("b.net", "/es/1", "net/es/", "block"), "x://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "http://a.com": ("a.com", "", None, None), "junk": ("", "", None, None),
        "a://m.www.example.com/en/": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    h, p = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    r = url_filter.rule_of(h, p)
    for row in df.select("url", h.alias("h"), p.alias("p"), r.alias("r")).collect():
        assert (row.h, row.p, row.r and row.r.rule, row.r and row.r.verdict) == urls[row.url]


def test_url_trees_learn(spark):
    rows = [(f"http://{'spam-' * (i % 2)}site{i}.org/{'x/' * (i % 2)}", i % 2) for i in range(400)]
    model = url_filter.fit(spark.createDataFrame(rows[:300], "url string, label int"))
    out = url_filter.judge(spark.createDataFrame(rows[300:], "url string, label int"), model).toPandas()
    assert ((out.verdict == "block") == (out.label == 1)).mean() > 0.95
    hot = url_filter.fit(spark.createDataFrame(rows[:300] + rows[:1] * 5_000, "url string, label int"), max_rows=300)
    assert hot.prior == model.prior and hot.suffix_rates == model.suffix_rates  # one URL is one row, however often it occurs


@pytest.mark.parametrize("name,unit", [("op2_substring_dedup", "words"), ("op7_suffix_dedup", "bytes")])
@pytest.mark.parametrize("hot,batch,group", [(2000, 1_000_000, 4_096), (2, 20_000, 4_096), (2, 20_000, 4), (10_000, 20_000, 5)])
def test_repeats(spark, monkeypatch, name, unit, hot, batch, group):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "STRINGS", 2_000 if batch == 1_000_000 else 3)
    monkeypatch.setattr(repeats, "BATCH", batch)
    out = QUERIES[name](spark, SF).toPandas()
    d = documents(spark)
    assert plain_rows(out, *out.columns) == repeat_rows(list(zip(d.doc_id, d.text)), unit)
    assert out.n_removed.sum()


def test_counts_of_variants_are_never_told_too_small():
    n = np.concatenate([np.arange(1, 20_000), np.geomspace(20_000, 5e7, 2_000).astype(np.int64)])
    told = repeats.STEPS[np.searchsorted(repeats.STEPS, n).astype("u1")]
    assert len(repeats.STEPS) == 256 and (told >= n).all() and (told <= 1.07 * n + 1).all()
    body = " ".join(f"{'the same twelve words stand at the start of each of these many'} {' '.join(f'w{i}x{j}' for j in range(60))}" for i in range(10_000)).encode()
    b = repeats.Batch("words", np.array([1], "<i8").tobytes(), np.array([len(body)], "<i8").tobytes(), body)
    assert b.variants.max() <= repeats.STEPS[np.searchsorted(repeats.STEPS, b.variants.max())] and b.variants.max() > 5_000


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op7_suffix_dedup"])
def test_equal_hashes_are_not_equal_texts(spark, monkeypatch, name):
    """With hashes of 6 bits, anchors, segments and buckets collide all the time; results stay exact."""
    monkeypatch.setattr(repeats, "find_runs", lambda *a: crowded(windows.find_runs(*a)))
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: windows.mix(x) % np.uint64(64))
    d = documents(spark).head(60)
    docs = spark.createDataFrame(d[["doc_id", "text"]]).coalesce(1)
    op = substring_dedup.substring_dedup if name.startswith("op2") else suffix_dedup.suffix_dedup
    out = op(docs).toPandas()
    unit = "words" if name.startswith("op2") else "bytes"
    want = {r[0]: (r[2], r[-1]) for r in repeat_rows(list(zip(d.doc_id, d.text)), unit)}
    assert {r.doc_id: (r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in out.itertuples()} == want


def crowded(found):
    runs, hashes = found
    few = lambda x: windows.mix(x % np.uint64(64))
    return windows.Runs(few(runs.key), few(runs.segment), runs.start, runs.windows, runs.place), None if hashes is None else few(hashes)


def test_own_columns_survive(spark):
    """Columns named like statistics, results or inner columns."""
    from pyspark.sql import functions as F

    base = " ".join(f"w{i}" for i in range(80))
    extra = dict(n=7, n_removed=8, spans="s", kept="k", batch="b", docs="d", carry="c", size="z", key="y", score=0.5, s_bytes=1.5, domain="own", tld="own", f_len=3, shard=99, _size=4)
    rows = spark.createDataFrame([dict(doc_id=i, text=base, url="http://a.example.org/x", **extra) for i in range(3)])
    for op in (substring_dedup.substring_dedup, suffix_dedup.suffix_dedup):
        out = op(rows).orderBy("doc_id").collect()
        assert [r.n_removed > 0 for r in out] == [False, True, True] and all((r.batch, r.carry, r.domain, r["size"]) == ("b", "c", "own", "z") for r in out)
    out = quality.scored(rows, quality.RuleEnsemble(prior=0.25), rows.columns).collect()
    assert all((r.score, r.s_bytes, r.batch) == (0.25, 1.5, "b") for r in out) and len(out) == 3
    out = url_filter.judge(rows, url_filter.UrlModel()).collect()
    assert all((r.domain, r.tld, r.f_len, r.host, r.verdict) == ("own", "own", 3, "a.example.org", "allow") for r in out)
    out = sharding.assign_shards(rows.withColumn("b8", F.lit(8)), "doc_id", "b8").collect()
    assert all(0 <= r.shard < 24 and r._size == 4 for r in out)


@pytest.mark.parametrize("on_disk", [False, True])
def test_columnwise_construction(monkeypatch, on_disk):
    if on_disk:
        monkeypatch.setattr(suffix_dedup, "IN_MEMORY", 0)
    rng = np.random.default_rng(0)
    for _ in range(60):
        lens = rng.integers(0, 12, rng.integers(1, 8))
        data = rng.integers(97, 97 + rng.integers(1, 4), lens.sum()).astype(np.uint8)
        off = np.cumsum(lens) - lens
        strings = [data[a : a + n].tobytes() for a, n in zip(off, lens)]
        s, n, common, _ = suffix_dedup.construct(data, lens)
        got = [(strings[i][len(strings[i]) - k :], int(i)) for i, k in zip(s, n)]
        assert got == sorted((x[len(x) - k :], i) for i, x in enumerate(strings) for k in range(len(x) + 1))
        for (a, _), (b, _), c in zip(got, got[1:], common[1:]):
            assert c == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_groups_stay_together():
    rng = np.random.default_rng(2)
    for _ in range(200):
        group = np.repeat(np.arange(12), rng.integers(0, 9, 12))
        most = int(rng.integers(1, 20))
        parts = list(suffix_dedup.together(np.arange(len(group)), group, most))
        assert np.concatenate([*parts, np.zeros(0, int)]).tolist() == list(range(len(group)))
        assert all(len(p) <= most or len(set(group[p])) == 1 for p in parts) and not any(set(group[p]) & set(group[q]) for p, q in zip(parts, parts[1:]))


def test_sharding(spark):
    d, out = documents(spark), sharding.op3_sharding(spark, SF).toPandas()
    t = d.set_index("doc_id").text
    assert sorted(out.doc_id) == sorted(d.doc_id) and out.shard.between(0, 23).all()
    assert all(r.size_ == len(t[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(t[r.doc_id].encode()) for r in out.rename(columns={"size": "size_"}).itertuples())
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert (out.groupby(out.doc_id.map(t)).shard.nunique() == 1).all()
    load = out.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= out.groupby(out.doc_id.map(t))["size"].sum().max()
    assert sharding.lpt([(0, 5), (1, 4), (2, 3), (3, 3), (4, 3)], 2) == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1}


@pytest.mark.parametrize("page,tree", [(48, 4096), (4, 100)])
def test_topk(spark, monkeypatch, page, tree):
    monkeypatch.setattr(topk, "PAGE", page)
    monkeypatch.setattr(topk, "TREE", tree)
    out = topk.op4_topk(spark, SF).toPandas()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    assert plain_rows(out, "query_id", "rank", "vec_id", "score") == best_scores([(int(i), list(v)) for i, v in zip(e.vec_id, e.embedding)])


def test_topk_repeated_ids_and_large_components(spark, monkeypatch, tmp_path):
    rows = [(100, [0.5, 1.0]), (100, [2.0, -1.0]), (100, [0.5, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 1.0]), (1, [1.0, 1.0]), (200, [4e9, 4e9]), (3, [4e9, -4e9]), (4, [3e38, 3e38]), (0, [1.0, 2.0, 3.0]), (5, [0.0, 0.0, 1e20])]
    monkeypatch.setattr(topk, "TREE", 3)
    write(tmp_path, "embeddings", [dict(vec_id=i, embedding=v) for i, v in rows], VECS)
    out = topk.op4_topk(spark, str(tmp_path)).toPandas()
    assert plain_rows(out, "query_id", "rank", "vec_id", "score") == best_scores(rows)


def test_topk_meets_few_trees_where_vectors_have_clusters(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(topk, "TREE", 50)
    rng = np.random.default_rng(4)
    x = np.repeat(np.eye(16, dtype=int)[:8] * 4000, 100, axis=0) + rng.integers(-60, 60, (800, 16))
    df = spark.createDataFrame([(r, r, [int(v) for v in w]) for r, w in enumerate(x)], "rid long, vec_id long, q array<bigint>")
    met = []
    monkeypatch.setattr(topk, "_met", lambda pairs, own=topk._met: met.append((pairs.count(), own(pairs).count())) or own(pairs))
    out = topk.top_k(df.where(F.col("vec_id") % 100 == 0), df, 3).toPandas()
    want = [(q, n + 1, int(v), int(x[v] @ x[q])) for q in range(0, 800, 100) for n, v in enumerate([v for v in np.lexsort((np.arange(800), -(x @ x[q]))) if v != q][:3])]
    assert plain_rows(out, "query_id", "rank", "vec_id", "score") == sorted(want)
    every, kept = met[0]
    assert kept < every / 2


def test_topk_pairs_are_dealt_to_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCKS_AT_ONCE", 4)
    monkeypatch.setattr(topk, "BALLS_AT_ONCE", 8)
    blocks = spark.createDataFrame([(b, 3 + (b % 10 == 0), b"q") for b in range(60)], "block long, width int, q_q binary")
    balls = spark.createDataFrame([(t, 3 + (t % 5 == 0), b"c", 0.5) for t in range(100)], "tree long, width int, centre binary, radius double")
    pairs = topk._paired(blocks, balls)
    assert pairs.columns == ["width", "block", "q_q", "tree", "centre", "radius"]
    want = sorted((b, t) for b in range(60) for t in range(100) if (b % 10 == 0) == (t % 5 == 0))
    assert sorted(map(tuple, pairs.select("block", "tree").collect())) == want
    assert topk._paired(blocks.limit(0), balls).count() == topk._paired(blocks, balls.limit(0)).count() == 0


def test_mtree_skips_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (20, 8))
    x = (centres[rng.integers(0, 20, 3000)] + rng.integers(-40, 40, (3000, 8))).astype(np.int64)
    t = topk.MTree(np.arange(3000), x)
    for q in range(20):
        s = x @ x[q]
        want = [(int(s[j]), int(j)) for j in np.lexsort((np.arange(3000), -s)) if j != q][:10]
        assert t.search(q, x[q], 10) == want
    assert t.computed < 20 * 3000 / 2


def test_fingerprints(spark):
    out = fingerprints.op5_fingerprints(spark, SF).toPandas().sort_values("doc_id", ascending=False).reset_index(drop=True)
    d = documents(spark).sort_values("doc_id", ascending=False).reset_index(drop=True)

    def bag(t):
        return Counter(w for w in re.split(r"[ \t-\r]+", t) if w)

    def alike(a, b):
        return sum((a & b).values()) / max(1, sum((a | b).values()))

    error = []
    for i, t in enumerate(d.text):
        nxt, half = d.text[(i + 1) % len(d)], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert out.n_chars[i] == len(t) and out.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest()
        error += [out.near_edited[i] - alike(bag(t), bag(edited)), out.near_next[i] - alike(bag(t), bag(nxt))]
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.12
    assert (out.groupby(d.text).fingerprint.nunique() == 1).all()


@pytest.mark.parametrize("leaf,weight", [(2048, 8_000_000), (2, 8_000_000), (2048, 1_000)])
def test_jaccard_join(spark, monkeypatch, leaf, weight):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "LEAF_SHINGLES", weight)
    out = jaccard_join.op6_jaccard_join(spark, SF).toPandas()
    d = documents(spark)
    docs = list(zip(d.doc_id, d.text))
    want = {r[0]: r[1:] for r, (_, s) in zip(near_groups(docs), shingle_sets(docs)) if s}
    got = {r.doc_id: (r.n_links, r.n_class_links, r.class_id, r.group_id) for r in out.itertuples() if r.doc_id in want}
    assert got == want and any(r[1] for r in want.values())


def test_jaccard_large_group_and_recall(spark, monkeypatch):
    """A group of near-copies that no path can split, and runs that follow the target recall."""
    monkeypatch.setattr(jaccard_join, "LEAF", 16)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(60)] + [(100 + i, " ".join(f"y{i}_{k}" for k in range(30))) for i in range(20)] + [(None, "one two"), (None, "one two"), (7, None)]
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    big = out[out.doc_id < 60]
    assert (big.n_links[big.doc_id != 7] == 59).all() and (out[out.doc_id >= 100].n_links == 0).all()
    assert out[out.doc_id.isna()].n_links.tolist() == [1, 1]
    assert [jaccard_join.runs_for(r) for r in (0.5, 0.9, 0.99, 0.9999)] == [1, 2, 3, 6]
    with pytest.raises(ValueError):
        jaccard_join.runs_for(1.0)


@pytest.mark.parametrize("bits", [0, 3])
def test_jaccard_classes_of_one_name_are_told_apart(spark, monkeypatch, bits):
    """With names of 3 bits (or none) all rows are as with 64."""
    d = documents(spark)
    df = spark.createDataFrame([(int(i), t) for i, t in zip(d.doc_id, d.text)] + [(None, "one two"), (900_001, "one  two"), (900_002, None), (900_003, "")], "doc_id long, text string")
    columns = ["doc_id", "class_id", "class_size", "n_links", "n_class_links", "group_id"]
    shown = lambda: sorted(map(str, jaccard_join.near_duplicates(df).select(*columns).collect()))
    want = shown()
    monkeypatch.setattr(jaccard_join, "NAME_BITS", bits)
    assert shown() == want and len(want) == df.count()


def test_shards_of_a_table_with_any_column_names(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i % 7, 10 + i, i, i, i, i, i) for i in range(50)], "_g long, _size long, _own long, _bundle long, _bundle_ long, _SIZE_ long, shard long")
    out = sharding.assign_shards(rows, "_g", "_size", shards=3, fine=1)
    assert sorted(out.columns) == sorted(rows.columns) and out.count() == 50
    assert out.groupBy("_g").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    assert {r["_bundle"] for r in out.collect()} == set(range(50))


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    out = packing.op8_packing(spark, SF).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    d = documents(spark)
    by = {k: g.sort_values("start") for k, g in out.groupby("doc_id")}
    for i, t in zip(d.doc_id, d.text):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in by[i].itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]]
    size = out.groupby("sequence_id").length.sum()
    assert (((size == 2048) | ((size & (size - 1)) == 0))).all() and sorted(size.index) == list(range(len(size)))
    # Every full window holds each source at its share of all tokens, to within a few tokens.
    x = out.merge(d[["doc_id", "source"]], on="doc_id")
    full = x[x.sequence_id.map(size) == 2048].groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0)
    share = x.groupby("source").length.sum() / x.length.sum() * 2048
    assert (full - share).abs().to_numpy().max() < 4


def test_round_robin_carries_deficits():
    totals = np.array([1000, 10, 333])
    bounds = packing.plan_chunks(totals, totals.astype(float), 1, 64)
    assert (np.diff(bounds, axis=0) >= 0).all() and (bounds[-1] == totals).all()
    ideal = np.outer(bounds.sum(axis=1), totals) / totals.sum()
    assert np.abs(bounds - ideal).max() < 2


def test_packing_keeps_many_sources_apart(spark):
    rows = [(i, "x " * (40 + 3 * (i % 7)), f"site{i % 300}.example" if i % 300 else None) for i in range(900)] + [(900, "x " * 3000, "big.example"), (901, "x " * 2600, None), (902, "x " * 1500, "site7.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {i: s for i, _, s in rows}

    def held(**k):
        out = packing.pack(docs, sequence=64, **k).toPandas()
        assert (out.sort_values(["doc_id", "start"]).groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all() and len(set(out.doc_id)) == 903
        out["source"] = out.doc_id.map(source).fillna("none")
        return out.groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0).sort_index().iloc[:-8]

    x = held()
    total = packing.pack(docs, sequence=64).toPandas()
    share = total.assign(source=total.doc_id.map(source).fillna("none")).groupby("source").length.sum() / total.length.sum()
    apart = (x.cumsum() - np.outer(64 * np.arange(1, len(x) + 1), share[x.columns])).abs()
    assert x.shape[1] == 301 and (apart < 64 * share[x.columns] + 2).all(axis=None)  # a window's share, and rounding
    x = held(weights={"big.example": 1.0, "site7.example": 1.0, None: 2.0})[["big.example", "site7.example", "none"]].iloc[:4]
    assert (x - [16, 16, 32]).abs().to_numpy().max() <= 1


def test_pieces_are_the_same_in_blocks(monkeypatch):
    quota = np.array([700, 0, 55, 301])
    docs = {0: (np.array([0, 650]), np.array([5, 6]), np.array([3, 0]), np.array([650, 50])), 2: (np.array([0]), np.array([7]), np.array([0]), np.array([55])), 3: (np.array([0, 1]), np.array([8, 9]), np.array([0, 0]), np.array([1, 300]))}

    def pieces(plan):
        monkeypatch.setattr(packing, "MAX_PLAN", plan)
        return sorted(tuple(map(int, r)) for part in packing.cut_pieces(quota, docs, 10, 64) for r in zip(*part))

    assert pieces(1 << 20) == pieces(1) == pieces(12) and sum(r[2] for r in pieces(1)) == quota.sum()


def test_quality(spark):
    out = quality.op9_quality(spark, SF).toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    out = quality.op9_quality(spark, "/root/testdata/sf0.01").toPandas()
    m = out.merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == (m.score >= 0.3)).all() and (m.predicted == m.quality).mean() > 0.95


def test_bpe_equals_library():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own, rng = Tokenizer.from_file(path), bpe.loaded(path), random.Random(3)
    parts = ["a", "e", " ", "  ", "th", "ing", "\n", "\t", "é", "ß", "日", "😀", "1", "23", "'s", "'ll", "!", "##", "###", "<|endoftext|>", "\x1c", "\x85", "\xa0", "\u2028", "\u200b", "\x00", "İ", "\r", "aaaaaaa", "zzz"]
    for k in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) if k % 2 else "".join(chr(rng.randint(97, 122)) for _ in range(rng.randint(1, 60)))
        want = lib.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert own.decode(got).decode() == lib.decode(want, skip_special_tokens=False)


def test_quality_scores_by_hand(spark):
    """The compiled column against the rules read one by one."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    out = quality.scored(docs, model, ["doc_id"]).toPandas().set_index("doc_id").score
    assert model.rules
    for i, t in docs.select("doc_id", "text").collect():
        x = statistics.describe(t)
        z = model.intercept + sum(w for w, rule in model.rules if all((x[f] <= cut) == at_most for f, at_most, cut in rule)) + sum(w * min(max(x[f], low), high) for w, f, low, high in model.linear)
        assert out[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_bpe_query_equals_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    big = "/root/testdata/sf0.01"
    out = bpe.op10_bpe(spark, big).toPandas().set_index("doc_id")
    for i, t in pd.read_parquet(f"{big}/documents.parquet", columns=["doc_id", "text"]).itertuples(index=False):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert tuple(out.loc[i]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def whole_characters(seq, gone):
    out, at = [], 0
    for c in seq.decode():
        n = len(c.encode())
        if not any(gone[at : at + n]):
            out.append(c)
        at += n
    return "".join(out)


def test_pipeline_stages(spark):
    """Every stage on what the one before kept, against a plain computation."""
    from ledgerloom.llm.common import persist_table

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    before = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = persist_table(stage(spark, docs, SF), f"test-{name}")
        after = docs.toPandas()
        own = list(zip(before.doc_id.tolist(), before.text.tolist()))
        if name == "packing":
            pieces_fit(after, own)
            break
        assert docs.columns == corpus_pipeline.COLUMNS and not after.doc_id.duplicated().any()
        after = after.sort_values("doc_id").reset_index(drop=True)
        text = dict(zip(after.doc_id, after.text))
        if name == "quality":
            kept = quality.scored(spark.read.parquet(f"{SF}/documents.parquet"), model, ["doc_id"]).where("score >= 0.3").toPandas().doc_id
            assert set(text) == set(kept) and all(text[i] == t for i, t in own if i in text)
        elif name == "near_duplicates":
            sets = shingle_sets(own)
            first_empty = min((i for (i, _), (_, s) in zip(own, sets) if not s), default=None)
            want = {r[0] for r, (_, s) in zip(near_groups(own), sets) if s and r[0] == r[4]} | ({first_empty} - {None})
            assert set(text) == want and len(want) < len(own)
        else:
            assert text == {i: whole_characters(seq, gone) for i, seq, gone in without_repeats(own, "bytes")}
        before = after


def test_pipeline_keeps_rows_apart(spark):
    """Repeated doc_ids, null doc_ids and genuine replacement characters."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(3, base), (5, base), (5, "another text of its own"), (None, base), (None, "a third text"), (None, "a third text"), (8, "listed twice"), (8, "listed twice")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], ", ".join(f"{c} {t}" for c, t in zip(corpus_pipeline.COLUMNS, ["long", "string", "string", "string", "long"])))
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(3, base), (5, rows[2][1]), (None, "a third text"), (8, "listed twice")])
    shared = "é" * 24 + "0123456789"
    texts = {1: "x" + shared, 2: "q\ufffdz" + "é" * 2 + shared[1:] + "\ufffd end"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], docs.schema)
    out = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    assert out == {i: whole_characters(seq, gone) for i, seq, gone in without_repeats(list(texts.items()), "bytes")} and out[2].count("\ufffd") == 2
