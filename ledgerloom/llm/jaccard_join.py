"""N-gram Jaccard join by chosen paths.

Documents are sets of 5-word shingles; texts of the same words are one class with one set. Classes go by 128 bits
of a digest: 64 name the class, 64 more confirm it, and where one name holds several texts these are named
anew until none does. A set is embedded as ``POSITIONS`` min-hash tokens. A run starts at one sampled token position: sets that
share the token there share a node. Runs are repeated until a pair at the similarity meets in one
of them with probability ``RECALL`` (``runs_for``; 6 runs for 0.9999). A node that is too large is split
again on ``SPLIT`` sampled positions that its path has not used, as long as that at least halves the
number of pairs to compare; one that can't be split so (a large group of true near-copies) is compared in
blocks, all pairs of blocks. Only (node, class) pairs travel while paths are chosen; signatures join at the leaves.
In a leaf, token agreement picks the sets that may have a partner, and these are compared by their
whole sets of 32-bit shingle hashes. At a similarity of 0.8 a split parts a pair with
probability 0.2^SPLIT (0.008) in one run.

A pair that meets in several leaves is counted in the least one only, so links are counted
without listing pairs; leaves give each set's count and a representative of its links (a star),
and groups are the connected components of the stars, found by min-label rounds.

A leaf holds at most ``LEAF`` sets and about ``LEAF_SHINGLES`` shingles (or one set of a longer text), so a
task's memory is bounded but for the longest text.

Defined results: texts of 1 to 4 words are one shingle; texts without words (or null) form one class
with no links to others; repeated rows count as documents; null doc_ids count as larger than any;
of the input only the two named columns are used, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_tables, persist_table, release_shuffles, table
from .windows import mix, word_hashes, words_of

WORDS, SIMILARITY = 5, 0.8
POSITIONS, SPLIT, LEAF, LEAF_SHINGLES, RECALL = 64, 3, 2048, 8_000_000, 0.9999
#: Bits of a digest that name a class (fewer in tests, so that names clash).
NAME_BITS = 64
_RNG = np.random.default_rng(97)
_MULTIPLIERS = _RNG.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RNG.integers(0, 2**63, POSITIONS, dtype=np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """Distinct 64-bit hashes of the word windows of one text (given its word hashes)."""
    if not len(words):
        return words
    n = max(1, len(words) - WORDS + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(words))):
        h = mix(h * np.uint64(3) + words[i : i + n])
    return np.unique(h)


def tokens(sh: np.ndarray) -> np.ndarray:
    """Min-hash tokens (uint32) of a set of shingles."""
    out = np.full(POSITIONS, 2**32 - 1, np.uint64)
    for i in range(0, len(sh), 2048):
        out = np.minimum(out, ((sh[i : i + 2048, None] * _MULTIPLIERS + _ADDENDS) >> np.uint64(32)).min(axis=0))
    return out.astype("<u4")


def _per_document(keys, texts, make):
    """(key, make(word hashes, raw words)) for each text, hashing about a megabyte at a time."""
    raws = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in texts]
    lo, size = 0, 0
    for i, r in enumerate(raws):
        size += len(r)
        if size > 1_000_000 or i == len(raws) - 1:
            own = raws[lo : i + 1]
            body = np.frombuffer(b"".join(own), np.uint8)
            a, b, doc = words_of(body, np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own]))
            h = word_hashes(body, a, b)
            cut = np.searchsorted(doc, np.arange(len(own) + 1))
            for j, x in enumerate(own):
                yield keys[lo + j], make(h[cut[j] : cut[j + 1]], x)
            lo, size = i + 1, 0


def runs_for(recall: float, similarity: float = SIMILARITY) -> int:
    """Runs after which a pair at ``similarity`` has met with probability ``recall``, two splits on the way allowed for."""
    if not 0 < recall < 1:
        raise ValueError("recall must lie between 0 and 1")
    once = similarity * (1 - (1 - similarity) ** SPLIT) ** 2
    return min(POSITIONS, max(1, math.ceil(math.log(1 - recall) / math.log(1 - once) - 1e-9)))


def _digest(raw: bytes) -> tuple[int, int]:
    """Two signed 64-bit halves of the digest of a text's words."""
    d = hashlib.blake2b(b" ".join(raw.split()), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signatures(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc (null: the largest long), tag (hash of the text), cls and sure (digest of the words), n (shingles), sig (tokens)."""
    names = -1 if NAME_BITS == 64 else (1 << NAME_BITS) - 1

    def run(stream):
        for b in stream:
            doc, cls, sure, n, sig = [], [], [], [], []
            for key, (c, k, s) in _per_document(b.column(0).to_pylist(), b.column(2), lambda h, x: (_digest(x), len(sh := shingles(h)), tokens(sh).tobytes())):
                doc.append(key)
                cls.append(c[0] & names)
                sure.append(c[1])
                n.append(k)
                sig.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), b.column(1), pa.array(cls, pa.int64()), pa.array(sure, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["doc", "tag", "cls", "sure", "n", "sig"])

    return df.select(*_row_key(doc_id, text), F.col(text).alias("text")).mapInArrow(run, "doc long, tag long, cls long, sure long, n long, sig binary")


def classes_of(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored rows, stored classes) from stored ``signatures``: each class has one ``sure``; those that had several are named anew."""
    first = F.min(F.struct("doc", "tag"))
    while True:
        facts = [F.count(F.lit(1)).alias("size"), first.alias("first"), F.max("n").alias("n"), F.max("sig").alias("sig"), F.max("sure").alias("sure"), F.min("sure").alias("least")]
        classes = persist_table(sigs.groupBy("cls").agg(*facts), "join-classes", bucket_by="cls")
        clash = classes.where("sure <> least").select("cls", F.lit(True).alias("clash"))
        if not clash.limit(1).count():
            return sigs, classes
        apart = F.when(F.col("clash"), F.xxhash64("cls", "sure")).otherwise(F.col("cls"))
        moved = persist_table(sigs.join(clash, "cls", "left").withColumn("cls", apart).drop("clash"), "join-signatures")
        drop_tables(sigs, classes)
        sigs = moved


def _row_key(doc_id: str, text: str) -> list:
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(F.col(text)).alias("tag")]


_PATHS = "parent long, node long, used long, cls long, n long"


def _starts(runs: int):
    """(cls, n, sig) rows to one row for each run."""

    def run(stream):
        for b in stream:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(-1, POSITIONS)
            for j in range(runs):
                at = j * (POSITIONS // runs)
                child = mix(mix(np.full(len(sig), at + 1, np.uint64)) + sig[:, at])
                used = np.full(len(sig), 1 << at, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sig), np.int64)), pa.array(child.view(np.int64)), pa.array(used), b.column("cls"), b.column("n")], names=["parent", "node", "used", "cls", "n"])

    return run


def _children(stream):
    """(node, used, cls, n, sig) rows to one row for each of ``SPLIT`` positions that the node's path has not used."""
    for b in stream:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(-1, POSITIONS)
        node, path = (b.column(c).to_numpy().view(np.uint64) for c in ("node", "used"))
        at, taken = mix(node + np.uint64(1)) % np.uint64(POSITIONS), path.copy()
        for _ in range(SPLIT):
            at = (at + np.uint64(POSITIONS // SPLIT)) % np.uint64(POSITIONS)
            for _ in range(POSITIONS):
                at = (at + ((taken >> at) & np.uint64(1))) % np.uint64(POSITIONS)
            bit = np.uint64(1) << at
            taken |= bit
            child = mix(mix(node * np.uint64(5) + at + np.uint64(1)) + sig[np.arange(len(node)), at.astype(np.int64)])
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(child.view(np.int64)), pa.array((path | bit).view(np.int64)), b.column("cls"), b.column("n")], names=["parent", "node", "used", "cls", "n"])


def leaves_of(classes: DataFrame, recall: float = RECALL) -> DataFrame:
    """(node, block, cls, blocks, own) of all leaves with at least two sets; with blocks > 1, a leaf is a pair of blocks."""
    large = (F.col("members") > LEAF) | (F.col("weight") > LEAF_SHINGLES)

    def stored(rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        rows = persist_table(rows, f"paths-{level}")
        count = F.count(F.lit(1)).alias("members")
        return rows, persist_table(rows.groupBy("node").agg(count, F.sum("n").alias("weight"), F.min("parent").alias("parent")), f"nodes-{level}")

    rows, nodes = stored(classes.where("n > 0").select("cls", "n", "sig").mapInArrow(_starts(runs_for(recall)), _PATHS), 0)
    open_nodes, done, old, level = nodes.where("members > 1"), [], [], 0
    while True:
        met = rows.select("node", "used", "cls", "n").join(open_nodes.select("node", "members", "weight"), "node")
        if not open_nodes.where(large).limit(1).count():
            done.append(met)
            break
        level += 1
        kids, kid_nodes = stored(met.where(large).select("node", "used", "cls", "n").join(classes.select("cls", "sig"), "cls").mapInArrow(_children, _PATHS), level)
        # Split only where that at least halves the pairs; else the node is a leaf, in blocks.
        square = F.col("members") * F.col("members")
        work = kid_nodes.groupBy("parent").agg(F.sum(square.cast("double")).alias("after"))
        judged = open_nodes.where(large).join(work, F.col("node") == work["parent"]).select("node", (F.col("after") <= square.cast("double") / 2).alias("split"))
        judged = persist_table(judged, f"splits-{level}")
        split = judged.where("split").select("node")
        done.append(met.join(split, "node", "left_anti"))
        open_nodes = kid_nodes.where("members > 1").join(split.withColumnRenamed("node", "parent"), "parent", "left_semi")
        old += [rows, nodes, judged]
        rows, nodes = kids, kid_nodes
    every = done[0].select("node", "cls", "members", "weight")
    for more in done[1:]:
        every = every.unionByName(more.select("node", "cls", "members", "weight"))
    # What no path could split: blocks of about half a leaf, each pair of blocks one leaf.
    parts = F.greatest(F.ceil(F.col("members") * 2 / LEAF), F.ceil(F.col("weight") * 2 / LEAF_SHINGLES))
    blocks = F.when(large, F.least(parts, F.col("members"))).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks.cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j))
    out = persist_table(every.select("node", "cls", blocks.alias("blocks"), own.alias("own"), F.explode(pairs).alias("block")), "join-leaves")
    drop_tables(*old, rows, nodes)
    return out


def _agreeing(sig: np.ndarray, n: np.ndarray, least: int):
    """For each chunk of rows: (first row, boolean matrix of pairs whose tokens agree enough and whose sizes allow the similarity)."""
    g = len(sig)
    for lo in range(0, g, 256):
        part = sig[lo : lo + 256]
        same = np.zeros((len(part), g), np.uint8)
        for p in range(POSITIONS):
            same += part[:, p : p + 1] == sig[:, p]
        a, b = n[lo : lo + 256, None], n[None, :]
        yield lo, (same >= least) & (np.minimum(a, b) >= SIMILARITY * np.maximum(a, b) - 1e-9)


#: Least number of agreeing tokens: at a similarity of 0.8 fewer are met once in about a million pairs.
LEAST = 34


def _candidates(tab: pa.Table) -> pa.Table:
    """Sets of one leaf that may have a partner there."""
    sig = np.frombuffer(b"".join(tab.column("sig").to_pylist()), "<u4").reshape(-1, POSITIONS)
    n = tab.column("n").to_numpy()
    hit = np.zeros(len(n), bool)
    for lo, may in _agreeing(sig, n, LEAST):
        may[np.arange(len(may)), lo + np.arange(len(may))] = False
        hit[lo : lo + len(may)] = may.any(axis=1)
    return tab.select(["node", "block", "cls", "n", "size", "blocks", "own", "sig"]).filter(pa.array(hit))


def common_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j)."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    # Many pairs of few sets: products of incidence blocks over the shingles that two sets have at least.
    size = np.array([len(s) for s in sets])
    _, col, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    useful = freq[col] > 1
    new = np.cumsum(freq > 1) - 1
    row, col = row[useful], new[col[useful]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = max(64, 8_000_000 // len(sets))
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((len(sets), min(width, int(col[-1]) + 1 - lo)), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        total += m @ m.T
    return total[i, j].astype(np.int64)


def _components(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each member's component."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(tab: pa.Table) -> pa.Table:
    """Links of one leaf that have no lesser leaf in common: cls, links (sets), doc_links, root (cls)."""
    cls, n, size = (tab.column(c).to_numpy() for c in ("cls", "n", "size"))
    order = np.argsort(cls)
    cls, n, size = cls[order], n[order], size[order]
    block, blocks = tab.column("block")[0].as_py(), tab.column("blocks")[0].as_py()
    own = tab.column("own").to_numpy()[order]
    node = tab.column("node")[0].as_py()
    sig = np.frombuffer(b"".join(tab.column("sig").to_pylist()), "<u4").reshape(-1, POSITIONS)[order]
    met = tab.column("leaves").to_pylist()
    met = [set(met[k]) for k in order]
    blobs = tab.column("shingles").to_pylist()
    sets = [np.frombuffer(blobs[k], "<u4") for k in order]
    ii, jj = [], []
    for lo, may in _agreeing(sig, n, LEAST):
        a, b = np.nonzero(may)
        a = a + lo
        fit = a < b
        if blocks > 1:  # pairs within a block belong to the leaf of that block alone
            first, second = block // blocks, block % blocks
            fit &= (np.minimum(own[a], own[b]) == first) & (np.maximum(own[a], own[b]) == second)
        ii.append(a[fit])
        jj.append(b[fit])
    i, j = np.concatenate(ii), np.concatenate(jj)
    if len(i):
        # Mostly all sets of a leaf met in the same leaves before: look at distinct lists only.
        lists: dict[frozenset, int] = {}
        kind = np.array([lists.setdefault(frozenset(x for x in m if x < node), len(lists)) for m in met])
        sets_of = list(lists)
        pair, inverse = np.unique(kind[i] * len(sets_of) + kind[j], return_inverse=True)
        apart = np.array([sets_of[p // len(sets_of)].isdisjoint(sets_of[p % len(sets_of)]) for p in pair])
        i, j = i[apart[inverse]], j[apart[inverse]]
    if len(i):
        both = common_counts(sets, i, j)
        real = np.array([len(s) for s in sets])
        linked = both >= SIMILARITY * (real[i] + real[j] - both) - 1e-9
        i, j = i[linked], j[linked]
    m = len(cls)
    links = np.bincount(i, minlength=m) + np.bincount(j, minlength=m)
    docs = np.bincount(i, weights=size[j], minlength=m) + np.bincount(j, weights=size[i], minlength=m)
    root = cls[_components(m, i, j)] if len(i) else cls
    some = links > 0
    return pa.table({"cls": pa.array(cls[some]), "links": pa.array(links[some].astype(np.int64)), "doc_links": pa.array(docs[some].astype(np.int64)), "root": pa.array(root[some])})


def connected(edges: DataFrame) -> DataFrame:
    """(cls, label) from edges (cls, root): the least member of each component, by min-label rounds with pointer jumping."""
    both = persist_table(edges.select(F.col("cls").alias("a"), F.col("root").alias("b")).union(edges.select("root", "cls")).distinct(), "cc-edges")
    labels = persist_table(both.groupBy(F.col("a").alias("cls")).agg(F.min(F.least("a", "b")).alias("label")), "cc-0")
    last = labels
    while True:
        near = both.join(labels.select(F.col("cls").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        seen = labels.join(near.withColumnRenamed("a", "cls"), "cls").select("cls", "label", F.least("label", "other").alias("low"))
        jump = labels.select(F.col("cls").alias("low"), F.col("label").alias("far"))
        new = persist_table(seen.join(jump, "low").select("cls", F.col("label").alias("was"), F.least("low", "far").alias("label")), "cc")
        moved = new.where("was <> label").limit(1).count()
        drop_tables(last)
        labels, last = new.select("cls", "label"), new
        if not moved:
            drop_tables(both)
            return labels


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least doc_id of the same words), class_size, n_links (documents at 0.8 or more,
    copies included), n_class_links (other classes), group_id (least doc_id of the component).

    Also what names rows and groups where doc_ids repeat: doc (null as the largest long) and tag
    (hash of the text) of the row, group_key, and group_tag (the tag of the group's least document)."""
    spark = df.sparkSession
    sigs, classes = classes_of(persist_table(signatures(df, doc_id, text), "join-signatures"))
    leaves = leaves_of(classes, recall)
    release_shuffles(spark)
    fields = "node long, block int, cls long, n long, size long, blocks int, own int, sig binary"
    columns = ["node", "block", "cls", "n", "size", "blocks", "own", "sig"]
    # Tasks by rows: the work of a leaf grows faster than its bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), leaves.count() // 16_384 + 1)
    met = leaves.join(classes.select("cls", "n", "size", "sig"), "cls").select(*columns)
    may = persist_table(met.repartition(tasks, "node", "block").groupBy("node", "block").applyInArrow(_candidates, fields), "join-candidates")
    drop_tables(leaves)
    release_shuffles(spark)
    mine = may.groupBy("cls").agg(F.collect_set("node").alias("leaves"))

    def sets(stream):
        for b in stream:
            out = [(k, (v >> np.uint64(32)).astype("<u4")) for k, v in _per_document(b.column(0).to_pylist(), b.column(1), lambda h, _: shingles(h))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([np.unique(v).tobytes() for _, v in out], pa.binary())], names=["cls", "shingles"])

    # One text of each class that has candidates: found by its doc_id and tag, checked by its digest.
    wanted = mine.join(classes.select("cls", "sure", "first.doc", "first.tag"), "cls").select("cls", "sure", "doc", "tag")
    texts = df.select(*_row_key(doc_id, text), F.col(text).alias("text")).join(wanted, ["doc", "tag"])

    def checked(stream):
        for b in stream:
            fit = [_digest((t.as_py() or "").encode("utf-8", "surrogatepass"))[1] == c.as_py() for c, t in zip(b.column(2), b.column(1))]
            yield b.filter(pa.array(fit, pa.bool_()))

    texts = texts.select("cls", "text", "sure").mapInArrow(lambda s: sets(checked(s)), "cls long, shingles binary").dropDuplicates(["cls"])
    # Sets go to leaves by (cls) joins; both sides are tables, so that large keys can be split.
    full = mine.join(texts, "cls")
    ready = may.join(full, "cls").select(*columns, "leaves", "shingles")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), may.count() // 8_192 + 1)
    found = persist_table(ready.repartition(tasks, "node", "block").groupBy("node", "block").applyInArrow(_verify, "cls long, links long, doc_links long, root long"), "join-links")
    drop_tables(may)
    release_shuffles(spark)
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"), F.sum("doc_links").alias("doc_links"))
    labels = connected(found.where("cls <> root").select("cls", "root"))
    facts = classes.select("cls", "size", "first").join(counts, "cls", "left").join(labels, "cls", "left").withColumn("group_key", F.coalesce("label", "cls"))
    facts = persist_table(facts, "join-facts")
    drop_tables(classes, found)
    groups = facts.groupBy("group_key").agg(F.min("first").alias("group_first"))
    done = persist_table(facts.join(groups, "group_key"), "join-classes-done")
    drop_tables(facts)
    slim = persist_table(sigs.select("doc", "tag", "cls"), "join-rows")
    drop_tables(sigs)
    release_shuffles(spark)

    def shown(c: str):
        return F.when(F.col(c) != 2**63 - 1, F.col(c))

    return slim.join(done, "cls").select(
        shown("doc").alias("doc_id"), shown("first.doc").alias("class_id"), F.col("size").alias("class_size"),
        (F.col("size") - 1 + F.coalesce("doc_links", F.lit(0))).alias("n_links"), F.coalesce("links", F.lit(0)).alias("n_class_links"), shown("group_first.doc").alias("group_id"),
        "doc", "tag", "group_key", F.col("group_first.tag").alias("group_tag"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id", "class_size", "n_links", "n_class_links", "group_id")
