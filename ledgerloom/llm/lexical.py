r"""Ranked lexical search: sort-based accumulation of term impacts.

Terms are the maximal matches of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` in the whole text, A-Z
lower-cased. A document's score for an item is the sum, over the item's distinct terms, of
w * ((10^9 tf) div (1000 tf + 20 m)), with w and m as in ``weights`` and ``length_factor``; all 64-bit.

1. Items are read in blocks of at most ``BLOCK_ITEMS`` items and about ``BLOCK_TERMS`` (item, term)
   pairs, one block at a time, so what a task holds of them is bounded however many there are.
2. One pass over the texts writes postings: for each document that has any of the block's terms, its number of terms and
   (term, count) of those that the block asks for, as two packed arrays. Counts over all documents
   (N, L) and each term's document frequency are aggregates of that pass.
3. Scoring goes over ranges of documents: a task concatenates the (item, document, impact) arrays of its
   documents in chunks of about ``CHUNK`` entries, sorts packed (item, document) keys by a radix sort
   of 16-bit digits, sums runs with ``reduceat``, and selects each item's best. No impact is
   shuffled: a document's postings are one row.
4. The ranges' best lists (``k`` rows an item each) meet in two rounds of at most ``FAN`` lists.

Defined results: null and empty texts have no terms and are no part of N; null or termless items give no rows;
every row of the documents is a document, so repeated doc_ids rank apart, in any order among equal
scores; null doc_ids come after all others; every row of the items is an item, so repeated item_ids
have a ranking each. Empty tables give no rows. Only the named columns are used. A text is held whole by one task, some ten bytes
of memory for each of its bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_tables, persist_table, table

K = 50
BLOCK_ITEMS, BLOCK_TERMS = 8_192, 500_000
CHUNK = 2_000_000
FAN = 256
LAST = 2**63 - 1

_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """All terms in order: every other ASCII character becomes a space, A-Z become small."""
    return text.encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []


def blocks_of(items: DataFrame, item_id: str, text: str, block_items: int, block_terms: int) -> Iterator[list[tuple[object, set[bytes]]]]:
    """Lists of (item_id, distinct terms), read from the cluster partition by partition."""
    block: list[tuple[object, set[bytes]]] = []
    held = 0
    for row in items.select(item_id, text).toLocalIterator():
        own = set(terms_of(row[1]))
        if not own:
            continue
        if block and (len(block) == block_items or held + len(own) > block_terms):
            yield block
            block, held = [], 0
        block.append((row[0], own))
        held += len(own)
    if block:
        yield block


class Lists:
    """Item numbers by term of one block; term numbers ascend in the order of the terms."""

    def __init__(self, block: list[tuple[object, set[bytes]]]):
        by_term: dict[bytes, list[int]] = {}
        for i, (_, own) in enumerate(block):
            for t in own:
                by_term.setdefault(t, []).append(i)
        self.number = {t: n for n, t in enumerate(sorted(by_term))}
        lists = [by_term[t] for t in self.number]
        self.size = np.array([len(x) for x in lists], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.items = np.array([i for x in lists for i in x], np.uint64)


def postings(docs: DataFrame, doc_id: str, text: str, lists) -> DataFrame:
    """doc, n (terms), term (packed 32-bit numbers), tf (packed 32-bit counts); rows without a term are left out."""

    def run(stream):
        number = lists.value.number
        for batch in stream:
            ids, out = batch.column(0), []
            for i, text in enumerate(batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    found = [(number[w], c) for w, c in Counter(words).items() if w in number]
                    pair = np.array(found, "<i4").reshape(-1, 2)
                    out.append((ids[i].as_py(), len(words), pair[:, 0].tobytes(), pair[:, 1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["doc", "n", "term", "tf"])

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text)).mapInArrow(run, "doc long, n long, term binary, tf binary")


def frequencies(found: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and each term's document frequency: a row a task and term, added up by term."""

    def run(stream):
        df = np.zeros(terms, np.int64)
        docs = total = 0
        for batch in stream:
            docs += batch.num_rows
            total += int(batch.column("n").to_numpy().sum())
            df += np.bincount(np.frombuffer(b"".join(batch.column("term").to_pylist()), "<i4"), minlength=terms)
        at = np.flatnonzero(df)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.append([-2, -1], at)), pa.array(np.append([docs, total], df[at]))], names=["term", "n"])

    rows = found.select("n", "term").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most two more than the block has terms
    got = {r.term: r.n for r in rows}
    df = np.zeros(terms, np.int64)
    for t, n in got.items():
        if t >= 0:
            df[t] = n
    return got.get(-2, 0), got.get(-1, 0), df


def weights(docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)


def length_factor(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    # 50 n N stays within 64 bits up to 10^17 / N terms of one document.
    return 100 - 50 + (50 * n.astype(np.int64) * docs) // total


def radix_order(key: np.ndarray, bits: int) -> np.ndarray:
    """A stable ascending order of ``key`` below 2^bits, by 16-bit digits (numpy sorts those by counting)."""
    order = np.argsort((key & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        digit = ((key[order] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


def accumulated(item: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int, items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score) with the impacts of equal (item, doc) summed."""
    width = max(1, int(docs - 1).bit_length())
    key = (item << np.uint64(width)) | doc.astype(np.uint64)
    order = radix_order(key, width + max(1, int(items - 1).bit_length()))
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    score = np.add.reduceat(impact[order], first)
    return (key[first] >> np.uint64(width)).astype(np.int64), (key[first] & np.uint64((1 << width) - 1)).astype(np.int64), score


class Best:
    """The ``k`` best of each item so far: highest score, then least doc."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.zeros(items, np.int64)
        self.item = self.doc = self.score = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)

    def add(self, item: np.ndarray, doc: np.ndarray, known: np.ndarray, score: np.ndarray) -> None:
        # A score equal to an item's floor may still win by its doc.
        may = (score > 0) & (score >= self.floor[item])
        item, doc, known, score = (np.concatenate([a, b[may]]) for a, b in ((self.item, item), (self.doc, doc), (self.known, known), (self.score, score)))
        order = np.lexsort((doc, ~known, -score, item))
        item = item[order]
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        keep = order[rank < self.k]
        self.item, self.doc, self.known, self.score = item[rank < self.k], doc[keep], known[keep], score[keep]
        full = rank == self.k - 1
        self.floor[item[full]] = score[order][full]


def stretches(stream, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of packed terms each, one document at least."""
    for batch in stream:
        held = np.cumsum(np.asarray(pc.binary_length(batch.column("term")), np.int64))
        edges = [0, *(np.flatnonzero(np.diff(held // size)) + 1), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


def ranges_best(found: DataFrame, lists, weight: np.ndarray, docs: int, total: int, items: int, k: int, chunk: int) -> DataFrame:
    """item, doc, score: the best of each task's documents."""

    def run(stream):
        asked, best = lists.value, Best(items, k)
        for batch in stretches(stream, 4 * chunk):
            blobs = batch.column("term").to_pylist()
            sizes = np.array([len(b) // 4 for b in blobs], np.int64)
            term = np.frombuffer(b"".join(blobs), "<i4")
            tf = np.frombuffer(b"".join(batch.column("tf").to_pylist()), "<i4").astype(np.int64)
            ids = batch.column("doc")
            known = ~np.asarray(ids.is_null())
            doc_id = ids.fill_null(0).to_numpy()
            m = length_factor(batch.column("n").to_numpy(), docs, total)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            part = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
            own = weight[term] * part
            entries = asked.size[term]
            # Cuts at documents, so that a document's impacts meet.
            per_doc = np.bincount(doc, weights=entries, minlength=len(sizes)).astype(np.int64)
            cut = np.flatnonzero(np.diff(np.cumsum(per_doc) // chunk, prepend=0)) + 1
            edge = np.append(0, np.cumsum(sizes))
            for a, b in zip(np.append(0, cut), np.append(cut, len(sizes))):
                lo, hi = edge[a], edge[b]
                if a == b or lo == hi:
                    continue
                n = entries[lo:hi]
                src = np.repeat(np.arange(lo, hi), n)
                at = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n) + asked.first[term[src]]
                item, local, score = accumulated(asked.items[at], doc[src] - a, own[src], b - a, items)
                best.add(item, doc_id[a + local], known[a + local], score)
        if len(best.item):
            yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.doc, mask=~best.known), pa.array(best.score)], names=["item", "doc", "score"])

    return found.mapInArrow(run, "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", k: int = K, block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS, chunk: int = CHUNK) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` documents with the highest scores above 0."""
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType
    out = []
    for block in blocks_of(items, item_id, text, block_items, block_terms):
        lists = spark.sparkContext.broadcast(Lists(block))  # bounded by the block
        terms = len(lists.value.size)
        found = persist_table(postings(docs, doc_id, text, lists), "lexical-postings")
        n, total, df = frequencies(found, terms)
        top = ranges_best(found, lists, weights(n, df), n, total, len(block), k, chunk)
        order = [F.desc("score"), F.asc_nulls_last("doc")]
        top = top.withColumn("part", F.floor(F.spark_partition_id() / FAN)).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item long, {item_id} {kind.simpleString()}")
        out.append(persist_table(top.join(F.broadcast(names), "item").select(item_id, "rank", F.col("doc").alias(doc_id), "score"), "lexical-best"))
        lists.destroy()
        drop_tables(found)
    if not out:
        return spark.createDataFrame([], f"{item_id} {kind.simpleString()}, rank int, {doc_id} long, score long")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""WITH d AS (SELECT r, doc_id, len(ts) AS n, ts FROM (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS ts FROM documents) WHERE len(ts) > 0),
 c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
 b AS (SELECT q, item_id, unnest(list_distinct(ts)) AS term FROM (SELECT row_number() OVER () AS q, item_id, {TERMS} AS ts FROM benchmark)),
 p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY 1, 2),
 w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term),
 s AS (SELECT q, item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))))::BIGINT AS score FROM b JOIN w USING (term) JOIN p USING (term) JOIN d USING (r), c GROUP BY 1, 2, 3)
 SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0 QUALIFY rank <= {K}"""
