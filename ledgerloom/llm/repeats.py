"""Removal of windows that also start in an earlier document: the distributed side.

1. Documents are gathered into batches of about ``BATCH`` bytes and written once, so that every
   later pass sees the same batches.
2. Each batch sends the distinct anchors of its runs to buckets by hash; a bucket tells which
   anchors occur in other batches too, and which are *hot* (more than ``HOT`` different segments, which
   an anchor in very many batches has as well). Beyond ``GROUP`` batches, groups of batches are merged first,
   so that an anchor that all batches have comes to its bucket once for each group.
3. Each batch sends one copy of each distinct segment with such an anchor, for its least
   doc_id, to buckets by the anchor's hash. A bucket finds for every window the least
   document that holds it and answers with a bit for each window. Hot anchors stay out (so a
   bucket gets at most ``HOT`` segments of one): their windows are rows of a table, and the least
   document of each distinct window is a plain aggregate, combined before the shuffle.
4. Each batch applies the answers: in it, a copy of a segment (or hot window) under a larger
   doc_id than the one sent is removed whole.

Equal windows have equal anchors, so nothing is missed; what is exchanged is a few bytes for
each run of unique text, and one segment for each batch and variant of repeated text. Nothing is
dropped or capped. Hashes only choose buckets and propose: that two segments are the same is
confirmed by their symbols, and windows are matched by content in their bucket, so results are exact.

Null doc_ids count as larger than all others; rows that share a doc_id don't remove each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import drop_tables, persist_table, release_shuffles
from .windows import BYTE_HASH, Runs, exact_ids, find_runs, word_hashes, words_of

BATCH, LENGTH = 1_000_000, 50
#: Anchors with more segments than this (over all batches) go window by window: so many take a few hundred megabytes of a task to construct.
HOT = 100_000
#: Batches whose anchors are merged before they meet those of other batches.
GROUP = 4_096
K = {"bytes": 20, "words": 12}
#: Counts of variants travel as one byte, a step of a scale that ends above any batch's count. A count is never told too
#: small, so that a bucket gets at most HOT segments of an anchor; it is told at most 7 % too large.
STEPS = np.unique(np.ceil(1.066 ** np.arange(300)).astype(np.int64))[:256]


def batches_of(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows: batch, size, docs (order keys), lens, body (concatenated UTF-8), carry (the columns but the text)."""
    keep = [f for f in df.schema.fields if f.name != text]
    carry = StructType(keep)

    def run(stream):
        rows: list[pa.RecordBatch] = []
        size = 0

        def flush():
            tab = pa.Table.from_batches(rows)
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in tab.column("__text")]
            docs = tab.column("__key").to_numpy().astype("<i8")
            lens = np.array([len(t) for t in texts], "<i8")
            cols = [tab.column(f.name).combine_chunks() for f in keep]
            st = pa.StructArray.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names=[f.name for f in keep])
            lst = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), st)
            return pa.RecordBatch.from_arrays([pa.array([int(lens.sum())], pa.int64()), pa.array([docs.tobytes()], pa.binary()), pa.array([lens.tobytes()], pa.binary()), pa.array([b"".join(texts)], pa.binary()), lst], names=["size", "docs", "lens", "body", "carry"])

        for batch in stream:
            sizes = batch.column("__size").to_numpy()
            lo = 0
            for i, n in enumerate(sizes):
                if size and size + n > BATCH:
                    rows.append(batch.slice(lo, i - lo))
                    yield flush()
                    rows, size, lo = [], 0, i
                size += int(n)
            rows.append(batch.slice(lo))
        if size or any(r.num_rows for r in rows):
            yield flush()

    slim = df.select(
        *[F.col(f.name) for f in keep], F.col(text).alias("__text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("__key"),
        (F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1).alias("__size"),
    )
    schema = StructType([StructField("size", LongType()), StructField("docs", BinaryType()), StructField("lens", BinaryType()), StructField("body", BinaryType()), StructField("carry", ArrayType(carry))])
    return persist_table(slim.mapInArrow(run, schema).withColumn("batch", F.monotonically_increasing_id()), "repeat-batches", bucket_by="batch")


def trimmed(every: int = 8):
    """A function to call after each batch: now and then it gives freed memory back to the system."""
    import ctypes

    trim, done = getattr(ctypes.CDLL(None), "malloc_trim", None), [0]

    def after(last: bool = False) -> None:
        done[0] += 1
        if trim is not None and (last or done[0] % every == 0):
            trim(0)

    return after


def rows_of(stream):
    """One row at a time as a dict."""
    after = trimmed()
    for rb in stream:
        for i in range(rb.num_rows):
            yield rb.slice(i, 1).to_pylist()[0]
            after()
    after(True)


class Batch:
    """One batch as arrays, with the runs of its windows."""

    def __init__(self, unit: str, docs: bytes, lens: bytes, body: bytes, codes: list[dict] | None = None):
        """``codes``: the answers for the anchors, where they are known by now."""
        hot = any(max(p["answer"], default=0) > 1 for p in codes or [])
        self.docs, self.lens = np.frombuffer(docs, "<i8"), np.frombuffer(lens, "<i8")
        self.raw = np.frombuffer(body, np.uint8)
        of_byte = np.repeat(np.arange(len(self.docs), dtype=np.int32), self.lens)
        if unit == "bytes":
            self.sym, self.doc_of, self.exact = BYTE_HASH[self.raw], of_byte, self.raw
        else:
            self.begin, self.end, self.doc_of = words_of(self.raw, of_byte)
            self.sym = word_hashes(self.raw, self.begin, self.end)
            self.exact = exact_ids(self.raw, self.begin, self.end) if codes is not None else None
        self.runs, self.window_hash = find_runs(self.sym, self.doc_of, LENGTH, K[unit], hot)
        self.run_doc = self.docs[self.doc_of[self.runs.start]]
        order = np.lexsort((self.runs.segment, self.runs.key))
        key = self.runs.key[order]
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        self.keys = key[new]  # distinct anchors, ascending
        self.key_of = np.empty(len(key), np.int64)
        self.key_of[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        if len(first):
            seg = self.runs.segment[order]
            fresh = new | np.append(True, seg[1:] != seg[:-1])
            self.variants = np.add.reduceat(fresh.astype(np.int64), first)
            d = self.run_doc[order]
            self.shared = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        else:
            self.variants, self.shared = np.zeros(0, np.int64), np.zeros(0, bool)

    def wanted(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs to send whole, and hot runs. ``codes``: for each distinct anchor, bit 0: also in other batches, bit 1: hot."""
        wanted = ((codes & 1) | self.shared)[self.key_of].astype(bool)
        hot = wanted & ((codes & 2) > 0)[self.key_of]
        return np.flatnonzero(wanted & ~hot), np.flatnonzero(hot)

    def distinct(self, first: np.ndarray, second: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(one stretch of each content, under the least document; for every stretch the number of its content). Hashes propose."""
        order = np.lexsort((doc, second, first))
        x, y = first[order], second[order]
        new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])) if len(order) else np.zeros(0, bool)
        # Stretches of one hash with other symbols than the first stand for themselves.
        new |= ~same_content(self.exact, start[order], size[order], new)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return order[new], number

    def segments(self, codes: np.ndarray):
        """(runs to send, their documents, the representative of each content, each run's content)."""
        at, _ = self.wanted(codes)
        runs, doc = Runs(self.runs.key[at], self.runs.segment[at], self.runs.start[at], self.runs.windows[at], self.runs.place[at]), self.run_doc[at]
        return runs, doc, *self.distinct(runs.key, runs.segment, runs.start, runs.windows + LENGTH - 1, doc)

    def hot_windows(self, codes: np.ndarray):
        """(windows of hot anchors, their documents, the representative of each content, each window's content)."""
        _, at = self.wanted(codes)
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, none, none, none
        n = self.runs.windows[at]
        src = np.repeat(at, n)
        start = self.runs.start[src] + np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
        doc, h = self.run_doc[src], self.window_hash[start]
        return start, doc, *self.distinct(h, h, start, np.full(len(start), LENGTH), doc)

    def contents(self, unit: str, start: np.ndarray) -> pa.Array:
        """Windows as binaries; words are joined by one space."""
        if unit == "bytes":
            raw, a, b = self.raw, start, start + LENGTH
        else:
            size = self.end - self.begin + 1
            edge = np.cumsum(size) - size
            at = np.repeat(self.begin - edge, size) + np.arange(int(size.sum()))
            raw = np.append(self.raw, 32).astype(np.uint8)[at]
            raw[edge + size - 1] = 32
            a, b = edge[start], (edge + size)[start + LENGTH - 1] - 1
        n = b - a
        offsets = np.append(0, np.cumsum(n))
        at = np.repeat(a - offsets[:-1], n) + np.arange(offsets[-1])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[at])]).cast(pa.binary())


def same_content(symbols: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which stretches hold the same symbols as the first of their group (``first``: group starts, in order)."""
    out = np.ones(len(start), bool)
    rest = np.flatnonzero(~first)
    if not len(rest):
        return out
    head = np.flatnonzero(first)[np.cumsum(first)[rest] - 1]
    out[rest] = size[rest] == size[head]
    for lo in range(0, len(rest), 20_000):
        a, b = rest[lo : lo + 20_000], head[lo : lo + 20_000]
        n = np.minimum(size[a], size[b])
        edge = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(edge, n)
        differ = symbols[np.repeat(start[a], n) + step] != symbols[np.repeat(start[b], n) + step]
        out[a] &= np.add.reduceat(differ.astype(np.int64), edge) == 0
    return out


def slices(keys: np.ndarray, buckets: int):
    """(bucket, from, to) over ascending keys."""
    own = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(own))):
        yield int(own[a]), int(a), int(b)


def gathered(parts: list[dict] | None, total: int, dtype) -> np.ndarray:
    """Answers of all buckets, in the order of the keys that were sent."""
    out = [np.frombuffer(p["answer"], dtype) for p in sorted(parts or [], key=lambda p: p["bucket"])]
    got = np.concatenate(out) if out else np.zeros(0, dtype)
    if len(got) != total:
        raise ValueError(f"{len(got)} answers for {total} questions")
    return got


def low_bytes(keys: np.ndarray) -> bytes:
    """Six bytes of each key; the bucket stands for the rest."""
    return keys.astype("<u8").view("u1").reshape(-1, 8)[:, :6].tobytes()


def from_low_bytes(blobs: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(blobs).reshape(-1, 6)
    out = np.zeros((len(flat), 8), "u1")
    out[:, :6] = flat
    return out.view("<u8").ravel()


def pack_segments(b: Batch, unit: str, runs: Runs, doc: np.ndarray, rep: np.ndarray) -> bytes:
    """Segments as they stand in the text: count, keys, documents, windows, anchors' places, sizes in bytes, bodies."""
    n, a = runs.windows[rep], runs.start[rep]
    last = a + n + LENGTH - 2
    lo, hi = (a, last + 1) if unit == "bytes" else (b.begin[a], b.end[last])
    size = hi - lo
    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return b"".join([np.array([len(rep)], "<i8").tobytes(), low_bytes(runs.key[rep]), doc[rep].astype("<i8").tobytes(), n.astype("u1").tobytes(), runs.place[rep].astype("u1").tobytes(), size.astype("<i4").tobytes(), b.raw[at].tobytes()])


def unpack_segments(blob: bytes):
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    at = np.cumsum([8, 6 * n, 8 * n, n, n, 4 * n]).tolist()
    return (
        np.frombuffer(blob, "u1", 6 * n, at[0]), np.frombuffer(blob, "<i8", n, at[1]), np.frombuffer(blob, "u1", n, at[2]), np.frombuffer(blob, "u1", n, at[3]),
        np.frombuffer(blob, "<i4", n, at[4]), np.frombuffer(blob, "u1", -1, at[5]),
    )


@dataclass
class Segments:
    """The segments of one bucket; ``body``: their bytes end to end."""

    key: np.ndarray
    doc: np.ndarray
    windows: np.ndarray
    place: np.ndarray
    size: np.ndarray
    body: np.ndarray


#: Segments of one bucket -> least document of each window, concatenated
Resolver = Callable[[Segments], np.ndarray]


RESULTS = ["n", "n_removed", "spans", "kept"]


def remove_repeats(df: DataFrame, unit: str, resolve: Resolver, doc_id: str = "doc_id", text: str = "text", whole_characters: bool = False) -> DataFrame:
    """The columns of ``df`` but the text, and n, n_removed (in units), spans (start, end in units), kept (binary).

    Words are kept joined by single spaces, bytes as they are; with ``whole_characters``, ``kept`` also
    goes without the characters that lost some of their bytes. Columns of ``df`` under the names of
    the results are replaced by those (the doc_id column may not be one of them). A document and its
    arrays are held whole by one task: some 100 bytes of memory for each byte of the longest text.
    """
    spark = df.sparkSession
    df = df.select(*[c for c in df.columns if c in (doc_id, text) or c not in RESULTS])
    whole = batches_of(df, doc_id, text)
    size = whole.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # Buckets in proportion to the text, so that what meets in one stays about as small as a batch.
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (2 * BATCH)))
    cols = ["batch", "docs", "lens", "body"]

    def ask(stream):
        for row in rows_of(stream):
            b = Batch(unit, row["docs"], row["lens"], row["body"])
            out = []
            for bucket, lo, hi in slices(b.keys, buckets):
                out.append((bucket, row["batch"], low_bytes(b.keys[lo:hi]) + np.searchsorted(STEPS, b.variants[lo:hi]).astype("u1").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "batch", "question"])

    def parts_of(tab: pa.Table):
        """Anchors of a bucket's rows, in how many batches and variants each row saw them, and how many a row has."""
        blobs = tab.column("question").to_pylist()
        n = [len(x) // 7 for x in blobs]
        keys = from_low_bytes([np.frombuffer(x, "u1", 6 * k) for x, k in zip(blobs, n)])
        seen = STEPS[np.concatenate([np.frombuffer(x, "u1", k, 6 * k) for x, k in zip(blobs, n)])]
        return keys, np.ones(len(keys), np.int64), seen, n

    def judged(keys: np.ndarray, batches: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors with the batches and variants they were seen in."""
        distinct, inverse = np.unique(keys, return_inverse=True)
        return distinct, np.bincount(inverse, weights=batches).astype(np.int64), np.bincount(inverse, weights=seen).astype(np.int64)

    def answered(tab: pa.Table, keys: np.ndarray, n: list[int], distinct: np.ndarray, batches: np.ndarray, seen: np.ndarray) -> pa.Table:
        code = ((batches > 1) | ((seen > HOT) << 1))[np.searchsorted(distinct, keys)].astype("u1")
        ends = np.cumsum(n)
        own = [code[e - k : e] for e, k in zip(ends, n)]
        return pa.table({"bucket": tab.column("bucket"), "batch": tab.column("batch"), "answer": pa.array([x.tobytes() for x in own], pa.binary()), "hot": pa.array([int((x > 1).any()) for x in own], pa.int32())})

    def count(tab: pa.Table) -> pa.Table:
        keys, batches, seen, n = parts_of(tab)
        return answered(tab, keys, n, *judged(keys, batches, seen))

    def merge(tab: pa.Table) -> pa.Table:
        keys, batches, seen, _ = parts_of(tab)
        out = judged(keys, batches, seen)
        return pa.table({"bucket": tab.column("bucket")[:1], "grp": tab.column("grp")[:1], **{c: pa.array([x.astype("<u8").tobytes()], pa.binary()) for c, x in zip(("keys", "batches", "seen"), out)}})

    def settle(tab: pa.Table) -> pa.Table:
        own = [[np.frombuffer(x, "<u8") for x in tab.column(c).to_pylist()] for c in ("keys", "batches", "seen")]
        distinct, batches, seen = judged(*[np.concatenate(x) for x in own])
        at = [np.searchsorted(distinct, k) for k in own[0]]
        return pa.table({"bucket": tab.column("bucket"), "grp": tab.column("grp"), "keys": tab.column("keys"), **{c: pa.array([x[i].astype("<u8").tobytes() for i in at], pa.binary()) for c, x in (("batches", batches), ("seen", seen))}})

    def spread(tab: pa.Table, known: pa.Table) -> pa.Table:
        keys, _, _, n = parts_of(tab)
        return answered(tab, keys, n, *[np.frombuffer(known.column(c)[0].as_py(), "<u8").astype(t) for c, t in (("keys", np.uint64), ("batches", np.int64), ("seen", np.int64))])

    reply = "bucket int, batch long, answer binary"
    first_reply, merged = "bucket int, batch long, answer binary, hot int", "bucket int, grp int, keys binary, batches binary, seen binary"
    questions = whole.select(*cols).mapInArrow(ask, "bucket int, batch long, question binary")
    groups = -(-whole.count() // GROUP)
    if groups <= 1:
        answers = persist_table(questions.groupBy("bucket").applyInArrow(count, first_reply), "repeat-anchors")
    else:
        asked = persist_table(questions.withColumn("grp", F.pmod(F.xxhash64("batch"), F.lit(groups)).cast("int")), "repeat-questions")
        settled = asked.groupBy("bucket", "grp").applyInArrow(merge, merged).groupBy("bucket").applyInArrow(settle, merged)
        answers = persist_table(asked.groupBy("bucket", "grp").cogroup(settled.groupBy("bucket", "grp")).applyInArrow(spread, first_reply), "repeat-anchors")
        drop_tables(asked)
    release_shuffles(spark)
    grouped = F.collect_list(F.struct("bucket", "answer"))  # of one batch: as many as buckets
    codes = answers.groupBy("batch").agg(grouped.alias("codes"), F.max("hot").alias("hot"))

    def send(stream):
        for row in rows_of(stream):
            b = Batch(unit, row["docs"], row["lens"], row["body"], row["codes"] or [])
            runs, doc, rep, _ = b.segments(gathered(row["codes"], len(b.keys), "u1"))
            out = [(bucket, row["batch"], pack_segments(b, unit, runs, doc, rep[lo:hi])) for bucket, lo, hi in slices(runs.key[rep], buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "batch", "question"])

    def send_hot(stream):
        for row in rows_of(stream):
            b = Batch(unit, row["docs"], row["lens"], row["body"], row["codes"] or [])
            start, doc, rep, _ = b.hot_windows(gathered(row["codes"], len(b.keys), "u1"))
            for lo in range(0, len(rep), 100_000):
                own = rep[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row["batch"], np.int64)), pa.array(np.arange(lo, lo + len(own), dtype=np.int32)), b.contents(unit, start[own]), pa.array(doc[own])], names=["batch", "number", "window", "doc"])

    def judge(tab: pa.Table) -> pa.Table:
        parts = [unpack_segments(x) for x in tab.column("question").to_pylist()]
        key = from_low_bytes([p[0] for p in parts])
        doc, win, place, size, body = (np.concatenate(c) for c in list(zip(*parts))[1:])
        win = win.astype(np.int64)
        least = resolve(Segments(key, doc, win, place.astype(np.int64), size.astype(np.int64), body))
        gone = least < np.repeat(doc, win)
        first = np.cumsum(win) - win
        place = np.arange(len(gone)) - np.repeat(first, win)
        masks = np.bitwise_or.reduceat(gone.astype("<u8") << place.astype("<u8"), first)
        ends = np.cumsum([len(p[1]) for p in parts])
        answers = [masks[e - len(p[1]) : e].tobytes() for e, p in zip(ends, parts)]
        return pa.table({"bucket": tab.column("bucket"), "batch": tab.column("batch"), "answer": pa.array(answers, pa.binary())})

    gone = None
    if answers.where("hot > 0").limit(1).count():
        rows = whole.select(*cols).join(codes.where("hot > 0"), "batch").select(*cols, "codes").mapInArrow(send_hot, "batch long, number int, window binary, doc long")
        rows = persist_table(rows, "repeat-hot")
        low = rows.groupBy("window").agg(F.min("doc").alias("low"))
        gone = persist_table(rows.join(low, "window").where("low < doc").groupBy("batch").agg(F.collect_list("number").alias("gone")), "repeat-hot-gone")  # of one batch
        drop_tables(rows)
        release_shuffles(spark)
    segments = whole.select(*cols).join(codes, "batch", "left").select(*cols, "codes").mapInArrow(send, "bucket int, batch long, question binary")
    verdicts = persist_table(segments.groupBy("bucket").applyInArrow(judge, reply), "repeat-windows")
    release_shuffles(spark)
    masks = verdicts.groupBy("batch").agg(grouped.alias("masks"))
    carry = df.select(*[c for c in df.columns if c != text]).schema
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    out_schema = StructType([*carry.fields, StructField("n", LongType()), StructField("n_removed", LongType()), StructField("spans", ArrayType(span)), StructField("kept", BinaryType())])

    def apply(stream):
        for rb in stream:
            for i in range(rb.num_rows):
                one = rb.slice(i, 1)
                row = one.select(["docs", "lens", "body", "codes", "masks", "gone"]).to_pylist()[0]
                b = Batch(unit, row["docs"], row["lens"], row["body"], row["codes"] or [])
                off = covered(b, gathered(row["codes"], len(b.keys), "u1"), row["masks"], row["gone"])
                yield results(b, unit, off, one.column("carry").flatten(), carry.names, whole_characters)

    joined = whole.join(codes.drop("hot"), "batch", "left").join(masks, "batch", "left")
    joined = joined.join(gone, "batch", "left") if gone is not None else joined.withColumn("gone", F.lit(None).cast("array<int>"))
    return joined.select("docs", "lens", "body", "carry", "codes", "masks", "gone").mapInArrow(apply, out_schema)


def covered(b: Batch, codes: np.ndarray, masks: list[dict] | None, gone: list[int] | None) -> np.ndarray:
    """Which symbols of the batch lie in a removed window."""
    runs, doc, rep, number = b.segments(codes)
    mask = gathered(masks, len(rep), "<u8")
    everything = np.uint64(2**64 - 1)
    # A copy of a segment under a larger doc_id than the one that was sent goes whole.
    own = np.where(doc > doc[rep][number], everything, mask[number]) if len(number) else np.zeros(0, np.uint64)
    n = runs.windows
    src = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
    hit = ((own[src] >> place.astype(np.uint64)) & np.uint64(1)).astype(bool)
    start = (runs.start[src] + place)[hit]
    hot, doc, rep, number = b.hot_windows(codes)
    if len(hot):
        off = np.zeros(len(rep), bool)
        off[gone or []] = True
        start = np.append(start, hot[off[number] | (doc > doc[rep][number])])
    change = np.bincount(start, minlength=len(b.sym) + 1) - np.bincount(start + LENGTH, minlength=len(b.sym) + 1)
    return np.cumsum(change[:-1]) > 0


def by_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Bytes whose character lost a byte; texts are valid UTF-8, so characters don't cross documents."""
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    if not len(first) or not gone.any():
        return gone
    return np.repeat(np.maximum.reduceat(gone, first), np.diff(np.append(first, len(raw))))


def results(b: Batch, unit: str, gone: np.ndarray, carry: pa.StructArray, names: list[str], whole_characters: bool = False) -> pa.RecordBatch:
    per_doc = np.bincount(b.doc_of, minlength=len(b.docs)) if len(b.doc_of) else np.zeros(len(b.docs), np.int64)
    ends = np.cumsum(per_doc)
    removed, spans, kept = [], [], []
    edge = np.concatenate([[0], ends])
    dirty = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(edge[:-1], len(gone))) * (per_doc > 0) if len(b.docs) else []
    stop = np.cumsum(b.lens)
    cut = by_characters(b.raw, gone) if whole_characters and unit == "bytes" else gone
    for i, (hi, n) in enumerate(zip(ends, per_doc)):
        lo = hi - n
        own = gone[lo:hi]
        if dirty[i]:
            step = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))])
        else:
            spans.append([])
        removed.append(int(dirty[i]))
        if unit == "bytes":
            kept.append(b.raw[lo:hi][~cut[lo:hi]].tobytes() if dirty[i] else b.raw[lo:hi].tobytes())
        else:
            words = b.raw[stop[i] - b.lens[i] : stop[i]].tobytes().split()
            kept.append(b" ".join([w for w, g in zip(words, own.tolist()) if not g] if dirty[i] else words))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    cols = [carry.field(n) for n in names] if len(names) else []
    return pa.RecordBatch.from_arrays([*cols, pa.array(per_doc.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=[*names, "n", "n_removed", "spans", "kept"])
