"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of its documents' tokens. A window of ``SEQUENCE`` tokens is filled
from all queues: each queue's deficit grows by its share of the window, it gives as many whole
tokens as its deficit covers, and what room remains goes to the largest deficits. Deficits are
carried from window to window. Windows are planned in chunks: the driver runs the same
round-robin over chunks (a bounded number) with deficits carried between them, and each chunk
is then cut into windows by one task, starting from its integral quotas. The last, partial
window is cut into sequences of powers of two, so nothing is padded.

Targets are the queues' own shares of all tokens unless ``weights`` names others; a queue that
runs dry leaves its share to the rest. Documents are cut freely; each token lies in one piece.

Any number of sources has a queue each. The driver holds one row a source and a plan of at most
``MAX_PLAN`` numbers (or one chunk's); a task cuts its chunk in blocks of at most so many numbers.
With more than ``SEQUENCE`` sources, a window cannot hold all, and deficits decide whose turn it is.

Defined results: a null text is empty and has only the end token; null sources are one queue;
an empty table gives no pieces; repeated rows are documents of their own (told apart by sequence
and offset). Only doc_id, text and source of the input are used, so other columns can't clash.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persist_table, running_start, subs_for, table

SEQUENCE, END_ID, MAX_PLAN, CACHE, BROADCAST = 2048, 1, 1 << 20, 500_000, 8 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: A character outside ASCII, the letters of Latin-1 and Latin Extended-A: texts without any are
#: lowered by the file's normaliser as by Python, and none of them composes.
PLAIN = re.compile("[^\\x00-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]").search

#: What a file has to say for its texts to be cut by ``PIECE`` (fixed values: the file's own words).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Kinds of the bytes of lowered plain texts: white space, letter (any byte outside ASCII), digit, sign.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[97:123] = KIND[128:] = 1
KIND[48:58] = 2


def piece_starts(raw: np.ndarray, kind: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Where the pieces of ``PATTERN`` start in lowered plain texts end to end, given the ``KIND`` of each byte.

    ``text_at``: first bytes of the texts that are not empty.
    """
    n = len(raw)
    before, here = kind[:-1], kind[1:]
    start = np.zeros(n + 1, bool)
    start[1:n] = (here != before) | (here == 2)
    start[text_at] = True
    # An apostrophe on its own and what of 's 't 're 've 'm 'll 'd follows it are one piece.
    q = np.flatnonzero(raw == 39)
    if len(q):
        edge = np.zeros(n + 3, bool)
        edge[text_at] = edge[n:] = True
        lone = (q == 0) | (kind[q - 1] != 3) | edge[q]
        padded = np.append(raw, [0, 0]).astype(np.uint8)
        one, two = padded[q + 1], padded[q + 2]
        short = ~edge[q + 1] & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = ~edge[q + 1] & ~edge[q + 2] & np.isin(one.astype(np.int64) * 256 + two, [ord(x) * 256 + ord(y) for x, y in ("re", "ve", "ll")])
        for own, size in ((q[lone & short], 2), (q[lone & pair], 3)):
            start[own + 1] = False
            stop = own[own + size < n] + size
            start[stop[kind[stop] == 1]] = True
    start[:n] &= kind != 0
    return np.flatnonzero(start[:n])


class ChunkedTokenizer:
    """A ``tokenizers`` file whose results for repeated parts of texts are remembered.

    Plain texts of a file with ``NORMALIZER`` and ``PATTERN`` are lowered and cut into the pattern's
    pieces here, many texts at once, and equal pieces are gathered by Arrow; the library then only merges, on
    many new pieces at a time, and the end-of-word mark of each piece's last token parts them again. Other
    texts are cut at white space, which the pattern does not cross, and their stretches go through the whole
    library.

    Memory: two generations of at most ``CACHE`` strings and one batch's own."""

    #: Characters on which libraries differ in what white space is: such texts go whole to the library.
    UNSURE = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]").search
    BATCH = 2000
    #: Plain texts are taken together up to about so many characters.
    CHARACTERS = 4_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        spec = json.loads(self.tok.to_str())
        self.special = [x["content"] for x in spec["added_tokens"]]
        #: Pieces, and stretches of texts that are not plain (marked by a space before, so that they don't meet).
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        split, *byte_level = spec["pre_tokenizer"].get("pretokenizers", [{}]) if spec["pre_tokenizer"] else [{}]
        mark = spec["model"].get("end_of_word_suffix")
        self.merger = None
        if mark and spec["normalizer"] == NORMALIZER and split.get("pattern") == {"Regex": PATTERN} and [x["type"] for x in byte_level] == ["ByteLevel"]:
            self.merger = Tokenizer.from_str(self.tok.to_str())
            self.merger.normalizer = normalizers.Sequence([])
            self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            # The byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 and on; spaces part the pieces.
            own = {*range(33, 127), *range(161, 173), *range(174, 256)}
            self.letters = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own) if b != 32}
            vocabulary = self.tok.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.last[[i for word, i in vocabulary.items() if word.endswith(mark)]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, pieces: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(pieces), self.BATCH):
            part = pieces[at : at + self.BATCH]
            line = " ".join(part)
            if not (line.isascii() and line.isprintable()):
                line = line.encode().decode("latin-1").translate(self.letters)
            ids = np.asarray(self.merger.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(part):
                raise ValueError("pieces and end-of-word tokens differ in number")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _learn(self, missing: set[str]) -> None:
        """Add ``missing`` pieces and stretches to what is known."""
        known = self.known
        again = missing & self.before.keys() if self.before else set()
        known.update((c, self.before[c]) for c in again)
        rest = missing - again
        stretches = [c for c in rest if c[0] == " "]
        known.update(zip(stretches, self._library([c[1:] for c in stretches])))
        pieces = [c for c in rest if c[0] != " "]
        # ASCII apart from the rest: it needs no translation.
        for own in ([c for c in pieces if c.isascii()], [c for c in pieces if not c.isascii()]):
            known.update(zip(own, self._merge(own)))

    def _found(self, parts: list[str]) -> list[bytes]:
        """Ids of pieces or stretches."""
        get = self.known.get
        ids = list(map(get, parts))
        if None in ids:
            holes = [i for i, x in enumerate(ids) if x is None]
            self._learn({parts[i] for i in holes})
            for i in holes:
                ids[i] = self.known[parts[i]]
        return ids

    def _plain(self, texts: list[str]) -> list[bytes]:
        raws = [t.lower().encode() for t in texts]
        size = np.array([len(r) for r in raws], np.int64)
        raw = np.frombuffer(b"".join(raws), np.uint8)
        if not len(raw):
            return [b""] * len(texts)
        kind, stop = KIND[raw], np.cumsum(size)
        at = piece_starts(raw, kind, (stop - size)[size > 0])
        if not len(at):
            return [b""] * len(texts)
        # Equal pieces are gathered from the bytes without white space.
        solid = kind != 0
        edge = np.cumsum(solid, dtype=np.int32)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(edge[at] - 1, edge[-1]).astype(np.int32)), pa.py_buffer(raw[solid])).dictionary_encode()
        own = self._found(pieces.dictionary.to_pylist())
        n = np.fromiter(map(len, own), np.int32, len(own)) // 4
        first, index = np.cumsum(n, dtype=np.int32) - n, pieces.indices.to_numpy()
        count = n[index]
        ends = np.cumsum(count, dtype=np.int32)
        place = np.repeat(first[index] - (ends - count), count)
        place += np.arange(ends[-1], dtype=np.int32)
        ids = np.frombuffer(b"".join(own), "<u4")[place].tobytes()
        upto = (4 * np.append(0, ends).astype(np.int64)[np.searchsorted(at, np.append(0, stop))]).tolist()
        return [ids[a:b] for a, b in zip(upto, upto[1:])]

    def _cut(self, text: str):
        """Parts of a long plain text, cut before white space (which no piece crosses)."""
        at = 0
        while at < len(text):
            end = at + self.CHARACTERS
            if end < len(text):
                gaps = [x for x in (text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end)) if x > 0]
                later = [x for x in (text.find(" ", end), text.find("\n", end)) if x > 0]
                end = max(gaps) if gaps else min(later, default=len(text))
            yield text[at:end]
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE:
            self.before, self.known = self.known, {}
        out: list[bytes] = [b""] * len(texts)
        plain, size = [], 0
        for i, text in enumerate(texts):
            if self.UNSURE(text) or any(x in text for x in self.special):
                out[i] = self._library([text])[0]
            elif self.merger is None or PLAIN(text) is not None:
                out[i] = b"".join(self._found([" " + c for c in text.split()]))
            elif len(text) > self.CHARACTERS:
                out[i] = b"".join([self._plain([part])[0] for part in self._cut(text)])
            else:
                plain.append(i)
                size += len(text)
            if plain and (size > self.CHARACTERS or i == len(texts) - 1):
                for j, ids in zip(plain, self._plain([texts[j] for j in plain])):
                    out[j] = ids
                plain, size = [], 0
        return out


_LOADED: dict[str, ChunkedTokenizer] = {}


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, n, ids (binary of 32-bit ids, the end token included)."""

    def run(batches):
        if path not in _LOADED:
            _LOADED[path] = ChunkedTokenizer(path)
        tok, end = _LOADED[path], np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids = [x + end for x in tok.encode([t or "" for t in part.column(2).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(run, "doc_id long, source string, n long, ids binary")


def take(room: int, deficit: np.ndarray, weights: np.ndarray, left: np.ndarray) -> np.ndarray:
    """One round: whole tokens of each queue for ``room``; updates ``deficit`` and ``left`` in place."""
    room = min(room, int(left.sum()))
    live = np.where(left > 0, weights, 0.0)
    if live.sum() <= 0:
        live = (left > 0).astype(float)
    deficit += room * live / live.sum()
    got = np.minimum(np.floor(np.maximum(deficit, 0.0) + 1e-9).astype(np.int64), left)
    over = int(got.sum()) - room
    for q in np.argsort(deficit - got, kind="stable"):
        if over <= 0:
            break
        cut = min(over, int(got[q]))
        got[q] -= cut
        over -= cut
    rest = -over if over < 0 else 0
    while rest > 0:
        order = np.argsort(-(deficit - got), kind="stable")
        more = order[got[order] < left[order]][:rest]
        got[more] += 1
        rest -= len(more)
        open_ = np.flatnonzero(got < left)
        if rest > len(open_) and len(open_):
            more = np.minimum(left[open_] - got[open_], rest // len(open_))
            got[open_] += more
            rest -= int(more.sum())
    deficit -= got
    left -= got
    deficit[left == 0] = 0.0
    return got


def plan_chunks(totals: np.ndarray, weights: np.ndarray, windows_in_chunk: int, sequence: int) -> np.ndarray:
    """(chunks + 1) x queues: tokens of each queue before each chunk."""
    left, deficit = totals.copy(), np.zeros(len(totals))
    bounds = [np.zeros(len(totals), dtype=np.int64)]
    while left.sum() > 0:
        bounds.append(bounds[-1] + take(windows_in_chunk * sequence, deficit, weights, left))
    return np.array(bounds)


def cut_windows(quota: np.ndarray, sequence: int):
    """Windows of one chunk, in blocks of at most ``MAX_PLAN`` numbers: (windows x queues) tokens."""
    left, deficit, weights = quota.copy(), np.zeros(len(quota)), quota.astype(float)
    block, rows = max(1, MAX_PLAN // len(quota)), []
    while (n := int(left.sum())) > 0:
        rows.append(take(sequence if n >= sequence else 1 << (n.bit_length() - 1), deficit, weights, left))
        if len(rows) == block:
            yield np.array(rows)
            rows = []
    if rows:
        yield np.array(rows)


def cut_pieces(quota: np.ndarray, docs: dict[int, tuple[np.ndarray, ...]], first_sequence: int, sequence: int):
    """docs: queue -> (start in the chunk's stream of the queue, row index, first token, tokens), sorted.

    Yields (row index, first token in the document, length, sequence, offset) arrays.
    """
    given = np.zeros(len(quota), dtype=np.int64)
    for rows in cut_windows(quota, sequence):
        before = np.cumsum(rows, axis=1) - rows
        for q in np.flatnonzero(rows.any(axis=0)).tolist():
            start, row, first, n = docs[q]
            ends = given[q] + np.cumsum(rows[:, q])
            inside = start[np.searchsorted(start, given[q]) : np.searchsorted(start, ends[-1])]
            marks = np.unique(np.concatenate([inside, ends[:-1], given[q : q + 1]]))
            marks = marks[marks < ends[-1]]
            length = np.diff(np.append(marks, ends[-1]))
            doc = np.searchsorted(start, marks, side="right") - 1
            window = np.searchsorted(ends, marks, side="right")
            yield row[doc], first[doc] + marks - start[doc], length, first_sequence + window, before[window, q] + marks - (ends[window] - rows[window, q])
        given += rows.sum(axis=0)
        first_sequence += len(rows)


def runs(queue: np.ndarray) -> list[tuple[int, slice]]:
    """Each queue and its stretch of a sorted array."""
    q, at = np.unique(queue, return_index=True)
    return [(x, slice(a, b)) for x, a, b in zip(q.tolist(), at.tolist(), [*at.tolist()[1:], len(queue)])]


def pack(docs: DataFrame, tokenizer: str | None = None, *, sequence: int = SEQUENCE, weights: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text, source)."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    rows = persist_table(tokenised(docs, tokenizer).withColumn("rid", F.monotonically_increasing_id()), "packing-ids")
    found = rows.groupBy("source").agg(F.sum("n").cast("long").alias("n")).toArrow().sort_by("source")  # nulls last
    names, totals = found.column("source"), found.column("n").to_numpy().astype(np.int64)
    if not totals.sum():
        return spark.createDataFrame([], PIECES)
    queues = spark.createDataFrame(pa.table({"source": names, "queue": pa.array(range(len(names)), pa.int64())})).withColumnRenamed("source", "_s")
    queues = F.broadcast(queues) if found.nbytes < BROADCAST else queues
    numbered = rows.select("rid", "n", "source").join(queues, F.col("source").eqNullSafe(F.col("_s")))
    slim = numbered.select("rid", "n", "queue", F.pmod(F.xxhash64("rid"), F.lit(subs_for(rows.count()))).alias("sub"))
    share = totals.astype(float) if weights is None else np.array([weights.get(s, 0.0) for s in names.to_pylist()])
    windows = -(-int(totals.sum()) // sequence)
    in_chunk = max(64, -(-windows // min(65_536, MAX_PLAN // max(1, len(names)))))
    bounds = plan_chunks(totals, share, in_chunk, sequence)

    def split(batches):
        """Each document's stretches by chunk."""
        for batch in batches:
            rid, n, queue, start = (batch.column(i).to_numpy() for i in range(4))
            out, order = [], np.argsort(queue, kind="stable")
            for q, own in runs(queue[order]):
                at = order[own]
                edge = bounds[:, q]
                lo = np.searchsorted(edge, start[at], side="right") - 1
                hi = np.searchsorted(edge, start[at] + n[at], side="left") - 1
                k = hi - lo + 1
                row = np.repeat(at, k)
                chunk = np.repeat(lo, k) + np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                a = np.maximum(start[row], edge[chunk])
                b = np.minimum(start[row] + n[row], edge[chunk + 1])
                full = b > a
                out.append([x[full] for x in (chunk, np.full(len(row), q), a - edge[chunk], rid[row], a - start[row], b - a)])
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["chunk", "queue", "at", "rid", "first", "n"])

    def cut(tab: pa.Table) -> pa.Table:
        c = int(tab.column("chunk")[0].as_py())
        queue, at, rid, first, n = (tab.column(x).to_numpy() for x in ("queue", "at", "rid", "first", "n"))
        order = np.lexsort((at, queue))
        queue, at, rid, first, n = (x[order] for x in (queue, at, rid, first, n))
        found = {q: tuple(x[own] for x in (at, rid, first, n)) for q, own in runs(queue)}
        parts = list(cut_pieces(bounds[c + 1] - bounds[c], found, c * in_chunk, sequence))
        cols = [np.concatenate(x).astype(np.int64) for x in zip(*parts)]
        return pa.table(dict(zip(["rid", "start", "length", "sequence_id", "offset"], map(pa.array, cols))))

    # Where each document starts in its queue.
    placed = running_start(slim, "queue", "sub", [F.col("rid")], F.col("n"), "at").select("rid", "n", "queue", "at")
    stretches = placed.mapInArrow(split, "chunk long, queue long, at long, rid long, first long, n long")
    pieces = stretches.groupBy("chunk").applyInArrow(cut, "rid long, start long, length long, sequence_id long, offset long")
    # One document's pieces: bounded by its length.
    mine = pieces.groupBy("rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    def sums(batches):
        for batch in batches:
            doc, n, ids, own = (batch.column(i) for i in range(4))
            of = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(own).to_numpy(zero_copy_only=False))
            start, length, sequence_id, offset = own.flatten().flatten()
            raw = [memoryview(x) for x in ids.to_pylist()]
            a = 4 * start.to_numpy()
            crc = [zlib.crc32(raw[i][x:y]) for i, x, y in zip(of.tolist(), a.tolist(), (a + 4 * length.to_numpy()).tolist())]
            cols = [doc.take(pa.array(of)), start, length, pa.array(crc, pa.int64()), n.take(pa.array(of)), sequence_id, offset]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return rows.join(mine, "rid").select("doc_id", "n", "ids", "pieces").mapInArrow(sums, PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
