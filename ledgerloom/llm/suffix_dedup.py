"""Suffix-array dedup by column-wise construction over many short strings.

The strings of a bucket (segments of at most 80 bytes around one anchor, see ``repeats``) get, some
thousands at a time and all of an anchor together, a joint Burrows-Wheeler transform and array of common prefixes. They grow column by column: in
round j, the symbol that stands before the j-symbol suffix of each string is inserted. Its place
follows from the rank of that symbol in the transform so far, its common prefix with its
neighbours from the least common prefix between the places of equal symbols. Each round reads
the arrays of the round before and writes new ones, in sequence; above ``IN_MEMORY`` symbols they
are files in the scratch folder that Spark gives its tasks for spilling: only this task reads them, and they go with it.

Windows of 50 bytes are the suffixes of at least 50 bytes; neighbours with a common prefix of 50
or more hold the same window. See ``repeats`` for the defined results. A null text is empty.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .repeats import LENGTH, Segments, remove_repeats, same_content
from .windows import BYTE_HASH, mix, powers, sums

#: Strings constructed at a time: their arrays then stay in a processor's cache.
IN_MEMORY, STRINGS = 32_000_000, 2_000


class Columns:
    """Equal-length arrays, rewritten as a whole from one round to the next."""

    def __init__(self, total: int):
        self.folder = tempfile.TemporaryDirectory(prefix="columns-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) if total > IN_MEMORY else None
        self.turn = 0

    def new(self, name: str, n: int, dtype) -> np.ndarray:
        if self.folder is None:
            return np.empty(n, dtype)
        return np.memmap(f"{self.folder.name}/{name}{self.turn % 2}", dtype, "w+", shape=(n,))

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


def construct(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, common prefix with the row before, symbol before the suffix) of all
    suffixes in order, the empty ones first. ``data``: the strings end to end; at most 255 distinct symbols."""
    m = len(lens)
    stop = np.cumsum(lens)
    alphabet = np.unique(data)
    code = np.zeros(256, np.uint8)
    code[alphabet] = np.arange(1, len(alphabet) + 1)
    coded = code[data]

    def symbol(string: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What stands before the suffix of ``n`` symbols; 0 at the string's start."""
        more = n < lens[string]
        return np.where(more, coded[np.where(more, stop[string] - n - 1, 0)], 0).astype(np.uint8) if len(coded) else np.zeros(len(string), np.uint8)

    # A row's string and suffix length are one number.
    bits = np.int64(int(lens.max(initial=0)).bit_length())
    files = Columns(int(lens.sum()))
    try:
        tag = np.arange(m, dtype=np.int64) << bits
        common, before = np.zeros(m, np.int32), symbol(np.arange(m), np.zeros(m, np.int64))
        placed = np.arange(m)
        while True:
            placed = placed[before[placed] != 0]  # ascending rows of the last round whose strings go on
            if not len(placed):
                return (tag >> bits).astype(np.int32), (tag & ((np.int64(1) << bits) - 1)).astype(np.int32), np.array(common), np.array(before)
            order = np.argsort(before, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            ended = int(np.count_nonzero(before == 0))
            own, sym = rank[placed].astype(np.int64), before[placed]
            row = m + own - ended
            # Common prefixes with the neighbours: one more than the least between equal symbols.
            up, down = order[own - 1], order[np.minimum(own + 1, len(order) - 1)]
            has_up = (own > 0) & (before[up] == sym)
            has_down = (own + 1 < len(order)) & (before[down] == sym)
            padded = np.append(common, 0)
            with_up, with_down = np.zeros(len(placed), np.int32), np.zeros(len(placed), np.int32)
            for has, low, high, to in ((has_up, up + 1, placed + 1, with_up), (has_down, placed + 1, down + 1, with_down)):
                if has.any():
                    # From the last interval to the first, so that nothing lies between one's end and the next's start.
                    pairs = np.empty(2 * int(has.sum()), np.int64)
                    pairs[0::2], pairs[1::2] = low[has][::-1], high[has][::-1]
                    to[has] = 1 + np.minimum.reduceat(padded, pairs)[::2][::-1]
            files.turn += 1
            total = len(order) + len(placed)
            stay = np.ones(total, bool)
            stay[row] = False
            stay = np.flatnonzero(stay)
            longer = tag[placed] + 1
            fresh = (longer, with_up, symbol(longer >> bits, longer & ((np.int64(1) << bits) - 1)))
            grown = []
            for name, old, new in zip(("tag", "common", "before"), (tag, common, before), fresh):
                arr = files.new(name, total, old.dtype)
                arr[stay] = old
                arr[row] = new
                grown.append(arr)
            tag, common, before = grown
            common[(row + 1)[has_down]] = with_down[has_down]
            placed = np.sort(row)
    finally:
        files.close()


def together(items: np.ndarray, group: np.ndarray, most: int):
    """Stretches of ``items`` of about ``most``, whole groups each (equal windows have equal anchors, so they share a group)."""
    edge = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(items)) if len(items) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(items):
        hi = int(edge[max(np.searchsorted(edge, lo + most, side="right") - 1, np.searchsorted(edge, lo, side="right"))])
        yield items[lo:hi]
        lo = hi


def least_documents(seg: Segments) -> np.ndarray:
    """Least document of every window of every segment."""
    key, doc, win, body, size = seg.key, seg.doc, seg.windows, seg.body, seg.size
    at = np.cumsum(size) - size
    prefix = sums(BYTE_HASH[body])
    whole = mix(mix((prefix[at + size] - prefix[at]) * powers(len(prefix))[1][at]) + size.astype(np.uint64))
    del prefix
    order = np.lexsort((doc, whole, key))
    k, s = key[order], whole[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new = new_key | np.append(True, s[1:] != s[:-1])
    new |= ~same_content(body, at[order], size[order], new)
    variant = np.empty(len(order), np.int64)
    variant[order] = np.cumsum(new) - 1
    rep = order[new]  # the least document's segment of each variant (equal bytes)
    group = (np.cumsum(new_key) - 1)[new]
    several = np.bincount(group)[group] > 1
    vwin = win[rep]
    first = np.cumsum(vwin) - vwin
    least = np.repeat(doc[rep], vwin)
    picked = np.flatnonzero(several)
    for pick in together(picked, group[picked], STRINGS):
        n = size[rep[pick]]
        src = np.repeat(at[rep[pick]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        string, length, common, _ = construct(body[src], n)
        cls = np.cumsum(common < LENGTH)
        fit = length >= LENGTH
        string, length, cls = string[fit], length[fit], cls[fit]
        v = pick[string]
        where = first[v] + size[rep[v]] - length
        d = doc[rep[v]]
        edge = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
        low = np.minimum.reduceat(d, edge)
        least[where] = np.repeat(low, np.diff(np.append(edge, len(cls))))
    n = win
    return least[np.repeat(first[variant], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]


def suffix_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", whole_characters: bool = False) -> DataFrame:
    """Columns of ``df`` but the text; n (bytes), n_removed, spans (in bytes) and kept (bytes, see ``remove_repeats``)."""
    return remove_repeats(df, "bytes", least_documents, doc_id, text, whole_characters)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
