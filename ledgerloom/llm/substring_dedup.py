"""Substring dedup on words by seed and extend.

Seeds are winnowed anchors: 12-word grams, one at least in every 50-word window. Documents meet
on them in buckets. There all occurrences of an anchor are extended at once, first over the
anchor's own words, then to the right and to the left, a word at a time: a step parts those
that differ in the next word, and one without a partner left stops. After r steps to the right and l
to the left, occurrences in the same class on both sides share a repeat of l + 12 + r words;
those of 50 words tell every window the least document that holds it, and the union of such
windows is the union of the maximal repeats of at least 50 words. Extending classes instead
of pairs costs one sort for each word of context, while pairs of occurrences would grow with their
square. Words are compared as bytes, not by hashes; they are removed where an earlier document
has them. The windows of hot anchors meet as whole texts in an aggregate. See ``repeats`` for the exchange and for the defined results.

A text without words, or null, has 0 words and the empty text as what is kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .repeats import K, LENGTH, Segments, remove_repeats
from .windows import exact_ids, words_of

SEED, CONTEXT = K["words"], LENGTH - K["words"]


def partners(cls: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each (class, symbol) pair, whether another member shares it)."""
    _, new, size = np.unique(cls * (int(symbol.max()) + 1 if len(symbol) else 1) + symbol, return_inverse=True, return_counts=True)
    return new, size[new] > 1


def extend(seg: Segments) -> np.ndarray:
    """Least document of every window of every segment."""
    n = len(seg.key)
    begin, end, owner = words_of(seg.body, np.repeat(np.arange(n), seg.size))
    word = exact_ids(seg.body, begin, end)
    count = seg.windows + LENGTH - 1
    first = np.cumsum(count) - count
    if len(word) != int(count.sum()):
        raise ValueError("segments and their words differ in number")

    def grow(cls: np.ndarray, offsets: range) -> list[np.ndarray]:
        """Classes after each further word; -1 for occurrences without a partner or a word there."""
        levels, at = [cls], np.flatnonzero(cls >= 0)
        for offset in offsets:
            place = seg.place[at] + offset
            at = at[(place >= 0) & (place < count[at])]
            new, shared = partners(levels[-1][at], word[first[at] + seg.place[at] + offset])
            level = np.full(n, -1, np.int64)
            at, new = at[shared], new[shared]
            level[at] = new
            levels.append(level)
        return levels

    new, shared = partners(np.zeros(n, np.int64), np.unique(seg.key, return_inverse=True)[1])
    seeds = grow(np.where(shared, new, -1), range(SEED))[-1]
    right = grow(seeds, range(SEED, SEED + CONTEXT))
    left = grow(seeds, range(-1, -CONTEXT - 1, -1))
    least = np.repeat(seg.doc, seg.windows)
    base = np.cumsum(seg.windows) - seg.windows
    for before in range(CONTEXT + 1):
        a, b = left[before], right[CONTEXT - before]
        start = seg.place - before
        at = np.flatnonzero((a >= 0) & (b >= 0) & (start >= 0) & (start < seg.windows))
        if len(at):
            _, group = np.unique(a[at] * n + b[at], return_inverse=True)
            low = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, group, seg.doc[at])
            least[base[at] + start[at]] = low[group]
    return least


def substring_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns of ``df`` but the text; n (words), n_removed, spans (in words) and kept (UTF-8), see ``remove_repeats``."""
    return remove_repeats(df, "words", extend, doc_id, text)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
