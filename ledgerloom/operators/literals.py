"""Which literals stand in which texts, at any number of either: anchors first, contents after.

Both sides are in exposure form (or as they are). Literals fall in length classes: class g holds
lengths g to 2g - 1, g a power of two. For a class, k consecutive characters are a *gram*, and a gram is an *anchor* of a text
if its hash is the least in some stretch of g - k + 1 grams. A literal of length g or more covers
such stretches, and where it stands in a text the same stretches stand there, so every anchor of the
literal's own stretches is one of the text too. One anchor a literal is enough: the one that the fewest literals have.

1. Literals: distinct contents, their anchors, the rarest of each. Stays on the cluster.
2. A bit filter of the chosen hashes, 2^``FILTER_POWER`` long at any number of literals, goes to the tasks. It only
   lets through: an anchor that it stops belongs to no literal.
3. One pass over the texts: anchors of all classes, those that pass the filter with the characters around them.
4. A join on (class, hash); the characters are compared; distinct (literal, text) pairs are counted.

Each text is read once. A passage that many texts share costs a row for each of them and each literal in
it. Nothing is capped: short literals (a few characters) give an anchor almost everywhere, which is what finding them takes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import exposure_form
from ..sources.stored import stored

#: 8 MB; with as many literals as an eighth of it, one anchor in eight passes by chance.
FILTER_POWER = 26
#: Characters of text that are looked at together.
STRETCH = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def gram(g: int) -> int:
    """Characters of an anchor in class g."""
    return max(1, min(16, g // 2))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of polynomial terms up to each character, and what shifts them back; the same for all lengths of grams."""
    n = len(codes)
    return np.append(np.uint64(0), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), dtype=np.uint64)), powers(_INVERSE, n)


def gram_hashes(codes: np.ndarray, k: int, ready: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A hash of every k consecutive characters (of polynomials modulo 2^64, shifted back to a common start)."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    sums, back = ready or prefixes(codes)
    return mixed((sums[k:] - sums[: n - k + 1]) * back[: n - k + 1])


def window_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive entries: block by block, from the left and from the right."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, h.dtype)
    blocks = -(-len(h) // w)
    padded = np.full(blocks * w, np.iinfo(h.dtype).max, h.dtype)
    padded[: len(h)] = h
    rows = padded.reshape(blocks, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(codes: np.ndarray, g: int, ready: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of class g."""
    k = gram(g)
    h = gram_hashes(codes, k, ready)
    w = g - k + 1
    least = window_least(h, w)
    if not len(least):
        return np.zeros(0, np.int64), h[:0]
    # A gram is an anchor if it is the least of one of the windows that it is in: of those, the one whose least is greatest.
    highest = ~window_least(np.concatenate([np.full(w - 1, ~np.uint64(0)), ~least, np.full(w - 1, ~np.uint64(0))]), w)
    at = np.flatnonzero(h == highest[: len(h)])
    return at, h[at]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def exposed(docs: DataFrame, text: str, literals: DataFrame, item: str, literal: str, exact: bool = False) -> DataFrame:
    """(item, n_docs): documents that hold each literal whole; literals found nowhere, empty and null ones have no row.

    An item with several literals counts each of them.
    """
    found = matches(docs, text, literals, literal, exact)
    owners = literals.select(F.col(item).cast("long").alias(item), exposure_form(F.col(literal), exact).alias("needle")).where(F.length("needle") > 0)
    return found.groupBy("needle").agg(F.count(F.lit(1)).alias("n")).join(owners, "needle").groupBy(item).agg(F.sum("n").alias("n_docs"))


def matches(docs: DataFrame, text: str, literals: DataFrame, literal: str, exact: bool = False) -> DataFrame:
    """(needle, doc): distinct contents of literals and numbers of the rows of ``docs`` that hold them."""
    spark = docs.sparkSession
    needles = literals.select(exposure_form(F.col(literal), exact).alias("needle")).where(F.length("needle") > 0).distinct()

    def cut(batches):
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                g = 1 << (len(t).bit_length() - 1)
                at, h = anchors(codes_of(t), g)
                h, first = np.unique(h, return_index=True)
                out.append((pa.array([t] * len(h), pa.string()), pa.array(np.full(len(h), g, np.int32)), pa.array(h.view(np.int64)), pa.array(at[first].astype(np.int32))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out)], names=["needle", "g", "h", "place"])

    held = needles.mapInArrow(cut, "needle string, g int, h long, place int")
    shared = held.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"))
    rarest = held.join(shared, ["g", "h"]).groupBy("needle", "g").agg(F.min_by(F.struct("h", "place"), F.struct("n", "h")).alias("x"))
    chosen = stored(rarest.select("needle", "g", F.col("x.h").alias("h"), F.col("x.place").alias("place")), "literal-anchors")
    classes = sorted(r.g for r in chosen.select("g").distinct().collect())  # at most as many as a length has bits
    if not classes:
        return spark.createDataFrame([], "needle string, doc long")
    bits = spark.sparkContext.broadcast(bit_filter(chosen))

    def scan(batches):
        from pyspark import TaskContext

        passes, number = Passes(bits.value), TaskContext.get().partitionId() << 36
        for batch in batches:
            part: list[str] = []
            size = 0
            for t in batch.column(0).to_pylist():
                part.append(t or "")
                size += len(part[-1])
                if size >= STRETCH:
                    yield around(part, number, classes, passes)
                    number, part, size = number + len(part), [], 0
            if part:
                yield around(part, number, classes, passes)
                number += len(part)

    seen = docs.select(exposure_form(F.col(text), exact)).mapInArrow(scan, "doc long, g int, h long, before int, context string")
    met = seen.join(chosen, ["g", "h"]).where((F.col("before") >= F.col("place")) & (F.substr("context", F.col("before") - F.col("place") + 1, F.length("needle")) == F.col("needle")))
    return met.select("needle", "doc").distinct()


def _shifts(power: int, places: int) -> list[int]:
    """Where in a hash the bits of each place begin, from the top."""
    return [64 - power * (i + 1) for i in range(places)]


def bit_filter(chosen: DataFrame, power: int = FILTER_POWER, places: int = 1) -> np.ndarray:
    """2^power bits, ``places`` of them set for each chosen hash: words of 64 come to the driver, at most 2^power / 64 of them."""
    place = F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit((1 << power) - 1)) for s in _shifts(power, places)]))
    words = chosen.select(place.alias("place")).select(F.shiftright("place", 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got = words.toArrow()
    out = np.zeros((1 << power) // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


class Passes:
    """Does a hash pass the filter?"""

    def __init__(self, words: np.ndarray, power: int = FILTER_POWER, places: int = 1):
        self.words, self.mask, self.shifts = words, np.uint64((1 << power) - 1), [np.uint64(s) for s in _shifts(power, places)]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for shift in self.shifts:
            place = (h >> shift) & self.mask
            out &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
        return out


def around(texts: list[str], number: int, classes: list[int], passes: Passes) -> pa.RecordBatch:
    """Anchors of texts laid end to end that pass, each with what stands around it in its own text.

    Grams across two texts only add anchors, which the comparison drops.
    """
    whole = "".join(texts)
    codes = codes_of(whole)
    ready, sizes = prefixes(codes), np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    docs, gs, hs, before, context = [], [], [], [], []
    for g in classes:
        at, h = anchors(codes, g, ready)
        keep = passes(h)
        at, h = at[keep], h[keep]
        own = np.searchsorted(ends, at, side="right")
        lo = np.maximum(ends[own] - sizes[own], at - 2 * g) if len(at) else at
        hi = np.minimum(ends[own], at + 2 * g) if len(at) else at
        docs.append(own + number)
        gs.append(np.full(len(at), g, np.int32))
        hs.append(h.view(np.int64))
        before.append((at - lo).astype(np.int32))
        context += [whole[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
    arrays = [np.concatenate(x) for x in (docs, gs, hs, before)]
    return pa.RecordBatch.from_arrays([*(pa.array(a) for a in arrays), pa.array(context, pa.string())], names=["doc", "g", "h", "before", "context"])
