"""Seeds of repeated windows: the numpy side of the two repeat-removing operators.

A *window* is ``length`` consecutive symbols of one document. Its *anchor* is the k-gram with
the least hash in it (the leftmost of equals), so equal windows have equal anchors at equal
places: winnowing. Consecutive windows with one anchor occurrence form a *run*; a run's text is
its *segment*. Runs are what is exchanged: by the hash of their anchor, equal windows meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MASK_BITS = 18
CHUNK = 1 << 17  # windows handled at a time
_BASE, _SEED = np.uint64(0x9E3779B97F4A7C15), 20_240_229
_POW: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    if not _POW or len(_POW[0]) < n:
        most = max(n, CHUNK + 256)
        base = np.full(most, _BASE)
        inv = np.full(most, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        base[0] = inv[0] = 1
        _POW[:] = [np.multiply.accumulate(base), np.multiply.accumulate(inv)]
    return _POW[0][:n], _POW[1][:n]


BYTE_HASH = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sums(sym: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(sym * powers(len(sym))[0], dtype=np.uint64)])


def grams(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams from prefix sums, mixed so far that their high bits order them."""
    n = len(prefix) - k
    out = prefix[k:] - prefix[:n]
    out *= powers(n)[1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def grams_at(prefix: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the k-grams at some places."""
    return mix((prefix[at + k] - prefix[at]) * powers(len(prefix))[1][at])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


@dataclass
class Runs:
    key: np.ndarray  # hash of the anchor (or of the single window)
    segment: np.ndarray  # hash of the whole segment and of the anchor's place in it
    start: np.ndarray  # first window, as an index of the concatenated symbols
    windows: np.ndarray  # number of windows
    place: np.ndarray  # where the anchor stands in the segment


def find_runs(sym: np.ndarray, doc_of: np.ndarray, length: int, k: int, want_windows: bool = False) -> tuple[Runs, np.ndarray | None]:
    """All runs of the concatenated documents; with ``want_windows`` also the hash of the window at each index."""
    n = len(sym) - length + 1
    found: list[tuple] = []
    hashes = np.zeros(max(n, 0), np.uint64) if want_windows else None
    low = np.uint64((1 << _MASK_BITS) - 1)
    for s in range(0, max(n, 0), CHUNK):
        e = min(s + CHUNK, n)
        prefix = sums(sym[s : e + length - 1])
        gram = grams(prefix, k)
        if hashes is not None:
            hashes[s:e] = grams_at(prefix, length, np.arange(e - s))
        ranked = gram & ~low
        ranked |= np.arange(len(gram), dtype=np.uint64)
        least = sliding_min(ranked, length - k + 1)
        at = (least & low).astype(np.int64)
        fine = doc_of[s:e] == doc_of[s + length - 1 : e + length - 1]
        new = fine.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~fine[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            continue
        count = np.bincount(np.cumsum(new)[fine] - 1, minlength=len(first))
        a, b = first, first + count - 1
        seg = mix(grams_at(prefix, length, a) * np.uint64(3) + mix(grams_at(prefix, length, b) + (at[a] - a).astype(np.uint64) * np.uint64(257) + count.astype(np.uint64)))
        # Least hashes crowd near zero; mixed again, they spread over all buckets.
        found.append((mix(gram[at[a]]), seg, a + s, count, at[a] - a))
    cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    return Runs(*cols), hashes


def exact_ids(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each stretch of bytes: the same for equal stretches and only for those."""
    import pyarrow as pa

    n = end - start
    offsets = np.append(0, np.cumsum(n))
    at = np.repeat(start - offsets[:-1], n) + np.arange(offsets[-1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[at]))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(raw: np.ndarray, doc_of_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each stretch without white space; documents never join."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, doc_of_byte.dtype)
    solid = ~SPACE[raw]
    seam = doc_of_byte[1:] != doc_of_byte[:-1]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | seam
    stop[:-1] &= ~solid[1:] | seam
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return a, b, doc_of_byte[a]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words; each word's hash depends on its bytes only."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):  # stretches of about CHUNK bytes
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + CHUNK, side="right")))
        base = int(start[lo])
        prefix = sums(BYTE_HASH[raw[base : int(end[hi - 1])]])
        a, b = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = mix(mix((prefix[b] - prefix[a]) * powers(len(prefix))[1][a]) + (b - a).astype(np.uint64))
        lo = hi
    return out
