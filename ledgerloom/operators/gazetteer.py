"""Names of a table in texts: any number of names, longest first, on the cluster throughout.

1. Forms: a name's plain form, and the form without its company words where one name alone has it.
2. A bit filter of the forms' hashes, of one size at any number of forms, goes to the tasks.
3. One pass over the texts: runs of words as long as some form, and of those the ones that pass the filter. They are settled
   at once: longer forms first, each place taken once, so that a name inside a longer one does not count. A form that is left goes on
   once a text, however often it stands there; all runs together would be several times the texts.
4. A join on the run's own words, so that the filter and its hashes decide nothing: what is left in a text and is no form
   may have taken a form's place, so such a text is read once more and all its runs go on. Those that were passed over change nothing. Forms that make up over
   1/``HOT`` of all runs (fewer than ``HOT`` forms, whatever the tables hold) are joined from a broadcast, so that
   a name in every text is not one task's work.
5. Per text: its names; where all its runs went on, they are settled first.

Runs are rows throughout, never a text's list in one cell, and Python sees them in small batches: it holds one text,
or short ones of ``STRETCH`` characters, with its runs at a time, whatever the number of texts. The only parts that come to the driver are the filter (as large as the
number of forms asks for, 32 MB at most) and the distinct numbers of words that forms have.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import _plain, plain, short_name
from ..sources.stored import stored
from .literals import Passes, bit_filter, codes_of, mixed, prefixes

#: A form with a larger share of all runs than one in so many is hot.
HOT = 256
#: Characters that are looked at together, of one text or of short ones; a stretch goes on as far as its last run needs.
STRETCH = 100_000
#: Runs that go to Spark together.
BATCH = 20_000
#: Bits of the filter, as powers of two: 128 a form within these bounds; a form sets two of them for each of ``TIMES`` hashes.
LEAST_BITS, MOST_BITS = 20, 28
TIMES = 4


def name_forms(names: DataFrame, name: str) -> DataFrame:
    """(form, name): what a text has to hold for each name.

    Where several names have one full form, the least name stands for it; a short form counts if exactly
    one name has it and it is nobody's full form. Null names and those without a letter or digit have none.
    """
    held = names.select(F.col(name).alias("name")).where("name is not null").distinct().withColumn("form", plain("name"))
    full = held.where("form <> ''").groupBy("form").agg(F.min("name").alias("name"))
    short = held.select("name", short_name(F.col("name")).alias("form")).where("form <> ''")
    alone = short.groupBy("form").agg(F.min("name").alias("name"), F.max("name").alias("_last")).where("name = _last").drop("_last")
    return full.unionByName(alone.join(full, "form", "left_anti"))


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of characters from a start to an end, the same wherever it stands."""
    sums, back = prefixes(codes)
    return mixed((sums[ends] - sums[starts]) * back[starts])


def again(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th hash made from a hash, which is the 0th."""
    return mixed(h + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) if i else h


def passing(passes: Passes, h: np.ndarray) -> np.ndarray:
    """Do all of a run's hashes pass?"""
    at = np.arange(len(h))
    for i in range(TIMES):
        at = at[passes(again(h[at], i))]
    out = np.zeros(len(h), bool)
    out[at] = True
    return out


def word_places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a plain form (single spaces between them)."""
    gaps = np.flatnonzero(codes == 32)
    return np.concatenate([[0], gaps + 1]), np.append(gaps, len(codes))


def runs_in(texts: Iterable[str], widths: list[int], passes: Passes) -> Iterator[list[tuple[str, int, int]]]:
    """For each plain text its runs of words that may be forms: the words, first word, word after the last.

    Short texts are looked at together, up to ``STRETCH`` characters, since small arrays cost by their number.
    """
    part: list[str] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= STRETCH:
            yield from _runs_of(part, widths, passes)
            part, size = [], 0
    yield from _runs_of(part, widths, passes)


def _runs_of(texts: list[str], widths: list[int], passes: Passes) -> list[list[tuple[str, int, int]]]:
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    held = [k for k, t in enumerate(texts) if t]
    if not held or not widths:
        return out
    whole = " ".join(texts[k] for k in held)
    codes = codes_of(whole)
    starts, ends = word_places(codes)
    opens = np.cumsum([0, *(len(texts[k]) + 1 for k in held[:-1])])
    own, begun = np.searchsorted(opens, starts, side="right") - 1, np.searchsorted(starts, opens)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + STRETCH)))
        stop = min(len(starts), hi + widths[-1] - 1)
        base = starts[lo]
        part, s, e = codes[base : ends[stop - 1]], starts[lo:stop] - base, ends[lo:stop] - base
        sums, back = prefixes(part)
        for w in widths:
            n = min(hi - lo, len(s) - w + 1)
            if n <= 0:
                break
            h = mixed((sums[e[w - 1 : w - 1 + n]] - sums[s[:n]]) * back[s[:n]])
            i = np.flatnonzero(passing(passes, h)) + lo
            i = i[own[i] == own[i + w - 1]]
            for k, first, at, to in zip(own[i].tolist(), (i - begun[own[i]]).tolist(), starts[i].tolist(), ends[i + w - 1].tolist()):
                out[held[k]].append((whole[at:to], first, first + w))
        lo = hi
    return out


def chosen(runs: list[tuple]) -> Iterator[tuple]:
    """Those of a text's runs (form, first, after and more) that count: longer forms first (by characters, then by letters), each word of the text used once.

    Two places of one form that follow each other without a word between are one mention and a rest,
    which shorter forms may still use.
    """
    taken: set[int] = set()
    last: tuple[str, int] = ("", -1)
    for run in sorted(runs, key=lambda r: (-len(r[0]), r[0], r[1])):
        form, first, after = run[:3]
        if form == last[0] and first <= last[1]:
            continue
        words = range(first, after)
        if taken.isdisjoint(words):
            taken.update(words)
            last = (form, after)
            yield run


def settled(runs: list[tuple[str, int, int, str]]) -> set[str]:
    """Names of a text's chosen runs (form, first, after, name)."""
    return {r[3] for r in chosen(runs)}


def asserted_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in the order of their texts, of a text (side 0) and of what is ignored (side 1), to the sorted names of the former that the latter lacks.

    Runs of a text may be dealt over batches, so the last text of a batch stays open until another begins.
    """
    sides: tuple[list, list] = ([], [])
    row, rows, names = None, [], []

    def closed() -> None:
        rows.append(row)
        names.append(sorted(settled(sides[0]) - settled(sides[1])))
        sides[0].clear()
        sides[1].clear()

    for batch in batches:
        for r, side, first, after, form, name in zip(*(c.to_pylist() for c in batch.columns)):
            if r != row:
                if row is not None:
                    closed()
                row = r
            sides[side].append((form, first, after, name))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(names, pa.list_(pa.string()))], names=["_row", "_names"])
            rows, names = [], []
    if row is not None:
        closed()
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(names, pa.list_(pa.string()))], names=["_row", "_names"])


def named_in(df: DataFrame, text: str, names: DataFrame, name: str, ignore: str | None = None, out: str = "names") -> DataFrame:
    """Add the sorted names of a table that each text asserts, less those in ``ignore`` (the question).

    Null and empty texts, and an empty table of names, give an empty array; repeated rows stay, each with
    its own. A column called ``out`` is replaced; ``_row`` and ``_names`` are used inside. A text is read in
    stretches; all runs of one text are settled by one task.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c.lower() != out.lower()]
    forms = stored(name_forms(names, name), "gazetteer-forms")

    def hashed(batches):
        for batch in batches:
            values = batch.column(0).to_pylist()
            h = np.array([run_hashes(codes_of(t), np.array([0]), np.array([len(t)]))[0] for t in values], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([again(h, i) for i in range(TIMES)]).view(np.int64))], names=["h"])

    widths = sorted(r[0] for r in forms.select(F.size(F.split("form", " "))).distinct().collect())
    power = min(MOST_BITS, max(LEAST_BITS, (128 * forms.count()).bit_length()))
    bits = spark.sparkContext.broadcast(bit_filter(forms.select("form").mapInArrow(hashed, "h long"), power, 2))

    def scan(batches, whole=False):
        """Runs that pass: those that count among them, each form once a text, or all."""
        passes = Passes(bits.value, power, 2)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        out: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["_row", "side", "first", "after", "form"])
        for batch in batches:
            at = batch.column(0).to_pylist()
            for side in range(batch.num_columns - 1):
                plains = (_plain(text.as_py() or "") for text in batch.column(side + 1))
                for row, runs in zip(at, runs_in(plains, widths, passes)):
                    for form, first, after in runs if whole else {r[0]: r for r in chosen(runs)}.values():
                        out.append((row, side, first, after, form))
                        if len(out) >= BATCH:
                            yield made()
                            out = []
        if out:
            yield made()

    kind = "_row long, side int, first int, after int, form string"
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "gazetteer-rows")
    texts = rows.select("_row", *[F.col(c).cast("string") for c in (text, ignore) if c is not None])
    runs = stored(texts.mapInArrow(scan, kind).select("_row", "side", "form"), "gazetteer-runs")
    counts = _counted(runs, forms)
    strange = counts.where("name is null").select("form")
    if not strange.limit(1).count():
        met = _named(runs, counts)
    else:
        doubtful = stored(runs.join(strange, "form", "left_semi").select("_row").distinct(), "gazetteer-doubtful")
        whole = stored(texts.join(doubtful, "_row", "left_semi").mapInArrow(lambda b: scan(b, True), kind), "gazetteer-runs")
        placed = _named(whole, _counted(whole, forms)).select("_row", "side", "first", "after", "form", "name").repartition("_row").sortWithinPartitions("_row")
        late = placed.mapInArrow(asserted_names, "_row long, _names array<string>").select("_row", F.lit(0).alias("side"), F.explode("_names").alias("name"))
        met = _named(runs.join(doubtful, "_row", "left_anti"), counts).select("_row", "side", "name").unionByName(late)
    own = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("name")))
    found = met.select("_row", "side", "name").repartition("_row").groupBy("_row").agg(F.array_sort(F.array_except(own(0), own(1))).alias("_names"))
    return rows.select(*rest, "_row").join(found, "_row", "left").select(*rest, F.coalesce("_names", F.array().cast("array<string>")).alias(out))


def _counted(runs: DataFrame, forms: DataFrame) -> DataFrame:
    """(form, n, name): how many runs have each form; those that are none have no name."""
    return stored(runs.groupBy("form").agg(F.count(F.lit(1)).alias("n")).join(forms, "form", "left"), "gazetteer-counts")


def _named(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Runs that are forms, with ``name``."""
    spark = runs.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = counts.where("name is not null")
    hot = spark.createDataFrame(known.where(F.col("n") * HOT > total).select("form", "name").toArrow().to_pandas(), "form string, name string")
    frequent = runs.join(F.broadcast(hot), "form")
    return frequent.unionByName(runs.join(F.broadcast(hot.select("form")), "form", "left_anti").join(known.select("form", "name"), "form"))
