"""Chat and token operators: messages, masks, labels, packing of token arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import relisted

IGNORED = -100


def conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row a conversation: messages array<struct<role, content>> in turn order."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(turn, "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def well_formed(messages: Column) -> Column:
    """At least one assistant turn, no empty content."""
    return F.exists(messages, lambda m: m["role"] == "assistant") & F.forall(messages, lambda m: F.trim(m["content"]) != "")


def word_ids(text: Column) -> Column:
    """Stand-in tokenizer: one stable id for each white-space word (a real one is injected as a UDF)."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(50_000)).cast("int"))


def encode(messages: Column, ids=word_ids) -> tuple[Column, Column]:
    """input_ids and labels: only assistant tokens are supervised."""
    parts = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), ids(m["content"]).alias("ids")))
    inputs = F.flatten(F.transform(parts, lambda p: p["ids"]))
    labels = F.flatten(F.transform(parts, lambda p: F.when(p["role"] == "assistant", p["ids"]).otherwise(F.transform(p["ids"], lambda _: F.lit(IGNORED)))))
    return inputs, labels


def library_ids(path: str):
    """A tokenizer for ``encode``: ids by a ``tokenizers`` file, in Arrow batches (special tokens are not added).

    One text is a Python object at a time; its ids are kept in four bytes each.
    """
    from pyspark.sql.types import ArrayType, IntegerType

    held: dict = {}

    def one(text: str | None) -> list[int]:
        if "tok" not in held:
            from tokenizers import Tokenizer

            held["tok"] = Tokenizer.from_file(path)
        return held["tok"].encode(text or "", add_special_tokens=False).ids

    @F.arrow_udf(ArrayType(ArrayType(IntegerType())))
    def many(texts: pa.Array) -> pa.Array:
        own = texts.flatten()
        ids = [np.array(one(t.as_py()), np.int32) for t in own]
        ends = np.cumsum([0, *map(len, ids)])
        return relisted(texts, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))))

    return many


def encode_chat(messages: Column, ids_of_all, limit: int, roles: tuple[str, ...] = ("system", "user", "assistant")) -> Column:
    """struct<input_ids, attention_mask, labels>: only assistant turns are supervised.

    Turns other than ``roles`` in that order, empty contents, more than ``limit`` ids and no supervised
    id are errors, never trimmed. ``ids_of_all``: array of texts -> array of id arrays.
    """
    named = F.transform(messages, lambda m: m["role"])
    parts = ids_of_all(F.transform(messages, lambda m: m["content"]))
    pairs = F.zip_with(messages, parts, lambda m, p: F.struct(m["role"].alias("role"), p.alias("ids")))
    inputs = F.flatten(parts)
    labels = F.flatten(F.transform(pairs, lambda x: F.when(x["role"] == "assistant", x["ids"]).otherwise(F.transform(x["ids"], lambda _: F.lit(IGNORED)))))
    fault = (
        F.when(named != F.array(*map(F.lit, roles)), "wrong turns").when(F.exists(messages, lambda m: F.coalesce(F.trim(m["content"]), F.lit("")) == ""), "empty content")
        .when(F.size(inputs) > limit, "too long").when(supervised(labels) <= 0, "nothing supervised")
    )
    fine = F.struct(inputs.alias("input_ids"), F.transform(inputs, lambda _: F.lit(1)).alias("attention_mask"), labels.alias("labels"))
    return F.when(fault.isNull(), fine).otherwise(F.raise_error(fault))


def within_reserve(n: Column, reserve: int, context: int) -> Column:
    """A prompt's token count; one that leaves less than the reserve is an error, never trimmed."""
    return F.when(n + reserve <= context, n).otherwise(F.raise_error(F.concat(F.lit("prompt too long: "), n.cast("string"))))


def supervised(labels: Column) -> Column:
    """Shifted supervised tokens: the first position is never predicted."""
    return F.size(F.filter(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: x != IGNORED))


def fold_mask(ids: Column, mask: Column) -> Column:
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(F.lit(IGNORED)))


def truncate(ids: Column, limit: int, keep: str = "keep_start") -> Column:
    return F.slice(ids, 1, limit) if keep == "keep_start" else F.when(F.size(ids) > limit, F.slice(ids, F.size(ids) - limit + 1, limit)).otherwise(ids)


def drop_unsupervised(df: DataFrame, labels: str) -> DataFrame:
    """Rows with at least one supervised id."""
    return df.where(F.exists(labels, lambda x: x != IGNORED))


def truncation_audit(df: DataFrame, labels: str, limit: int, arm: str) -> DataFrame:
    """Per arm: rows, rows that truncation leaves without supervision, supervised ids before and after."""
    before, after = supervised(F.col(labels)), supervised(truncate(F.col(labels), limit))
    return df.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), F.count_if((before > 0) & (after <= 0)).alias("dropped"), F.sum(before).alias("before"), F.sum(after).alias("after"))


def label_audit(df: DataFrame, recipe: str, ids: str, labels: str) -> DataFrame:
    """Per recipe: rows, ids and supervised ids."""
    return df.groupBy(recipe).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(ids)).alias("ids"), F.sum(supervised(F.col(labels))).alias("supervised"))


def as_role_content(messages: Column, names: dict[str, str] | None = None) -> Column:
    """from/value turns as role/content, roles renamed by ``names`` where it has them."""
    def role(m):
        out = m["from"]
        for a, b in (names or {}).items():
            out = F.when(m["from"] == a, b).otherwise(out)
        return out

    return F.transform(messages, lambda m: F.struct(role(m).alias("role"), m["value"].alias("content")))


def is_conversational(schema, columns: tuple[str, ...] = ("messages", "prompt", "completion", "chosen", "rejected")) -> bool:
    """Does one of the columns hold an array of turns (a struct with role and content)?"""
    for f in schema.fields:
        if f.name in columns and f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct":
            if {"role", "content"} <= set(f.dataType.elementType.names):
                return True
    return False


def chat_text(messages: Column, begin: str = "<|im_start|>", end: str = "<|im_end|>", generate: bool = False) -> Column:
    """Messages through a fixed template; ``generate`` opens an assistant turn."""
    turns = F.array_join(F.transform(messages, lambda m: F.concat(F.lit(begin), m["role"], F.lit("\n"), m["content"], F.lit(end + "\n"))), "")
    return F.concat(turns, F.lit(f"{begin}assistant\n")) if generate else turns


def split_prompt(chosen: Column, rejected: Column) -> tuple[Column, Column, Column]:
    """(prompt, rest of chosen, rest of rejected) of two arrays."""
    n = shared_prefix(chosen, rejected)
    rest = lambda a: F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))
    return F.slice(chosen, 1, n), rest(chosen), rest(rejected)


def cyclic(df: DataFrame, key: str, tokens: str, budget: int) -> DataFrame:
    """All rows in key order again and again until the budget is met: (rows, copy), the last copy cut after the row that meets it."""
    from .relational import range_part

    total = df.agg(F.sum(tokens)).first()[0]
    whole, rest = divmod(budget, total)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    dealt = df.withColumn("_p", range_part(df, F.col(key)))
    base = dealt.groupBy("_p").agg(F.sum(tokens).alias("_t")).withColumn("_base", F.coalesce(F.sum("_t").over(earlier(Window.orderBy("_p"))), F.lit(0))).select("_p", "_base")
    placed = dealt.withColumn("_in", F.coalesce(F.sum(tokens).over(earlier(Window.partitionBy("_p").orderBy(key))), F.lit(0))).join(F.broadcast(base), "_p")
    last = placed.where(F.col("_base") + F.col("_in") < rest).select(*df.columns, F.lit(whole).cast("long").alias("copy"))
    if not whole:
        return last
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(whole - 1).cast("long")))).unionByName(last)


def pad(ids: Column, width: int, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(F.lit(width) - F.size(ids), F.lit(0))))


def completion_mask(prompt: int | Column, total: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), total), lambda i: F.when(i <= prompt, 0).otherwise(1))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.element_at(a, F.greatest(i, F.lit(1))) != F.element_at(b, i)))
    return F.when(n == 0, 0).when(F.size(differs) > 0, F.element_at(differs, 1) - 1).otherwise(n)


def unpair(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (chosen, rejected)]
    rows = F.explode(F.array(F.struct(F.col(chosen).alias("completion"), F.lit(True).alias("label")), F.struct(F.col(rejected).alias("completion"), F.lit(False).alias("label")))).alias("_r")
    return df.select(*rest, rows).select(*rest, "_r.completion", "_r.label")


def append_end(text: Column, end: str) -> Column:
    return F.when(text.endswith(end), text).otherwise(F.concat(text, F.lit(end)))


def stream_chunks(df: DataFrame, queue: str, order: str, length: str, size: int) -> DataFrame:
    """Chunk borders of a token stream per queue: (queue, chunk, n), no token lost and no tail of one token."""
    total = df.groupBy(queue).agg(F.sum(length).cast("long").alias("total"))
    chunks = F.ceil(F.col("total") / size)
    rows = total.where("total > 0").select(queue, "total", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), chunks.alias("_c"))
    tail = F.col("total") - (F.col("_c") - 1) * size
    n = F.when(F.col("chunk") < F.col("_c") - 1, F.lit(size)).otherwise(tail)
    one = (tail == 1) & (F.col("_c") > 1)
    return rows.select(queue, "chunk", (F.when(one & (F.col("chunk") == F.col("_c") - 2), n - 1).when(one & (F.col("chunk") == F.col("_c") - 1), n + 1).otherwise(n)).cast("long").alias("n"))


def stream_tokens(df: DataFrame, queue: str, key: str, ids: str, size: int, fix_tail: bool = True) -> DataFrame:
    """(queue, chunk, ids): a queue's token arrays end to end in key order, cut into chunks of ``size``; no token is lost.

    ``fix_tail``: a last chunk of one token takes one from the chunk before. Offsets come from sums
    over ranges of the key, so that no queue is put in one task.
    """
    from .relational import range_part

    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    slim = df.select(queue, key, F.col(ids).alias("_ids"), F.size(ids).cast("long").alias("_n")).where("_n > 0")
    dealt = slim.withColumn("_p", range_part(slim, F.col(key)))
    sums = dealt.groupBy(queue, "_p").agg(F.sum("_n").alias("_t"))
    base = sums.select(F.col(queue).alias("_q"), F.col("_p").alias("_b"), F.coalesce(F.sum("_t").over(earlier(Window.partitionBy(queue).orderBy("_p"))), F.lit(0)).alias("_base"), F.sum("_t").over(Window.partitionBy(queue)).alias("_total"))
    at = dealt.withColumn("_in", F.coalesce(F.sum("_n").over(earlier(Window.partitionBy(queue, "_p").orderBy(key))), F.lit(0))).join(base, F.col(queue).eqNullSafe(F.col("_q")) & (F.col("_p") == F.col("_b")))
    start, stop = F.col("_base") + F.col("_in"), F.col("_base") + F.col("_in") + F.col("_n")
    one = F.lit(fix_tail) & (F.col("_total") % size == 1) & (F.col("_total") > 1)
    # Where chunk c starts; with a tail of one token, the last starts one token earlier.
    begins = lambda c: c * size - F.when(one & (c * size == F.col("_total") - 1), 1).otherwise(0)
    of = lambda x: F.floor((x + F.when(one & (x >= F.col("_total") - 2), 1).otherwise(0)) / size)
    cut = at.select(queue, "_ids", start.alias("_start"), stop.alias("_stop"), "_total", F.explode(F.sequence(of(start), of(stop - 1))).alias("chunk"))
    a, b = F.greatest(F.col("_start"), begins(F.col("chunk"))), F.least(F.col("_stop"), begins(F.col("chunk") + 1))
    part = F.slice("_ids", (a - F.col("_start") + 1).cast("int"), (b - a).cast("int"))
    # One chunk is bounded by its size.
    return cut.select(queue, "chunk", a.alias("_a"), part.alias("_part")).groupBy(queue, "chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_a", "_part"))), lambda x: x["_part"])).alias("ids"))


def pack(df: DataFrame, strategy: str, key: str, ids: str, size: int, shard: str) -> DataFrame:
    """Packing by strategy: ``wrapped`` (streams by shard, cut freely), ``bfd`` (best fit over all rows, overlong truncated) or ``bfd_split``; the last two give bins."""
    if strategy == "wrapped":
        return stream_tokens(df, shard, key, ids, size, fix_tail=False)
    if strategy in ("bfd", "bfd_split"):
        lengths = df.select(key, F.size(ids).cast("long").alias("_len"))
        return bins(pack_best_fit(lengths, key, "_len", size, "split" if strategy == "bfd_split" else "truncate"), key)
    raise ValueError(f"no strategy {strategy!r}")


def bins(packed: DataFrame, key: str) -> DataFrame:
    """(bin, keys, seq_lengths): what each bin holds, longest first; a bin is bounded by its size."""
    own = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_n"), key)))
    return packed.groupBy("bin").agg(own.alias("_own")).select("bin", F.transform("_own", lambda x: x[key]).alias("keys"), F.transform("_own", lambda x: -x["_n"]).alias("seq_lengths"))


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first, places, bin, each): best-fit decreasing over a histogram of lengths from 1 to ``size``.

    Items of a length are numbered; from number ``first`` on, ``places`` of them go to the bins from ``bin`` on, ``each`` to one.
    Items of one length are alike, so bins with the same room are told apart by their number only: each room holds
    ranges of bins, and a length fills the tightest room's lowest bins, as often as it fits, before the next room's. The work and the plan
    grow with the lengths and ranges that occur, not with the items.
    """
    import heapq

    room: dict[int, list[tuple[int, int]]] = {}  # space -> ranges of bins [a, b), as a heap
    out, opened = [], 0
    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        left, first = counts[n], 0
        for space in sorted(s for s in room if s >= n):
            each = space // n
            while left and room.get(space):
                a, b = heapq.heappop(room[space])
                full = min(b - a, left // each)
                if full:
                    out.append((n, first, full * each, a, each))
                    first, left = first + full * each, left - full * each
                    heapq.heappush(room.setdefault(space - n * each, []), (a, a + full))
                rest = a + full
                if rest < b and left and left < each:
                    out.append((n, first, left, rest, left))
                    heapq.heappush(room.setdefault(space - n * left, []), (rest, rest + 1))
                    first, left, rest = first + left, 0, rest + 1
                if rest < b:
                    heapq.heappush(room[space], (rest, b))
            if not left:
                break
        if left:
            each = size // n
            full, part = divmod(left, each)
            if full:
                out.append((n, first, full * each, opened, each))
                heapq.heappush(room.setdefault(size - n * each, []), (opened, opened + full))
                first, opened = first + full * each, opened + full
            if part:
                out.append((n, first, part, opened, part))
                heapq.heappush(room.setdefault(size - n * part, []), (opened, opened + 1))
                opened += 1
        room = {s: r for s, r in room.items() if r and s}
    return out


def pack_best_fit(df: DataFrame, key: str, length: str, size: int, overlong: str = "truncate") -> DataFrame:
    """Best-fit decreasing bins of at most ``size`` over all rows: (key, bin, n), longest first, equal ones by key.

    One packing, whatever the partitions: bins are planned from how often each length occurs (``size`` numbers at
    most), and rows take the planned places by their rank within their length. Longer sequences count as ``size``
    (truncate), or are cut into parts of ``size`` and a rest, with a column ``part`` from 0 (split). Empty sequences take no room, in bin 0.
    """
    from .relational import with_position

    if overlong not in ("truncate", "split"):
        raise ValueError("overlong is truncate or split")
    slim = df.select(F.col(key).cast("long").alias(key), F.col(length).cast("long").alias("_n"))
    last = F.greatest(F.ceil(F.col("_n") / size) - 1, F.lit(0)) if overlong == "split" else F.lit(0)
    parts = slim.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).withColumn("n", F.least(F.col("_n") - F.col("part") * size, F.lit(size).cast("long"))).drop("_n")
    counts = {r.n: r.c for r in parts.where("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most ``size`` rows
    plan = parts.sparkSession.createDataFrame([(n, f, p, b, e) for n, f, p, b, e in best_fit_plan(counts, size)], "n long, first long, places long, start long, each long")
    # As many ranges as rooms were met; a length's own are one row.
    plan = plan.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("first", "places", "start", "each"))).alias("plan"))
    ranked = with_position(parts, key, "part", by=("n",))
    own = F.get(F.filter("plan", lambda s: (s["first"] <= F.col("position")) & (F.col("position") < s["first"] + s["places"])), F.lit(0))
    placed = ranked.join(plan, "n", "left").withColumn("_s", own).select(key, "part", F.coalesce(F.col("_s.start") + F.floor((F.col("position") - F.col("_s.first")) / F.col("_s.each")), F.lit(0)).cast("long").alias("bin"), "n")
    return placed if overlong == "split" else placed.drop("part")


def numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Occurrence number of each key, from 0; a hot key is counted in ranges."""
    from .relational import with_position

    return with_position(df, *order, by=(key,)).withColumnRenamed("position", "rep")
