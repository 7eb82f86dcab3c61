"""Evaluation records: verification, joins with assertions, accounting, regrading, export."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .answers import graded_answers
from .grade import STATUSES, compare, metadata

#: Statuses that are no judgement of an answer.
FAILURES = tuple(s for s in STATUSES if s not in ("correct", "incorrect"))


def paired(a: DataFrame, b: DataFrame, key: str, same: list[str]) -> DataFrame:
    """One row: keys on one side only, keys met more than once, and for each field how many pairs differ (null equals null)."""
    x = a.groupBy(key).agg(F.count(F.lit(1)).alias("_na"), *[F.first(c).alias(f"_a_{c}") for c in same])
    y = b.groupBy(key).agg(F.count(F.lit(1)).alias("_nb"), *[F.first(c).alias(f"_b_{c}") for c in same])
    both = F.col("_na").isNotNull() & F.col("_nb").isNotNull()
    return x.join(y, key, "full_outer").agg(
        F.count_if(F.col("_nb").isNull()).alias("only_a"), F.count_if(F.col("_na").isNull()).alias("only_b"), F.count_if((F.col("_na") > 1) | (F.col("_nb") > 1)).alias("repeated"),
        *[F.count_if(both & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias(f"differ_{c}") for c in same],
    )


def ensure(df: DataFrame, bad: Column, message: Column) -> DataFrame:
    """The rows as they are; a bad one is an error, whichever columns are read (a filter can't be pruned away)."""
    return df.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def asserted_join(predictions: DataFrame, items: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Predictions with their items; a prediction without an item or with another value in a field of ``same`` is an error when the row is read."""
    there = items.withColumnsRenamed({c: f"_i_{c}" for c in same}).withColumn("_there", F.lit(True))
    out = predictions.join(there, key, "left")
    wrong = reduce(lambda p, c: p | ~F.col(c).eqNullSafe(F.col(f"_i_{c}")), same, F.col("_there").isNull())
    message = F.concat(F.lit(f"no item agrees with {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return ensure(out, wrong, message).drop("_there", *[f"_i_{c}" for c in same])


def score_changes(df: DataFrame, keys: list[str], kind: str, original: str, other: str, gold: str, score: str) -> DataFrame:
    """(keys, original, other): items whose gold is equal in both probes and whose score is not."""
    a = df.where(F.col(kind) == original).select(*keys, F.col(gold).alias("_g"), F.col(score).alias("original"))
    b = df.where(F.col(kind) == other).select(*keys, F.col(gold).alias("_h"), F.col(score).alias("other"))
    return a.join(b, keys).where(F.col("_g").eqNullSafe(F.col("_h")) & ~F.col("original").eqNullSafe(F.col("other"))).select(*keys, "original", "other")


def unfaithful_copies(copies: DataFrame, sources: DataFrame, source_key: str, key: str, payload: str) -> DataFrame:
    """Copies whose source is missing or has another payload (compared by hash, so that long payloads don't travel)."""
    digest = lambda c: F.sha2(F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("")), 256)
    known = sources.select(F.col(key).alias("_k"), digest(payload).alias("_d")).distinct()
    return copies.withColumn("_c", digest(payload)).join(known, (F.col(source_key) == F.col("_k")) & (F.col("_c") == F.col("_d")), "left_anti").drop("_c")


def accounting(df: DataFrame, status: str, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """(status, n) of all statuses, zeros included; an item under any other status, or none, is an error."""
    fine = F.coalesce(F.col(status).isin(*statuses), F.lit(False))
    checked = F.when(fine, F.col(status)).otherwise(F.raise_error(F.concat(F.lit("unaccounted status: "), F.coalesce(F.col(status).cast("string"), F.lit("null")))))
    names = df.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counts = df.select(checked.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    # A full join keeps the check: an optimiser may not drop the counted side.
    return names.join(counts, "status", "full_outer").na.fill(0, ["n"])


def family_metrics(df: DataFrame, family: str, status: str, strict: str) -> DataFrame:
    """Per family: items, correct, incorrect, failed, mean task result and mean strict schema."""
    s = F.col(status)
    right = F.when(s == "correct", 1.0).otherwise(0.0)
    return df.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.count_if(s == "correct").alias("correct"), F.count_if(s == "incorrect").alias("incorrect"), F.count_if(s.isin(*FAILURES)).alias("failed"), F.avg(right).alias("task"), F.avg(F.col(strict).cast("double")).alias("strict"))


def error_groups(df: DataFrame, family: str, status: str, key: str) -> DataFrame:
    """(status, family, key, n): every failure under its status and family, with how many there are of its kind; a row each, so that none is left out."""
    own = df.where(F.col(status) != "correct").select(status, family, key)
    counts = own.groupBy(F.col(status).alias("_s"), F.col(family).alias("_f")).agg(F.count(F.lit(1)).alias("n"))
    return own.join(counts, F.col(status).eqNullSafe(F.col("_s")) & F.col(family).eqNullSafe(F.col("_f"))).drop("_s", "_f")


def verify(df: DataFrame, key: str, required: list[str], status: str, expected: int, grader: str | None = None, grader_column: str = "grader_sha256") -> list[str]:
    """All faults of a record set as sentences (one pass); none if it may be reported on."""
    missing = reduce(lambda p, c: p | F.col(c).isNull(), required, F.lit(False))
    checks = [F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("ids"), F.count_if(missing).alias("missing"), F.count_if(~F.coalesce(F.col(status).isin(*STATUSES), F.lit(False))).alias("unknown")]
    checks += [F.count_if(~F.col(grader_column).eqNullSafe(F.lit(grader))).alias("stale")] if grader else []
    r = df.agg(*checks).first().asDict()
    said = {"missing": "records lack required fields", "unknown": "records have unknown statuses", "stale": "records come from another grader"}
    out = [f"{r['n']} records, {expected} expected"] if r["n"] != expected else []
    out += [f"{r['n'] - r['ids']} repeated or null ids"] if r["n"] != r["ids"] else []
    return out + [f"{r[k]} {text}" for k, text in said.items() if r.get(k)]


def seed_scores(df: DataFrame, seed: str, item: str, score: str) -> DataFrame:
    """(seed, n, mean), one row a seed; a seed that lists an item twice, or other items than the rest, is an error when read."""
    per = df.groupBy(seed).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(item).alias("_d"), F.sum(F.xxhash64(item).cast("decimal(38,0)")).alias("_h"), F.avg(score).alias("mean"))
    whole = per.agg(F.min("_h").alias("_low"), F.max("_h").alias("_high"), F.min("n").alias("_least"), F.max("n").alias("_most"))
    out = per.crossJoin(F.broadcast(whole))
    bad = (F.col("n") != F.col("_d")) | (F.col("_low") != F.col("_high")) | (F.col("_least") != F.col("_most"))
    return ensure(out, bad, F.lit("seeds differ in their items")).select(seed, "n", "mean")


def census(df: DataFrame, dimensions: list[str], keys: list[str], score: str, status: str) -> DataFrame:
    """Per (keys, dimension, value): n, scored, correct sum and SQL errors; a row counts once in each dimension."""
    long = df.select(*keys, F.col(score).cast("double").alias("_score"), F.col(status).alias("_status"), F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("_d"))
    return long.groupBy(*keys, "_d.dimension", "_d.value").agg(F.count(F.lit(1)).alias("n"), F.count("_score").alias("scored_n"), F.coalesce(F.sum("_score"), F.lit(0.0)).alias("correct_sum"), F.count_if(F.col("_status") == "SQL_error").alias("sql_errors"))


def part_counters(df: DataFrame, parts: str) -> DataFrame:
    """Of an array of (kind, correct, output) parts a row: per kind the parts, correct ones and empty outputs."""
    p = df.select(F.explode(parts).alias("_p"))
    return p.groupBy(F.col("_p.kind").alias("kind")).agg(F.count(F.lit(1)).alias("total"), F.count_if("_p.correct").alias("correct"), F.count_if(F.coalesce(F.trim("_p.output"), F.lit("")) == "").alias("empty"))


def coverage(observed: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """One row: required combinations not seen, and seen ones not required."""
    a, b = observed.select(*keys).distinct(), required.select(*keys).distinct()
    missing, extra = b.join(a, keys, "left_anti"), a.join(b, keys, "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("missing")).crossJoin(extra.agg(F.count(F.lit(1)).alias("extra")))


def no_match(df: DataFrame, gold_size: Column, predicted_size: Column, correct: Column) -> DataFrame:
    """Items without any match: how many, answered rightly with none (avoidance), and abstentions by an empty answer over all."""
    none = gold_size == 0
    return df.agg(F.count_if(none).alias("n"), F.count_if(none & correct).alias("valid"), F.count_if(none & (predicted_size > 0)).alias("invented"), F.count_if(~none & (predicted_size == 0)).alias("wrongly_empty"))


def _regraded(record: dict) -> dict:
    """What a record with retained tables grades to now, from its evidence alone."""
    def tables(kept):
        return (tuple(kept["columns"]), [tuple(r) for r in kept["rows"]]) if isinstance(kept, dict) and {"columns", "rows"} <= set(kept) else None

    unsure = {"regrade": "insufficient_evidence"}
    try:
        if record["answer_type"] == "multi_part":
            kept = record.get("result")
            parts = record.get("parts") or []
            if not parts or not isinstance(kept, dict) or not isinstance(kept.get("extra_present"), bool):
                return unsure
            done = []
            for p in parts:
                gold, got = tables((record.get("gold") or {}).get(p["part_id"])), tables((kept.get("parts") or {}).get(p["part_id"]))
                if gold is None or got is None:
                    return unsure
                done.append(compare(*metadata(p), gold, got))
            right, strict = all(g.correct for g in done), all(g.strict for g in done) and not kept["extra_present"]
            return {"regrade": "recomputed", "status": "correct" if right else "incorrect", "strict": strict}
        if record.get("status") not in ("correct", "incorrect"):
            return {"regrade": "recomputed", "status": record.get("status"), "strict": False} if record.get("status") in FAILURES else unsure
        gold, got = tables(record.get("gold")), tables(record.get("result"))
        if gold is None or got is None:
            return unsure
        g = compare(*metadata(record), gold, got)
        return {"regrade": "recomputed", "status": g.status, "strict": g.strict}
    except (ValueError, KeyError, TypeError):
        return unsure


def regraded(df: DataFrame, record: str, grader: str) -> DataFrame:
    """Add ``regrade`` (outcome), ``new_status``, ``new_strict`` and ``grader_sha256``; nothing else changes, no SQL runs.

    ``record``: a JSON text with the retained evidence. Records whose evidence does not suffice keep
    their old grade.
    """
    @F.pandas_udf("regrade string, status string, strict boolean")
    def run(s: pd.Series) -> pd.DataFrame:
        out = [_regraded(json.loads(t)) for t in s]
        return pd.DataFrame({"regrade": [o["regrade"] for o in out], "status": [o.get("status") for o in out], "strict": [o.get("strict") for o in out]})

    # Answers from memory are words or JSON: those go through the grading of answers, as expressions.
    of = lambda path, kind="variant": F.try_variant_get(F.parse_json(record), path, kind)
    kept = F.coalesce(F.schema_of_variant(of("$.result")) != "VOID", F.lit(False))
    memory = F.coalesce((of("$.mode", "string") == "memory") & ~kept & of("$.raw_output").isNotNull() & of("$.gold").isNotNull() & of("$.answer_type", "string").isin("scalar", "set", "top_k"), F.lit(False))
    item = F.to_json(F.struct(*[of(f"$.{c}").alias(c) for c in ("answer_type", "attribute", "company", "target_columns")], of("$.gold").alias("gold_value")))
    x = df.select(F.struct(*df.columns).alias("_row"), F.col(record).alias("_record"), memory.alias("_memory"), F.when(memory, of("$.raw_output", "string")).alias("_text"), F.when(memory, item).otherwise('{"answer_type": "set", "gold_value": []}').alias("_item"))
    x = graded_answers(x, "_text", "_item")
    from_memory = F.struct(F.lit("recomputed").alias("regrade"), F.col("graded.status").alias("status"), F.col("graded.strict").alias("strict"))
    x = x.withColumn("_g", F.when(F.col("_memory"), from_memory).otherwise(run("_record")))
    return x.select("_row.*", F.col("_g.regrade").alias("regrade"), F.col("_g.status").alias("new_status"), F.col("_g.strict").alias("new_strict"), F.lit(grader).alias("grader_sha256"))


def regrade_coverage(df: DataFrame, outcome: str) -> DataFrame:
    """Each record in one bucket."""
    o = F.col(outcome)
    return df.agg(F.count_if(o == "recomputed").alias("recomputed"), F.count_if(o == "insufficient_evidence").alias("insufficient_evidence"), F.count_if(o.isNull()).alias("not_yet"), F.count(F.lit(1)).alias("total"))


def final_run(predictions: DataFrame, items: DataFrame, key: str, text: str, item: str) -> DataFrame:
    """(key, status): every item once, graded; missing or repeated predictions are an error when read."""
    once = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(text).alias("_t"))
    out = items.select(key, F.col(item).alias("_i")).join(once, key, "full_outer")
    wrong = F.col("_n").isNull() | (F.col("_n") > 1) | F.col("_i").isNull()
    message = F.concat(F.lit("not one prediction and item for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    sound = ensure(out, wrong, message).select(key, "_t", F.coalesce("_i", F.lit('{"answer_type": "set", "gold_value": []}')).alias("_i"))
    return graded_answers(sound, "_t", "_i").select(key, F.col("graded.status").alias("status"))


def classify_artifact(path: str, sha256: str, known: dict[str, str], sealed: set[str]) -> str:
    """dev or sealed by content alone; anything else is refused before it is parsed (``artifacts`` goes by path and content)."""
    if sha256 in sealed:
        return "sealed"
    kind = known.get(sha256)
    if kind is None:
        raise PermissionError(f"unknown artifact: {path}")
    return kind


def export(df: DataFrame, path: str, identity: dict, key: str) -> dict:
    """Write predictions once (never over a file) with row hashes, and return the manifest: identity, rows and a digest of all."""
    columns = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*columns)), 256).alias("row_sha256")
    df.select(*columns, row).write.mode("error").json(path)
    back = df.sparkSession.read.schema(df.select(*columns, row).schema).json(path)
    facts = back.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("k"), F.sha2(F.sum(F.conv(F.substring("row_sha256", 1, 15), 16, 10).cast("decimal(38,0)")).cast("string"), 256).alias("d")).first()
    if facts.n != facts.k:
        raise ValueError(f"{facts.n - facts.k} repeated ids")
    return {**identity, "rows": facts.n, "digest": facts.d}
