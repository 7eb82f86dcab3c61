"""Corpus pipeline: quality classifier, near-duplicate join, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of ``documents``; the last returns pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard_join, packing, quality, suffix_dedup
from ledgerloom.llm.common import persist_table, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject (score of at least ``quality.THRESHOLD``)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs.select(*COLUMNS), model, COLUMNS).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least (doc_id, text hash) of each group of near-duplicates; null doc_ids come last.

    Rows are told apart by doc_id and text, so an exact copy goes even where another row has its
    doc_id. Rows that agree in both are one document listed twice: one of them stays.
    """
    rows = jaccard_join.near_duplicates(docs.select("doc_id", "text"))
    least = rows.where(shown(F.col("doc")).eqNullSafe(F.col("group_id")) & (F.col("tag") == F.col("group_tag")))
    kept = persist_table(least.groupBy("doc", "tag").agg(F.count(F.lit(1)).alias("listed")), "pipeline-kept")
    keyed = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), F.xxhash64("text").alias("tag"))
    if not kept.where("listed > 1").limit(1).count():
        return keyed.join(kept.select("doc", "tag"), ["doc", "tag"], "left_semi").select(*COLUMNS)
    once = keyed.join(kept.where("listed = 1").select("doc", "tag"), ["doc", "tag"], "left_semi")
    again = keyed.join(kept.where("listed > 1").select("doc", "tag"), ["doc", "tag"], "left_semi").dropDuplicates(["doc", "tag"])
    return once.unionByName(again).select(*COLUMNS)


def shown(doc):
    return F.when(doc != 2**63 - 1, doc)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that start in earlier documents; characters cut in two are dropped whole."""
    out = suffix_dedup.suffix_dedup(docs.select(*COLUMNS), whole_characters=True)
    return out.select("doc_id", F.col("kept").cast("string").alias("text"), "lang", "source").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: Fitting and packing have no SQL; tests/llm compares every stage with a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
