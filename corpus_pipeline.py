"""The corpus pipeline: documents through quality rules, near-dedup, passage dedup, decontamination and encoding.

Each stage works on all that its predecessor kept, reads its documents from a table, and returns the columns of
`documents`, but for the last, which returns each document's encoding.

Defined results, for every stage: rows are judged and kept one by one, whether their id is null or repeats; an empty table
gives an empty one; columns that a stage doesn't read come through as they were, whatever their names; n_chars follows a
changed text. Null, empty and very short texts fail the base rules and go in the first stage; a stage that is called with
them alone takes each as a class of its own, leaves them as they are and gives them no tokens. Of near-duplicates the least
id stays, null ids last, of equal ids the first row; of equal passages the one of the least id, null ids first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphsieve.llm import bpe, decontaminate, minhash, passages, quality_rules
from glyphsieve.llm.common import bounded, cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the certified rules keep."""
    bounded(spark)
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates."""
    bounded(spark)
    return minhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that an earlier place has in a run of 100 or more."""
    bounded(spark)
    return passages.deduped(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold windows of two or more benchmark items, without the windows of one."""
    bounded(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens, and the digests of its ids and of what they decode to."""
    bounded(spark)
    return bpe.digests(docs, *bpe.public_vocabulary())


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark leaks", benchmark_leaks),
    ("byte-level BPE", encoding),
]
#: Risk-controlled cutoffs, sketches and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = cut(docs, f"stage{k}")
    return docs
