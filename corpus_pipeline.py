"""A training corpus from documents: each stage works on all that the one before it kept.

In every stage texts count whole, however long; null and repeated ids are judged by their text; equal rows
share one fate but in near dedup, where one of them stays; an empty table gives an empty one; columns
besides those that a stage changes pass through whatever their names. What a null or an empty text and a
tie mean is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.llm import bpe, decontaminate, linededup, neardup, quality


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null and empty texts, and all under 10 words. A value on a fence stays; null languages and sources are groups."""
    return quality.keep_good(docs)


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars follows. Null texts stay null; a share exactly at the ratio stays; a null source is a host."""
    return linededup.clean(docs)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id, ids before nulls, of equal ids the one with the least key of its text. Texts without words stay."""
    return neardup.one_of_each(docs)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with the benchmark go. Null and empty texts stay; agreement of exactly 80 % is an overlap."""
    return decontaminate.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them. A null text counts as empty: no ids; of pairs of equal rank the leftmost merges first."""
    return bpe.digests(docs, with_ids=True)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: SQL has no byte pair encoding and no components of unbounded depth over similar sets; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again; a stage's input goes when its output is there."""
    import uuid

    from tessera.storage import checkpoint_dir, remove

    docs, top = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{i}")
        docs = spark.read.parquet(f"{top}/{i}")
        if i:
            remove(spark, f"{top}/{i - 1}")
    return docs
