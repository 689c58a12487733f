"""A corpus pipeline of five stages over ``documents``; each writes Parquet that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketspark.llm import jaccard_join, lp_packing, lsi_decontam, toxicity, trie_dedup
from marketspark.llm.common import numbered, stash, without
from marketspark.llm.queries import ranks_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones, scores below one half."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.reject(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    found = trie_dedup.dedup(numbered(docs.select("doc_id", "text")))
    return without(docs, stash(found.where("NOT kept").select("row"), "dropped"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies; documents without words all stay."""
    found = jaccard_join.linked(numbered(docs.select("doc_id", "text")))
    return without(docs, stash(found.where("row <> keep_row").select("row"), "dropped"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = lsi_decontam.leaks(numbered(docs.select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    return without(docs, stash(found.select("row").distinct(), "dropped"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, placed in sequences of 1024 tokens."""
    return lp_packing.pack(docs, ranks_path())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: a fitted classifier and a tokenizer have no SQL; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
