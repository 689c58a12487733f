"""Registered queries of the subpackage, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketspark.llm import backoff_lm, chat_prefix, hilbert_shards, jaccard_join, lp_packing, lsi_decontam, pii_disclosure, son_collocations, target_resampling, toxicity, trie_dedup, url_vocab, warc_chain
from marketspark.llm.common import numbered
from marketspark.llm.target_resampling_sql import resample_sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ranks_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: the rules of the host and path list
RULES = [url_vocab.Rule(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


def op1_chat_prefix(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_prefix.digest(chat_prefix.expand(turns))


def op2_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.linked(numbered(table(spark, sf, "documents"))).select("doc_id", "n_shingles", "component_id")


def op3_lsi_decontam(spark: SparkSession, sf: str) -> DataFrame:
    return lsi_decontam.leaks(numbered(table(spark, sf, "documents")), table(spark, sf, "benchmark"))


def op4_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    return hilbert_shards.shard_documents(table(spark, sf, "documents"))


def op5_trie_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return trie_dedup.dedup(numbered(table(spark, sf, "documents"))).drop("row")


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_url_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return url_vocab.judge(table(spark, sf, "pages"), RULES)


def op8_lp_packing(spark: SparkSession, sf: str) -> DataFrame:
    return lp_packing.pack(table(spark, sf, "documents"), ranks_path())


def op9_backoff_lm(spark: SparkSession, sf: str) -> DataFrame:
    return backoff_lm.score(table(spark, sf, "documents"), order=3)


def op10_pii_disclosure(spark: SparkSession, sf: str) -> DataFrame:
    return pii_disclosure.digest(pii_disclosure.find(numbered(table(spark, sf, "documents"))))


def op11_target_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return target_resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_warc_chain(spark: SparkSession, sf: str) -> DataFrame:
    return warc_chain.round_trip(numbered(table(spark, sf, "pages")))


def op13_son_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return son_collocations.collocations(table(spark, sf, "documents"))


OP1_SQL = """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n, length(regexp_replace(role, '[<\\[\\\\]', '..', 'g')) + 16
 + length(regexp_replace(text, '[<\\[\\\\]', '..', 'g')) + CASE WHEN role = 'user' THEN 15 ELSE 4 END AS long FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
x AS (SELECT *, 3 + sum(long) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars, count(*) FILTER (WHERE role = 'assistant' OR i = n) AS n_examples FROM x GROUP BY conv_id"""
OP5_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
h AS (SELECT doc_id, length(text) AS chars, sha256(norm) AS text_sha256 FROM d),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_chat_prefix, op2_jaccard_join, op3_lsi_decontam, op4_hilbert_shards, op5_trie_dedup, op6_toxicity, op7_url_vocab, op8_lp_packing, op9_backoff_lm, op10_pii_disclosure, op11_target_resampling, op12_warc_chain, op13_son_collocations)}
ORACLES: dict[str, str] = {"op1_chat_prefix": OP1_SQL, "op5_trie_dedup": OP5_SQL, "op7_url_vocab": url_vocab.judge_sql(RULES),
                           "op11_target_resampling": resample_sql(), "op12_warc_chain": warc_chain.round_trip_sql(), "op13_son_collocations": son_collocations.collocations_sql()}
