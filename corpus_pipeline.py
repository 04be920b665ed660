"""A corpus pipeline of five stages, each on all that the one before kept: toxicity, line dedup, Jaccard join, decontamination, byte-level BPE."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import bpe, decontaminate, jaccard, line_dedup, toxicity
from chronoloom.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine doesn't take for toxic. It is fitted on a bounded sample of labelled rows; see toxicity.fit."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, machine, keep=("text", "lang", "source", "n_chars")).where("predicted = 0").select(*COLUMNS)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more share (the largest doc_id keeps them). One without any other line stays, with an empty text; a null text becomes an empty one."""
    done = line_dedup.dedup_lines(docs.select(*COLUMNS), line_dedup.LineIndex.of(docs), whole=False)
    return done.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("kept").cast("long")).alias("n_chars"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id; documents without words are no group and stay."""
    groups = jaccard.similar_documents(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(groups, "doc_id", "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that stand in the benchmark; one that is nothing but such spans stays, with what stood around them."""
    found = decontaminate.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), remove="spans", keep=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("contaminated"), F.col("clean_text")).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("contaminated"), F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document that is left."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, columns=("n_tokens", "ids_sha256", "decoded_sha256", "ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_common_lines),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", without_benchmark),
    ("byte_bpe", as_tokens),
]

#: The machine of the first stage and the tokenizer of the last can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    name, last = STAGES[-1]
    return last(spark, docs, sf_dir)
