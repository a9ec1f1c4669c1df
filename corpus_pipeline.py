"""The training-corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factlens.llm import bpe, components, decontam, jaccard, langid, linededup
from factlens.llm import queries as registered


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, junk, and those whose language is less sure than held-out documents of the learned languages are. Rows with a null doc_id go: no later stage could name them."""
    components.small_batches(spark)
    docs = docs.where("doc_id is not null")
    net = langid.fit(docs, reject=True)
    return langid.keep_known(docs, net, langid.least_score(docs, net))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one line of each group of alike lines; a document left without any line goes."""
    return linededup.deduplicate(docs).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return jaccard.deduplicate(docs).select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.decontaminate(docs, registered.table(spark, sf_dir, "benchmark")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document that is left."""
    return bpe.encode_documents(docs, registered.vocabulary(), keep_ids=False)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]
#: A fitted classifier and BPE are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again."""
    docs = registered.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = components.saved(stage(spark, docs, sf_dir))
    return docs
