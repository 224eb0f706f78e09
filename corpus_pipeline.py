"""A corpus pipeline over `documents`: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filetwin.llm.common import crc_mod, documents
from filetwin.llm.decontaminate import drop_leaks
from filetwin.llm.jaccard import keep_first_of_each
from filetwin.llm.language import keep_known_language, train_language_model
from filetwin.llm.pack import pack
from filetwin.llm.pii import redact
from filetwin.llm.queries import tokenizer_path
from filetwin.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters and near-chance guesses go."""
    return keep_known_language(docs, train_language_model(docs, crc_mod("doc_id", 3) != 1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return keep_first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what discloses it replaced by marks."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their training windows."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("privacy", privacy),
    ("packing", packing),
]

#: No stage but the last could be put into SQL, and that only without its tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
