"""The named queries of this subpackage: each runs one operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .centroids import cluster
from .chat import chat_windows, conversation_digests
from .class_lm import score_texts
from .common import crc_mod, documents
from .decontaminate import find_leaks
from .jaccard import jaccard_components
from .language import predict_language, train_language_model
from .manifest import tampered_documents
from .multi_index import search
from .pack import pack
from .pii import find_pii
from .suffix_dedup import drop_repeated_strings
from .toxicity import score_toxicity, train_toxicity
from .window_dedup import drop_repeated_windows


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op2_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_windows(documents(spark, sf_dir), with_text=False)


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], told.schema)
    return conversation_digests(chat_windows(told.unionByName(added)))


def op4_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op5_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), crc_mod("doc_id", 7) == 2)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_strings(documents(spark, sf_dir)).drop("kept")


def op8_hierarchical_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train_language_model(docs, crc_mod("doc_id", 3) != 1)
    return predict_language(docs, model, "doc_id").select(
        "doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_documents(documents(spark, sf_dir))


def op12_vantage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_mod("doc_id", 5) == 0
    return score_toxicity(docs, train_toxicity(docs, labels, ~held_out), "doc_id").select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted"
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_multi_index,
        op2_superkmer_dedup,
        op3_chat_windows,
        op4_sanitise,
        op5_jaccard_components,
        op6_class_lm,
        op7_suffix_dedup,
        op8_hierarchical_pack,
        op9_language,
        op10_decontaminate,
        op11_merkle_manifest,
        op12_vantage_clusters,
        op13_toxicity,
    )
}

SQL: dict[str, str] = {
    "op11_merkle_manifest": sql.MERKLE_MANIFEST,
    "op12_vantage_clusters": sql.CENTROIDS,
}
