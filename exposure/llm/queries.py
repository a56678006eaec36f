"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.llm import dac, decontamination, hard_negatives, merkle, minhash, oracles, packing, perplexity, prefix_counts, quality, sentence_pieces, suffixes, tool_calls, toxicity
from exposure.llm.shared import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op2_positional_index": oracles.CONTAMINATION, "op4_previous_factors": oracles.REPEATS, "op8_tensored_minhash": oracles.NEAR_GROUPS,
    "op11_merkle_manifest": oracles.MANIFEST, "op13_hard_negatives": oracles.HARD_NEGATIVES,
}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: The folder that holds the package, for Python workers that were not started in it.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=2048)


@query
def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.rules(table(spark, sf_dir, "documents"), spread=5.0)


@query
def op6_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "codes")
    dac.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return dac.documents_at(spark, path)


@query
def op2_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10).drop("doc")


@query
def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.calls_of_chats(table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.schema_table(spark, tool_calls.SCHEMAS))


@query
def op4_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents"), keep="none")


@query
def op7_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    return toxicity.score(table(spark, sf_dir, "documents"), labels, ["low_quality", "toxic"], target="toxic")


@query
def op8_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85, h=4, m=12)


@query
def op9_fourier_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", features=256, width=8.0, ridge=1e-3)


@query
def op10_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.counted(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query
def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_pieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), decoded=True)
    digests = F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return found.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), *digests)


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = lambda vec_id, label: F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), anchor=lambda vec_id: vec_id % 100 == 0, label=shifted)
