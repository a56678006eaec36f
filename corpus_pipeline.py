"""A corpus pipeline from the operators of ``exposure.llm``: from raw documents to packed token sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return its columns. Each row is
judged by its own text, also where rows share a doc_id or have none. Null and empty texts pass or fail a stage as
its operator says: they are scored by the classifier like any text, link with nothing, hold no repeats and no benchmark
words, and pack as their end id. Columns beside doc_id and text are passed on; n_chars follows the text where it is there.
An empty table passes all stages and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.llm import decontamination, minhash, packing, quality, suffixes
from exposure.llm.filters import ROW, first_of_groups, one_of_each, with_row_key, without_rows
from exposure.llm.queries import table, vocabulary
from exposure.llm.shared import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    docs = with_row_key(docs)
    scores = quality.score(docs, table(spark, sf_dir, "labels"), "quality", features=256, width=8.0, ridge=1e-3, carry=(ROW,))
    return without_rows(docs, scores.select(ROW, (F.col("predicted") == 1).alias("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays."""
    docs = with_row_key(docs)
    hashed = docs.withColumn("_hash", F.col(ROW)["a"])  # an id that rows share only if alike, which a null doc_id is not
    groups = stored(minhash.near_duplicates(hashed, k=5, percent=80, h=3, m=13, id_col="_hash", carry=(ROW,)), "near")
    return one_of_each(without_rows(docs, first_of_groups(groups)))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that occurred before are cut out; what has nothing left goes."""
    return suffixes.without_repeats(docs, keep="first", chars_col="n_chars" if "n_chars" in docs.columns else None)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    docs = with_row_key(docs)
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, id_col=ROW)
    return without_rows(docs, found.select(F.col("doc_id").alias(ROW), (~F.col("contaminated")).alias("kept")))


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_decontamination", benchmark_decontamination),
    ("token_packing", token_packing),
]

#: Trained scores and token ids are beyond SQL; the pipeline is tested against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
