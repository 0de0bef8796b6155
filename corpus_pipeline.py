"""Raw documents to packed training sequences, in five stages.

Each stage reads all that the one before has kept and takes effect: language
identification drops texts of no language; exact deduplication keeps one row of
equal texts; the n-gram Jaccard join keeps one document of each group of near
duplicates (five-word shingles, similarity 0.8); benchmark decontamination
drops documents that contain a benchmark item; best-fit packing makes sequences
of the rest. All but the last return the columns of their input.

A stage gives defined results on an empty table and on nulls, by the rules of
its operator; rows with a null doc_id cannot be named as copies and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm.decontamination import decontaminate
from blockloom.llm.exact_dedup import keep_one
from blockloom.llm.jaccard_join import keep_representatives
from blockloom.llm.language_id import reject_unknown, train
from blockloom.llm.packing import best_fit_packing, tokenizer_path
from blockloom.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_unknown(docs, train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_representatives(docs, percent=80, width=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Executors still hold what earlier stages needed, so fewer words are remembered here.
    return best_fit_packing(docs, tokenizer_path(), with_ids=True, remember=250_000)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit),
]

#: Training a model, connected components and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
