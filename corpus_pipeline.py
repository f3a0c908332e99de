"""Training-data pipeline over ``documents``: filter, dedup three ways, cut repeats, pack.

Each stage takes all that its predecessor kept and writes its result as Parquet in the shared
folder, so a lost executor costs tasks, not stages.

All stages but the last give back all columns of their rows, whatever their names (but ``_row``, ``_key``, ``_runs`` and ``_run_id``, which
stages use themselves and refuse). Texts are of any length and null texts count as empty. Rows with a null id, or an id that repeats, are
rows like any other; of equal texts the longest original and then the smallest id stays, of near copies the smallest
id, null ids last. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, packing, simhash_dedup, suffix_dedup, toxicity
from corpusloom.llm.common import crc_fold, small_batches, stage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity limit; the model learns from the training folds' labels."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_fold("doc_id", 4) != 2)
    model = toxicity.fit(docs, labels)
    score = f"_toxicity_{uuid.uuid4().hex}"
    return toxicity.scored(docs, model, score_col=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal apart from white space."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more."""
    return simhash_dedup.drop_near_copies(docs, words=5)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the 100-byte strings that an earlier document or place has."""
    return suffix_dedup.cut_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens; every window holds the sources in operator 4's target proportions.

    A null source is a queue of its own, a null text its end token alone; columns beyond those of documents aren't read.
    """
    return packing.pack(docs, temperature=packing.TEMPERATURE)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_exact_copies),
    ("simhash_dedup", without_near_copies),
    ("suffix_dedup", without_repeats),
    ("packing", packed),
]
#: A fitted model, XXH64 and a tokenizer have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
