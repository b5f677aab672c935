"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import decontaminate, minhash, packing, suffix_dedup, toxicity
from assayer.llm.tokens import public_path
from assayer.plans.ship import ship
from assayer.plans.store import Scratch
from assayer.sources.tables import table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at a half or more go."""
    ship(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (five-word shingles, similarity of 0.8 or more) the least doc_id stays."""
    ship(spark)
    return minhash.first_of_each(docs, n_words=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a 400-byte string covers which also starts elsewhere are cut out of the texts; every document stays."""
    ship(spark)
    return suffix_dedup.without_repeats(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule condemns go; the others stay as they are."""
    ship(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    ship(spark)
    return packing.pack(docs, public_path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("toxicity", without_toxic),
    ("MinHash near-dedup", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", clean_of_benchmark),
    ("best-fit packing", pack),
]

#: Trained scores, signatures and tokenizers are outside SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs
