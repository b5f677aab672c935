"""The package's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import collocations, conversations, decontaminate, html, licenses, minhash, packing, quality, rans, sharding, suffix_dedup, toxicity, warc
from assayer.llm.sql import SQL as SQL
from assayer.llm.tokens import public_path
from assayer.plans.store import Scratch
from assayer.sources.tables import table


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = Scratch(spark, "warc-archive").root
    warc.write(table(spark, folder, "pages"), archive)
    return warc.read(spark, archive).drop("url")


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.verdicts(quality.clean(table(spark, folder, "documents")))


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), n_words=3, percent=85)


def op4_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Beside the counts the text that is left; a character that a cut runs through is marked as broken."""
    found = suffix_dedup.dedup(table(spark, folder, "documents"))
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_path("word_bpe_49k.json"), with_ids=False)


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.verdicts(decontaminate.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return toxicity.verdicts(toxicity.score(documents, toxicity.fit(documents, table(spark, folder, "labels"))))


def op8_token_rans(spark: SparkSession, folder: str) -> DataFrame:
    files = Scratch(spark, "token-files").root
    rans.write(table(spark, folder, "documents"), public_path("byte_bpe_50k.json"), files)
    return rans.read(spark, files, with_ids=False)


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(table(spark, folder, "pages"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.report(conversations.repair(conversations.damage(table(spark, folder, "conversations"))))


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.shards(table(spark, folder, "documents"), ["source", "lang", "n_chars"], n_shards=40)
    return found.withColumns({"law": F.lit("bytes"), "slot": F.col("slot").cast("long"), "grown_shard": F.lit(None).cast("int")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_quality_rules,
        op3_minhash_near_dedup,
        op4_suffix_array_dedup,
        op5_best_fit_packing,
        op6_benchmark_decontamination,
        op7_toxicity,
        op8_token_rans,
        op9_license_scan,
        op10_html_extraction,
        op11_conversation_repair,
        op12_phrase_collocations,
        op13_sharding,
    )
}
