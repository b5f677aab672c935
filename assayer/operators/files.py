"""Sources and sinks over files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.preparation import split_bucket, split_name
from assayer.operators.ranks import positions, ranges
from assayer.operators.registry import query
from assayer.plans.store import Scratch
from assayer.sources import readers, writers
from assayer.sources.tables import table


def _new(spark: SparkSession) -> str:
    return Scratch(spark, "files").root


@query("SELECT c_custkey::VARCHAR AS patient_id, c_mktsegment AS source, n_nationkey::INT AS n_slices FROM customer JOIN nation ON c_nationkey = n_nationkey")
def src1_series_metadata_scan(spark: SparkSession, folder: str) -> DataFrame:
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    docs = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").cast("string").alias("patient_id"), F.col("c_mktsegment").alias("source"), F.struct(F.col("n_nationkey").alias("n_slices")).alias("provenance"))
    docs.write.json(path := _new(spark))
    return readers.json_lines(spark, path, readers.SERIES).select("patient_id", "source", "provenance.n_slices")


@query(
    "SELECT c_custkey::VARCHAR AS id, CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'val' ELSE 'test' END AS split FROM (SELECT c_custkey, list_reduce(list_transform(string_split(sha256('42:' || c_custkey), ''), lambda d: (instr('0123456789abcdef', d) - 1)::BIGINT), lambda a, d: (a * 16 + d) % 100) AS b FROM customer)"
)
def src5_split_file_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Split lists written by the sink and read back."""
    ids = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("id"), split_name(split_bucket(F.col("c_custkey"))).alias("split"))
    writers.write_splits(ids, path := _new(spark))
    return readers.split_files(spark, path)


@query("SELECT c_custkey::VARCHAR AS patient_id, c_mktsegment AS split, 'customer' AS source FROM customer WHERE c_custkey % 10 <> 0")
def src6_split_csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    rows = c.select(F.when(c.c_custkey % 10 == 0, " ").otherwise(F.concat(F.lit(" "), c.c_custkey.cast("string"))).alias("patient_id"), F.col("c_mktsegment").alias("split"), F.lit("customer ").alias("source"))
    rows.write.option("header", True).csv(path := _new(spark))
    return readers.split_table(spark, path)


@query("SELECT 'doc' || doc_id AS name, CASE WHEN doc_id % 4 <> 3 THEN upper(sha256(text)) END AS digest FROM documents")
def src7_asset_manifest_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest in its three line forms, with placeholders."""
    name, h = F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.sha2("text", 256)
    kind = F.col("doc_id") % 4
    line = F.when(kind == 0, F.concat(F.lit("| "), name, F.lit(" | 1 | src | "), h, F.lit(" |"))).when(kind == 1, F.concat(h, F.lit("  "), name)).when(kind == 2, F.concat(name, F.lit("="), h)).otherwise(F.concat(name, F.lit("=TBD")))
    table(spark, folder, "documents").select(line).write.text(path := _new(spark))
    return readers.asset_manifest(spark, path)


@query("SELECT sha256(text) AS digest, 'd/' || doc_id AS path FROM documents")
def src8_sha_manifest_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest sink and its reader."""
    files = table(spark, folder, "documents").select(F.sha2("text", 256).alias("sha256"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"))
    writers.write_manifest(files, path := _new(spark))
    return readers.digest_manifest(spark, path)


@query("SELECT event_id, event_type, value FROM events")
def src9_audit_jsonl_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Audit rows appended in two writes."""
    e, path = table(spark, folder, "events").select("event_id", "event_type", "value"), _new(spark)
    writers.append_audit(e.where("event_id % 2 = 0"), path)
    writers.append_audit(e.where("event_id % 2 = 1"), path)
    return readers.json_lines(spark, path, "event_id long, event_type string, value double")


@query("SELECT p_brand AS model, (l_linenumber % 2)::VARCHAR AS seed, l_returnflag AS dose, row_number() OVER (PARTITION BY p_brand, l_linenumber % 2, l_returnflag ORDER BY l_orderkey, l_partkey, l_extendedprice, l_linenumber, l_quantity) - 1 AS pos, l_suppkey::VARCHAR AS patient_id, l_quantity AS cnr FROM lineitem JOIN part ON l_partkey = p_partkey")
def src10_result_docs_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Nested result documents, seed -> dose -> aligned vectors, as rows again."""
    line, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    order = ["l_orderkey", "l_partkey", "l_extendedprice", "l_linenumber", "l_quantity"]
    rows = line.join(part, line.l_partkey == part.p_partkey).select(F.col("p_brand").alias("model"), (F.col("l_linenumber") % 2).cast("string").alias("seed"), F.col("l_returnflag").alias("dose"), *order, F.col("l_suppkey").cast("string").alias("patient_id"), F.col("l_quantity").alias("cnr"))
    placed = positions(rows, ["model", "seed", "dose"], order, ranges(line, "l_orderkey"), "pos")
    writers.write_results(placed, path := _new(spark))
    return readers.result_vectors(spark, path)


@query("SELECT url, CASE WHEN regexp_matches(lower(url), 'full|fd') THEN 'full' WHEN regexp_matches(lower(url), 'quarter|low|ld') THEN 'low' ELSE 'unknown' END AS role, page_id FROM pages")
def src11_path_classify(spark: SparkSession, folder: str) -> DataFrame:
    from assayer.operators.preparation import path_classes

    return table(spark, folder, "pages").select("url", path_classes(F.col("url"))["role"].alias("role"), "page_id")


@query("SELECT l_orderkey AS series, l_linenumber AS slice, l_extendedprice AS v, l_returnflag AS split FROM lineitem")
def src13_volume_slice_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Slices stored by split and read back; a reader's conditions on split and series prune folders and row groups."""
    s = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("slice"), F.col("l_extendedprice").alias("v"), F.col("l_returnflag").alias("split"))
    writers.write_slices(s, path := _new(spark), ["split"], ["series", "slice"])
    return spark.read.schema("series long, slice int, v double, split string").parquet(path)


@query("SELECT source AS kind, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source")
def src15_corpus_record_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Records by type with count and size."""
    return table(spark, folder, "documents").groupBy(F.col("source").alias("kind")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"))


@query("SELECT p_partkey, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_name\":\"' || p_name || '\",\"p_partkey\":' || p_partkey || '}') AS sha256 FROM part")
def snk1_metadata_sink(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return writers.write_metadata(p, _new(spark), "p_type").select("p_partkey", "sha256")


@query("SELECT event_id, CASE WHEN value < 20 THEN value END AS value FROM events")
def snk7_table_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Non-finite numbers are null in what is written."""
    e = table(spark, folder, "events").select("event_id", F.when(F.col("value") < 20, F.col("value")).when(F.col("value") < 40, float("inf")).otherwise(float("nan")).alias("value"))
    writers.finite_table(e).write.json(path := _new(spark))
    return readers.json_lines(spark, path, "event_id long, value double")


@query("SELECT 'failed' AS written, count(*) AS n FROM orders WHERE NOT (o_totalprice > 20000)")
def snk8_board_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Violations keep the board from being written; they are written beside it."""
    from assayer.operators.gates import violations

    o, path = table(spark, folder, "orders"), _new(spark)
    kind = writers.write_board(o, violations(o, "o_orderkey", {"price": "o_totalprice > 20000"}), path)
    return spark.read.parquet(f"{path}/{kind}").agg(F.lit(kind).alias("written"), F.count("*").alias("n"))
