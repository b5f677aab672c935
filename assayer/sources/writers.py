"""Sinks: every write is one Spark job with its own committer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(fields: list[str]) -> Column:
    return F.to_json(F.struct(*sorted(fields)))


def write_metadata(series: DataFrame, path: str, by: str) -> DataFrame:
    """Sorted-key JSON lines by partition; gives back each row's digest."""
    line = canonical_json([c for c in series.columns if c != by])
    series.select(by, line.alias("value")).write.partitionBy(by).mode("overwrite").text(path)
    return series.select("*", F.sha2(line, 256).alias("sha256"))


def write_slices(slices: DataFrame, path: str, by: list[str], order: list[str]) -> None:
    """Parquet by split and source, rows in slice order, so that reads prune folders and row groups; a split is many files."""
    slices.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).write.partitionBy(*by).mode("overwrite").parquet(path)


def write_results(rows: DataFrame, path: str, block: int = 4096) -> None:
    """Nested result documents of (model, seed, dose, pos, patient_id, cnr): one holds ``block`` positions of a model, from ``start``."""
    at = (F.floor(F.col("pos") / block) * block).alias("start")
    v = F.array_sort(F.collect_list(F.struct("pos", "cnr", "patient_id")))
    g = rows.groupBy("model", at, "seed", "dose").agg(v.alias("v"))
    vectors = F.struct(F.transform("v", lambda x: x["cnr"]).alias("cnr"), F.transform("v", lambda x: x["patient_id"]).alias("patient_id"))
    d = g.groupBy("model", "start", "seed").agg(F.map_from_entries(F.collect_list(F.struct("dose", vectors))).alias("per_dose"))
    docs = d.groupBy("model", "start").agg(F.map_from_entries(F.collect_list(F.struct("seed", F.struct("per_dose")))).alias("per_seed"))
    docs.write.mode("overwrite").json(path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_splits(assigned: DataFrame, path: str) -> None:
    """Sorted id lists, a folder a split; the order holds inside range partitions and their files."""
    assigned.select("split", F.col("id").alias("value")).repartitionByRange("split", "value").sortWithinPartitions("split", "value").write.partitionBy("split").mode("overwrite").text(path)


def write_manifest(files: DataFrame, path: str) -> None:
    """Digest, two spaces and path, in path order."""
    line = F.concat("sha256", F.lit("  "), "path").alias("value")
    files.repartitionByRange("path").sortWithinPartitions("path").select(line).write.mode("overwrite").text(path)


def finite_table(rows: DataFrame) -> DataFrame:
    """Non-finite numbers become null, as JSON has none."""
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c)
    return rows.select(*(ok(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes))


def write_board(board: DataFrame, violations: DataFrame, path: str) -> str:
    """The board if no gate objects, else the violations beside it; gives back which."""
    if violations.isEmpty():
        board.write.mode("overwrite").parquet(f"{path}/board")
        return "board"
    violations.write.mode("overwrite").parquet(f"{path}/failed")
    return "failed"


def json_files(rows: DataFrame, key: str, path: str, in_folder: int = 256) -> None:
    """One file a row, some ``in_folder`` in each folder below ``path``: many tasks write them, and a reader lists the folders side by side."""
    n = -(-rows.count() // in_folder) or 1
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(n))).repartition(n, "part")
    dealt.write.option("maxRecordsPerFile", 1).partitionBy("part").json(path)
