"""A deposit's folder read by its listing: typed records, counts and sizes by type, and what records lack. No content is read.

A path is a tree, a method (baselines only), a vendor, a scan, a level and a name, each plain or as ``key=value``; a name may be one
file or a folder of part files, which count as one file. Defined results: a path outside of this layout has nulls for the record's
keys and counts as ``other``; Spark lists no empty files, so an empty one neither counts nor meets a requirement; repeated listings of one path count once for each.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.registry import query
from assayer.plans.store import Scratch
from assayer.sources.tables import table

KEYS = ["tree", "method", "vendor", "scan", "level"]
_K = r"(?:\w+=)?"
_LAYOUT = rf"^{_K}(reconstructions|baselines)/(?:{_K}([^/]+)/)?{_K}([^/]+)/{_K}([^/]+)/{_K}(r\d{{3}})/{_K}([^/]+?)(?:/part-[^/]*)?$"
_PARTS = r"/part-[^/]*$"
#: The level that has no error map.
FULL = "r100"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path below ``root``, length; only the listing is read."""
    below = re.sub(r"^\w+:/+(?=/)", "", root.rstrip("/"))
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return f.select(F.element_at(F.split("path", re.escape(below) + "/", 2), -1).alias("path"), "length")


def typed(files: DataFrame) -> DataFrame:
    """tree, method, vendor, scan, level, name, bytes: a row a file, part files added up."""
    at = lambda i: F.nullif(F.regexp_extract("path", _LAYOUT, i), F.lit(""))
    whole = files.groupBy(F.regexp_replace("path", _PARTS, "/").alias("file"), *(at(i).alias(k) for i, k in enumerate([*KEYS, "name"], 1)))
    one = whole.agg(F.sum("length").alias("bytes"), F.count("*").alias("_n"))
    # a folder of parts is one file, a plain file one for each time it is listed
    return one.select(*KEYS, F.coalesce("name", F.lit("other")).alias("name"), "bytes", F.when(F.col("file").endswith("/"), 1).otherwise(F.col("_n")).alias("n"))


def by_type(records: DataFrame) -> DataFrame:
    """name, n, bytes, n_records, n_scans."""
    g = records.groupBy("name", *KEYS).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    s = g.groupBy("name", "vendor", "scan").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("level").alias("records"))
    return s.groupBy("name").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sum("records").alias("n_records"), F.count("scan").alias("n_scans"))


def lacking(records: DataFrame, full: Sequence[str], reduced: Sequence[str]) -> DataFrame:
    """(record's keys, name) of every required file a record lacks; what is required depends on its level. No join: a flag a name."""
    names = sorted({*full, *reduced})
    flags = {n: F.max((F.col("name") == n).cast("int")).alias(f"_{i}") for i, n in enumerate(names)}
    held = records.where("level is not null").groupBy(*KEYS).agg(F.count("*").alias("_all"), *flags.values())
    is_full = F.col("level") == FULL

    def lacks(i: int, n: str) -> Column:
        needed = F.lit(n in full) & is_full | F.lit(n in reduced) & ~is_full
        return F.when(needed & (F.col(f"_{i}") == 0), F.lit(n))

    gaps = F.array_compact(F.array(*(lacks(i, n) for i, n in enumerate(names)))) if names else F.array().cast("array<string>")
    return held.select(*KEYS, F.explode(gaps).alias("name"))


def counts_differ(found: DataFrame, stored: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, stored, found) wherever a stored number is not the one found; a missing side counts as none."""
    f = found.select(F.col(key), *(F.col(c).cast("long").alias(f"f_{c}") for c in fields))
    s = stored.select(F.col(key), *(F.col(c).cast("long").alias(f"s_{c}") for c in fields))
    j = f.join(s, key, "full_outer")
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"s_{c}").alias("stored"), F.col(f"f_{c}").alias("found")) for c in fields))
    return j.select(key, F.explode(each).alias("d")).where(~F.col("d.stored").eqNullSafe(F.col("d.found"))).select(key, "d.*")


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the table as a deposit: written by record and name, then listed."""
    k = lambda c, n, p: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    level = F.when(F.col("l_returnflag") == "A", "r010").when(F.col("l_returnflag") == "N", "r025").otherwise(FULL)
    name = F.when(F.col("l_orderkey") % 3 == 0, "image").when((F.col("l_orderkey") % 3 == 1) & (level != FULL), "error_abs").otherwise("scan_meta")
    base = F.col("l_orderkey") % 2 == 1
    line = table(spark, folder, "lineitem").select(
        F.when(base, "baselines").otherwise("reconstructions").alias("tree"), F.when(base, k("l_partkey", 2, "m")).otherwise("none").alias("method"),
        k("l_linenumber", 3, "v").alias("vendor"), k("l_suppkey", 4, "s").alias("scan"), level.alias("level"), name.alias("name"), F.col("l_orderkey").cast("string").alias("value"),
    )
    some = line.where(~((F.col("name") == "image") & (F.col("vendor") == "v1") & (F.col("scan") == "s2") & (F.col("level") == "r010")))
    by = [*KEYS, "name"]
    some.repartition(*by).write.partitionBy(*by).text(path := Scratch(spark, "corpus").root)
    return typed(listing(spark, path))


_LINES = """l AS (SELECT CASE WHEN l_orderkey % 2 = 1 THEN 'baselines' ELSE 'reconstructions' END AS tree, CASE WHEN l_orderkey % 2 = 1 THEN 'm' || (l_partkey % 2) ELSE 'none' END AS method,
'v' || (l_linenumber % 3) AS vendor, 's' || (l_suppkey % 4) AS scan, CASE l_returnflag WHEN 'A' THEN 'r010' WHEN 'N' THEN 'r025' ELSE 'r100' END AS level, l_orderkey AS o, length(l_orderkey::VARCHAR) + 1 AS bytes FROM lineitem),
w AS (SELECT *, CASE WHEN o % 3 = 0 THEN 'image' WHEN o % 3 = 1 AND level <> 'r100' THEN 'error_abs' ELSE 'scan_meta' END AS name FROM l),
f AS (SELECT tree, method, vendor, scan, level, name, sum(bytes) AS bytes FROM w WHERE NOT (name = 'image' AND vendor = 'v1' AND scan = 's2' AND level = 'r010') GROUP BY ALL)"""


@query(f"WITH {_LINES} SELECT name, count(*) AS n, sum(bytes)::BIGINT AS bytes, count(*) AS n_records, count(DISTINCT (vendor, scan)) AS n_scans FROM f GROUP BY name")
def src15_corpus_tree_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files by type with count, size, records and scans, from the listing alone."""
    return by_type(_written(spark, folder))


@query(
    f"WITH {_LINES}, r AS (SELECT DISTINCT tree, method, vendor, scan, level FROM f), n AS (SELECT unnest(['image', 'scan_meta', 'error_abs']) AS name) "
    "SELECT r.*, n.name FROM r, n WHERE NOT (n.name = 'error_abs' AND r.level = 'r100') AND NOT EXISTS (SELECT 1 FROM f WHERE f.tree = r.tree AND f.method = r.method AND f.vendor = r.vendor AND f.scan = r.scan AND f.level = r.level AND f.name = n.name)"
)
def jn6_corpus_lacking(spark: SparkSession, folder: str) -> DataFrame:
    """Required files that records lack; full-dose records need no error map."""
    return lacking(_written(spark, folder), ["image", "scan_meta"], ["image", "scan_meta", "error_abs"])
