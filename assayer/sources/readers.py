"""Readers of the file kinds a study leaves behind. Every schema is given, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = (
    "scan_uid string, patient_id string, series_id string, source string, anatomy string, schema_version string, "
    "acquisition struct<manufacturer:string,model:string,kvp:double,slice_thickness_mm:double,pixel_spacing_mm:array<double>>, "
    "demographics struct<age_years:int,sex:string>, provenance struct<canonical_patient_key:string,n_slices:int>"
)
RESULTS = "model string, start long, per_seed map<string,struct<per_dose:map<string,struct<cnr:array<double>,patient_id:array<string>>>>>"
#: Words that stand for a missing digest.
PLACEHOLDERS = ("", "-", "TBD", "N/A", "NONE", "PENDING")


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file, or one a line, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines give no rows."""
    return spark.read.schema(schema).json(path)


def result_vectors(spark: SparkSession, path: str) -> DataFrame:
    """model, seed, dose, pos, patient_id, cnr: the aligned vectors of nested result documents as rows."""
    docs = spark.read.schema(RESULTS).json(path)
    seeds = docs.select("model", F.coalesce("start", F.lit(0)).alias("start"), F.explode("per_seed").alias("seed", "s"))
    doses = seeds.select("model", "start", "seed", F.explode("s.per_dose").alias("dose", "d"))
    rows = doses.select("model", "start", "seed", "dose", F.posexplode(F.arrays_zip("d.cnr", "d.patient_id")).alias("pos", "v"))
    return rows.select("model", "seed", "dose", (F.col("start") + F.col("pos")).alias("pos"), F.col("v.patient_id").alias("patient_id"), F.col("v.cnr").alias("cnr"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, digest of every file below a folder; hidden and build folders are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    cruft = F.exists(F.split("path", "/"), lambda x: x.startswith("__") | x.startswith(".") | x.isin("node_modules"))
    return f.where(~cruft).select("path", "length", F.sha2("content", 256).alias("sha256"))


def split_files(spark: SparkSession, path: str) -> DataFrame:
    """id, split: one id a line, the split named by the file; blank lines are dropped."""
    t = spark.read.option("recursiveFileLookup", True).text(path).select(F.trim("value").alias("id"), F.col("_metadata.file_path").alias("file"))
    return t.where("id <> ''").select("id", F.regexp_extract("file", r"(?:split=)?(train|val|test)[./]", 1).alias("split"))


def split_table(spark: SparkSession, path: str) -> DataFrame:
    """The fixed split source: trimmed, rows without an id dropped."""
    t = spark.read.schema("patient_id string, split string, source string").option("header", True).csv(path)
    return t.select(*(F.trim(c).alias(c) for c in t.columns)).where("patient_id <> ''")


def clean_digest(text: Column) -> Column:
    """Upper case; null for placeholders and anything that isn't 64 hexadecimal digits."""
    up = F.upper(F.trim(text))
    return F.when(~up.isin(*PLACEHOLDERS) & up.rlike("^[0-9A-F]{64}$"), up)


def asset_manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, digest from three line forms: a table row, ``DIGEST  name`` and ``name=DIGEST``."""
    v = F.trim(F.col("value"))
    cells = F.transform(F.split(v, r"\|"), F.trim)
    row = v.startswith("|")
    name = F.when(row, F.get(cells, 1)).when(v.rlike("^[0-9a-fA-F]{64}\\s"), F.regexp_extract(v, r"^\S+\s+(.*)$", 1)).otherwise(F.regexp_extract(v, r"^([^=]+)=", 1))
    text = F.when(row, F.get(cells, F.size(cells) - 2)).when(v.rlike("^[0-9a-fA-F]{64}\\s"), F.regexp_extract(v, r"^(\S+)", 1)).otherwise(F.regexp_extract(v, r"=(.*)$", 1))
    out = spark.read.text(path).select(F.trim(name).alias("name"), clean_digest(text).alias("digest"))
    return out.where("name <> '' and name not in ('name', '---') and not name rlike '^-+$'")


def digest_manifest(spark: SparkSession, path: str) -> DataFrame:
    """digest, path from lines of a digest, two spaces and a path."""
    line = r"^([0-9a-f]{64})  (.+)$"
    return spark.read.text(path).where(F.col("value").rlike(line)).select(F.regexp_extract("value", line, 1).alias("digest"), F.regexp_extract("value", line, 2).alias("path"))


_SESSION = (
    "servicingRadiologistID string, unblindedReadNodule array<struct<noduleID:string,characteristics:struct<texture:int>,"
    "roi:array<struct<imageZposition:double,inclusion:string,edgeMap:array<struct<xCoord:int,yCoord:int>>>>>>"
)


def reader_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row a (reader, nodule, slice): z, box from the edge points, texture, inclusion; repeated reader ids get _2, _3."""
    from pyspark.sql import Window

    s = spark.read.format("xml").option("rowTag", "readingSession").schema(_SESSION).load(path)
    s = s.select(F.col("_metadata.file_name").alias("file"), F.coalesce(F.nullif(F.trim("servicingRadiologistID"), F.lit("")), F.lit("reader")).alias("base"), "unblindedReadNodule")
    k = F.row_number().over(Window.partitionBy("file", "base").orderBy(F.to_json("unblindedReadNodule")))
    s = s.withColumn("k", k).withColumn("reader", F.concat("base", F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise("")))
    n = s.select("file", "reader", F.explode("unblindedReadNodule").alias("n"))
    r = n.select("file", "reader", F.col("n.noduleID").alias("nodule"), F.col("n.characteristics.texture").alias("texture"), F.explode("n.roi").alias("r"))
    x, y = F.col("r.edgeMap.xCoord"), F.col("r.edgeMap.yCoord")
    box = F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))
    return r.select("file", "reader", "nodule", "texture", F.col("r.imageZposition").alias("z"), F.col("r.inclusion").alias("inclusion"), box.alias("box"))
