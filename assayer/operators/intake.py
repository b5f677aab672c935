"""Scans, sinks and streams run over the tables: what a source reads is what Spark wrote from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.gates import METADATA
from assayer.operators.agreement import KAPPA_WINDOWS, timed_ratings
from assayer.operators.registry import query
from assayer.operators.summaries import rounded
from assayer.plans.store import Scratch
from assayer.sources import readers, writers
from assayer.sources.tables import table
from assayer.streaming import flows


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of its files; a pattern, as a plain path must be a folder."""
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}[.]parquet")


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, count(*) OVER () > 1 AS has_file FROM supplier")
def src2_json_dir_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of files with one object each, and the file's name beside it."""
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    writers.json_files(s, "id", path := Scratch(spark, "files").root)
    read = readers.json_objects(spark, path, "id long, name string, balance double")
    return read.select("id", "name", "balance", F.col("file").endswith(".json").alias("has_file"))


@query("SELECT octet_length(encode(text || chr(10)))::BIGINT AS length, sha256(text || chr(10)) AS sha256 FROM benchmark WHERE text IS NOT NULL")
def src3_file_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below a folder with its length and digest; Spark's own marker files begin with a sign that scans leave out."""
    b = table(spark, folder, "benchmark").where("text is not null").select("text")
    b.write.option("maxRecordsPerFile", 1).text(f"{(path := Scratch(spark, 'files').root)}/d")
    return readers.files(spark, path).where(~F.col("path").endswith("_SUCCESS")).select("length", "sha256")


@query("SELECT 'r' || event_id AS reader, 'n' || user_id AS nodule, (event_id % 5 + 1)::INT AS texture, value AS z, CASE WHEN event_id % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS inclusion, (event_id % 100)::INT AS x0, (user_id % 50)::INT AS y0, (event_id % 100 + 9)::INT AS x1, (user_id % 50 + 4)::INT AS y1 FROM events WHERE value IS NOT NULL")
def src4_reader_xml_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of up to 500 readers' sessions in XML, one record a (reader, nodule, slice), the box from the edge's points."""
    i, u = F.col("event_id"), F.col("user_id")
    point = lambda dx, dy: F.concat(F.lit("<edgeMap><xCoord>"), (i % 100 + dx).cast("string"), F.lit("</xCoord><yCoord>"), (u % 50 + dy).cast("string"), F.lit("</yCoord></edgeMap>"))
    roi = F.concat(F.lit("<roi><imageZposition>"), F.col("value").cast("string"), F.lit("</imageZposition><inclusion>"), F.when(i % 2 == 0, "TRUE").otherwise("FALSE"), F.lit("</inclusion>"), point(0, 4), point(9, 0), F.lit("</roi>"))
    nodule = F.concat(F.lit("<unblindedReadNodule><noduleID>n"), u.cast("string"), F.lit("</noduleID><characteristics><texture>"), (i % 5 + 1).cast("string"), F.lit("</texture></characteristics>"), roi, F.lit("</unblindedReadNodule>"))
    session = F.concat(F.lit("<readingSession><servicingRadiologistID>r"), i.cast("string"), F.lit("</servicingRadiologistID>"), nodule, F.lit("</readingSession>"))
    docs = table(spark, folder, "events").where("value is not null").groupBy(F.floor(i / 500).alias("doc")).agg(F.array_join(F.collect_list(session), "").alias("s"))
    docs.select(F.concat(F.lit("<LidcReadMessage>"), "s", F.lit("</LidcReadMessage>"))).write.option("maxRecordsPerFile", 1).text(path := Scratch(spark, "files").root)
    return readers.reader_xml(spark, path).select("reader", "nodule", "texture", "z", "inclusion", "box.*")


@query("SELECT l_returnflag AS split, count(*) AS n, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_returnflag")
def snk2_slice_store_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Slices stored by split; two of them are read back, of which the scan opens no other folder."""
    s = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("slice"), F.col("l_extendedprice").alias("v"), F.col("l_returnflag").alias("split"))
    writers.write_slices(s, path := Scratch(spark, "files").root, ["split"], ["series", "slice"])
    back = spark.read.schema("series long, slice int, v double, split string").parquet(path).where(F.col("split").isin("A", "R"))
    return back.groupBy("split").agg(F.count("*").alias("n"), F.min("series").alias("first"), F.max("series").alias("last"))


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'closed', 1")
def snk4_audit_append(spark: SparkSession, folder: str) -> DataFrame:
    """Appending leaves what is there."""
    path = Scratch(spark, "files").root
    e = table(spark, folder, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    writers.append_audit(e, path)
    writers.append_audit(spark.range(1).select(F.lit("closed").alias("kind"), F.lit(1).alias("n")), path)
    return readers.json_lines(spark, path, "kind string, n long")


@query("SELECT CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'val' ELSE 'test' END AS split, count(*) AS n, min(o_orderkey::VARCHAR) AS first, max(o_orderkey::VARCHAR) AS last FROM orders GROUP BY split")
def snk5_split_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted id lists by split."""
    k = F.col("o_orderkey") % 10
    o = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(k < 6, "train").when(k < 8, "val").otherwise("test").alias("split"))
    writers.write_splits(o, path := Scratch(spark, "files").root)
    return readers.split_files(spark, path).groupBy("split").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("SELECT sha256(html) || '  ' || url || '#' || page_id AS line FROM pages WHERE html IS NOT NULL AND url IS NOT NULL")
def snk6_manifest_sink(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest's lines as they stand in its files."""
    p = table(spark, folder, "pages").where("html is not null and url is not null")
    writers.write_manifest(p.select(F.sha2("html", 256).alias("sha256"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path")), path := Scratch(spark, "files").root)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("WITH v AS (" + " UNION ALL ".join(f"SELECT o_orderkey, '{n}' AS rule FROM orders WHERE NOT coalesce({held}, false)" for n, held in METADATA.items()) + ") SELECT o_orderkey, rule FROM v UNION ALL SELECT o_orderkey, 'on the board' FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM v)")
def st1_submission_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Arriving submissions, gated batch by batch: the board's, and those turned away with each rule they break."""
    s = Scratch(spark, "stream")
    flows.submission_stream(_stream(spark, folder, "orders"), "o_orderkey", METADATA, s.path("board"), s.path("failed"), s.path("state")).trigger(availableNow=True).start().awaitTermination()
    schema = table(spark, folder, "orders").schema
    board = spark.read.schema(schema).parquet(s.path("board")).select("o_orderkey", F.lit("on the board").alias("rule"))
    failed = spark.read.schema(schema.add("rule", "string")).parquet(s.path("failed")).select("o_orderkey", "rule")
    return board.union(failed)


from assayer.operators.resampling import U_SQL  # noqa: E402


@query(f"SELECT event_id, event_type FROM events WHERE {U_SQL.format(u='event_id', b='7')} < 0.25")
def st2_thin_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream thinned: the same events stay as in a batch."""
    s = Scratch(spark, "stream")
    e = flows.thin_stream(_stream(spark, folder, "events").select("event_id", "event_type"), "event_id", 0.25)
    e.writeStream.format("parquet").option("path", s.path("out")).option("checkpointLocation", s.path("state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, event_type string").parquet(s.path("out"))


@query("SELECT event_type AS reader, count(*) // 50 AS n_windows FROM events GROUP BY event_type HAVING count(*) >= 50")
def st3_reader_drift_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Full windows of a reader's cases; which cases share one is a matter of their arrival, how many there are is not."""
    s = Scratch(spark, "stream")
    cases = _stream(spark, folder, "events").select(F.col("event_type").alias("reader"), F.coalesce(F.col("value") > 10, F.lit(False)).alias("ok"))
    flows.drift_stream(cases, "reader", "ok").writeStream.format("parquet").outputMode("append").option("path", s.path("out")).option("checkpointLocation", s.path("state")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("reader string, window long, share double, paused boolean").parquet(s.path("out"))
    return out.groupBy("reader").agg(F.count("*").alias("n_windows"))


@query(f"WITH {KAPPA_WINDOWS.format(more=' AND epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events WHERE value IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL)')} SELECT reader, win AS window, n::BIGINT AS n, round(kappa, 6) AS kappa, kappa < 0.6 AS paused FROM k WHERE n = 50")
def st3_kappa_drift_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The windows of readers' cases that the watermark has passed, the same in any order of arrival; those of the last hour still wait."""
    s = Scratch(spark, "stream")
    cases = timed_ratings(_stream(spark, folder, "events"))
    found = flows.kappa_drift_stream(cases, "reader", "ts", "event_id", "a", "b", "1 hour")
    found.writeStream.format("parquet").outputMode("append").option("path", s.path("out")).option("checkpointLocation", s.path("state")).trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema("reader string, window long, n long, kappa double, paused boolean").parquet(s.path("out")), ["kappa"])
