"""Content-addressed WARC archive.

``payloads`` holds every distinct payload once, under its SHA-256; ``headers`` holds the exact header bytes (WARC block
and HTTP block) of every record and the address of its payload. A reader recomputes the address of the stored bytes,
joins them to their headers, puts every record together again as a WARC file holds it, and fails if a rebuilt record's
lengths or digest differ from what its own header declares. Records of equal payloads of at least ``least`` bytes are one response (the largest
page_id) and revisits that refer to it.

Defined results: null html is an empty payload; a null url writes no target line; line breaks in a url are
percent-encoded; rows that repeat the response's page_id and payload are responses too; a record with a null page_id
refers to the response or, if no row of its group has an id, is a response; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.plans.store import Scratch

LEAST = 1000
HEADERS = "header binary, payload_sha256 string"
PAYLOADS = "sha256 string, payload binary"
#: Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")


def _header() -> Column:
    """The header bytes of a record from page_id, url, bytes, sha1, revisit, response."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("bytes").cast("string"), F.lit(_END + _END))
    body = F.when(F.col("revisit"), F.length(http)).otherwise(F.length(http) + F.col("bytes"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.encode(
        F.concat(
            F.lit(f"WARC/1.1{_END}WARC-Type: "),
            F.when(F.col("revisit"), "revisit").otherwise("response"),
            F.lit(f"{_END}WARC-Record-ID: <urn:page:"),
            F.coalesce(F.col("page_id").cast("string"), F.lit("")),
            F.lit(f">{_END}"),
            F.coalesce(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit(_END)), F.lit("")),
            F.lit("WARC-Payload-Digest: sha1:"),
            F.col("sha1"),
            F.lit(_END),
            F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("response").cast("string"), F.lit(f">{_END}WARC-Profile: {_PROFILE}{_END}"))).otherwise(""),
            F.lit(f"Content-Type: application/http; msgtype=response{_END}Content-Length: "),
            body.cast("string"),
            F.lit(_END + _END),
            http,
        ),
        "UTF-8",
    )


def write(pages: DataFrame, folder: str, least: int = LEAST) -> None:
    """Writes the archive of ``pages`` (page_id, url, html)."""
    scratch = Scratch(pages.sparkSession, "warc")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("payload"))
    source.select(F.sha2("payload", 256).alias("sha256"), "payload").dropDuplicates(["sha256"]).write.option("compression", "zstd").parquet(f"{folder}/payloads")
    records = source.select("page_id", "url", F.sha2("payload", 256).alias("payload_sha256"), F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("bytes"))
    records = scratch.keep(records, "records")
    groups = records.where(F.col("bytes") >= least).groupBy("payload_sha256").agg(F.max("page_id").alias("response"), F.count("*").alias("many"))
    groups = scratch.keep(groups.where("many > 1 and response is not null").select("payload_sha256", "response"), "groups")
    told = records.join(groups, "payload_sha256", "left")
    told = told.withColumn("revisit", F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")))
    told.select(_header().alias("header"), "payload_sha256").write.option("compression", "zstd").parquet(f"{folder}/headers")


def _verified(spark: SparkSession, folder: str) -> DataFrame:
    """The stored payloads by an address recomputed from their bytes."""
    stored = spark.read.schema(PAYLOADS).parquet(f"{folder}/payloads")
    address = F.sha2("payload", 256)
    checked = F.when(address == F.col("sha256"), address).otherwise(F.raise_error(F.lit("payload differs from its address")))
    return stored.select(checked.alias("payload_sha256"), "payload")


def _field(name: str) -> Column:
    """A header field's value, empty if the field is absent."""
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload, record].

    ``record`` is the exact record as a WARC file holds it: header, block, two line ends. A revisit's block has no payload;
    its payload is that of the record it refers to. All is told from rebuilt records, whether they are returned or not.
    """
    headers = spark.read.schema(HEADERS).parquet(f"{folder}/headers")
    joined = headers.join(_verified(spark, folder), "payload_sha256", "left")
    text = F.decode("header", "UTF-8")
    # The header is the WARC block up to an empty line and the HTTP block up to the next.
    named = joined.withColumn("type", _field("WARC-Type")).withColumn("http", F.octet_length(F.substring_index(text, _END + _END, -2)))
    lengths = F.regexp_extract_all(text, F.lit(r"\r\nContent-Length: (\d+)\r\n"), 1)
    named = named.withColumn("declared", F.get(lengths, F.lit(0)).cast("long")).withColumn("payload_bytes", F.get(lengths, F.lit(1)).cast("long"))
    block = F.when(F.col("type") == "response", F.col("payload")).otherwise(F.lit(b""))
    rebuilt = named.withColumn("record", F.concat("header", block, F.lit((_END + _END).encode())))
    # Where the record says its payload stands: behind the header, as many bytes as the HTTP block declares.
    own = F.when(F.col("type") == "response", F.substring("record", F.octet_length("header") + 1, F.col("payload_bytes").cast("int"))).otherwise(F.col("payload"))
    length = F.octet_length("record") - F.octet_length("header") + F.col("http") - 4
    rebuilt = rebuilt.withColumn("sha1", F.sha1(own)).withColumn("whole", (length == F.col("declared")) & (F.octet_length("payload") == F.col("payload_bytes")))
    digest = F.when(F.col("whole") & (F.concat(F.lit("sha1:"), "sha1") == _field("WARC-Payload-Digest")), F.col("sha1"))
    page = F.regexp_extract(_field("WARC-Record-ID"), r"<urn:page:(-?\d*)>", 1)
    refers = F.regexp_extract(_field("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1)
    return rebuilt.select(
        F.when(page != "", page).cast("long").alias("page_id"),
        F.when(_field("WARC-Target-URI") != "", _field("WARC-Target-URI")).alias("url"),
        "payload_bytes",
        F.coalesce(digest, F.raise_error(F.lit("rebuilt record differs from its header"))).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(refers != "", refers).cast("long").alias("refers_to"),
        *["payload", "record"] * with_payload,
    )
