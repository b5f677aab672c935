"""Building and reading back records: rescaled slices, harmonised marks, submissions, audit rows, credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.curves import _CURVE, _LEVEL, _curve, knee
from assayer.operators.greedy import followers
from assayer.operators.matching import _BOX, _BOXES, _boxes, nearest, overlapping
from assayer.operators.preparation import equivalence_verdict
from assayer.operators.registry import query
from assayer.operators.resampling import CHECKED, M_SQL, REPLICATES, percentile_ci, replicate_means
from assayer.operators.summaries import rounded
from assayer.plans.measures import SLICES, slices
from assayer.plans.store import Scratch
from assayer.sources.tables import table

#: Fields of a submission that are read, by kind.
FIDELITY, DETECTABILITY = ("psnr_db", "ssim"), ("cnr_mean", "bander_roi")
SCHEMA_VERSION = "1.0"


def hu_rescale(pixels: Column, slope: Column, intercept: Column, source: Column, offsets: dict[str, float]) -> Column:
    """Stored values to units: slope and intercept of the slice, then what its source is known to be off by."""
    return F.transform(pixels, lambda v: v * slope + intercept + offset_of(source, offsets))


def offset_of(source: Column, offsets: dict[str, float]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)), source), F.lit(0.0))


def discriminating_value(metrics: Column, fields: tuple[str, ...]) -> Column:
    """The first number among the declared fields of a JSON object; truth values and texts are none."""
    found = F.try_parse_json(metrics)

    def number(field: str) -> Column:
        value = F.try_variant_get(found, f"$.{field}", "variant")
        is_number = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        return F.when(is_number, F.try_variant_get(found, f"$.{field}", "double"))

    return F.coalesce(*map(number, fields))


def paired_methods(submissions: DataFrame, key: str, body: str) -> DataFrame:
    """(key, name, fidelity and detectability fields, task): one row a method of a submission, from any of its three layouts.

    ``validation.paired_methods`` by name, one block in ``validation``, or a flat object.
    """
    numbers = lambda fields: ", ".join(f"{f}: double" for f in fields)
    said = "task: string, task_label: string, label: string"
    det = f"detectability: struct<{numbers(DETECTABILITY)}, {said}>"
    block = f"struct<{numbers(FIDELITY)}, {det}>"
    form = f"struct<validation: struct<paired_methods: map<string, {block}>, method: string, {numbers(FIDELITY)}, {det}>, method: string, {numbers(FIDELITY + DETECTABILITY)}, {said}>"
    read = submissions.select(key, F.from_json(body, form).alias("d"))
    task = lambda at: F.coalesce(*(F.nullif(F.col(f"{at}{n}"), F.lit("")) for n in ("task", "task_label", "label"))).alias("task")
    several, one = F.size("d.validation.paired_methods") > 0, F.col("d.validation.psnr_db").isNotNull() | F.col("d.validation.detectability").isNotNull()
    several, one = F.coalesce(several, F.lit(False)), F.coalesce(one, F.lit(False))

    def rows(source: DataFrame, name: Column, fidelity: str, detectability: str) -> DataFrame:
        return source.select(key, name.alias("name"), *(F.col(fidelity + f).alias(f) for f in FIDELITY), *(F.col(detectability + f).alias(f) for f in DETECTABILITY), task(detectability))

    many = read.where(several).select(key, F.explode("d.validation.paired_methods").alias("_name", "_block"))
    single = lambda c: F.coalesce(F.col(c), F.lit("submission"))
    out = rows(many, F.col("_name"), "_block.", "_block.detectability.")
    out = out.unionByName(rows(read.where(~several & one), single("d.validation.method"), "d.validation.", "d.validation.detectability."))
    return out.unionByName(rows(read.where(~several & ~one), single("d.method"), "d.", "d."))


def along_axis(position: list[Column], row: list[Column], col: list[Column]) -> Column:
    """A slice's place along the normal of its own plane; a plane without one is an error."""
    normal = [row[(i + 1) % 3] * col[(i + 2) % 3] - row[(i + 2) % 3] * col[(i + 1) % 3] for i in range(3)]
    size = F.sqrt(sum((n * n for n in normal[1:]), normal[0] * normal[0]))
    dot = sum((p * n for p, n in zip(position[1:], normal[1:], strict=True)), position[0] * normal[0])
    return F.when(size < 1e-9, F.raise_error(F.lit("orientation without a normal")).cast("double")).otherwise(dot / size)


def box_to_mm(rois: DataFrame, grid: DataFrame, series: str, spacing: tuple[float, float], texture: int = 3) -> DataFrame:
    """Marks (series, id, z, x0, y0, x1, y1, texture) on their nearest slice, with the larger side in mm; marks without z are dropped."""
    on = nearest(rois.where(F.col("z").isNotNull()), grid, [series], "z", "position").where(F.col("nearest").isNotNull())
    side = F.greatest((F.col("x1") - F.col("x0")) * spacing[1], (F.col("y1") - F.col("y0")) * spacing[0])
    return on.select(series, "id", F.col("nearest").alias("slice"), F.round(side, 3).alias("diameter_mm"), F.coalesce("texture", F.lit(texture)).alias("texture"))


def audit_row(scan: Column, source: Column, hits: Column) -> Column:
    """One row of the audit log: any hit holds the scan back for review."""
    ocr = F.struct(F.lit(0).alias("slices_scanned"), F.size(hits).alias("hits"), hits.alias("hit_detail"))
    return F.struct(scan.alias("scan_uid"), source.alias("source"), ocr.alias("stage2_ocr"), F.when(F.size(hits) > 0, "held_for_review").otherwise("pass").alias("result"))


def build_metadata(series: DataFrame, offsets: dict[str, float], model: str, ratios: tuple[float, ...], seed: int) -> DataFrame:
    """Adds ``meta``, the versioned record of a series: header fields with their defaults, calibration, simulation, provenance."""
    uid = F.substring(F.sha2(F.concat(F.col("series_id").cast("string"), F.lit(SCHEMA_VERSION)), 256), 1, 16)
    acquisition = F.struct(
        F.coalesce("manufacturer", F.lit("")).alias("manufacturer"), "kvp", F.coalesce("slice_thickness_mm", F.lit(0.0)).alias("slice_thickness_mm"),
        F.coalesce("pixel_spacing_mm", F.lit([1.0, 1.0])).alias("pixel_spacing_mm"), F.lit([1, 0, 0, 0, 1, 0]).alias("image_orientation_patient"),
    )
    simulation = F.struct(F.lit(model).alias("model"), F.lit(list(ratios)).alias("ratios"), F.lit(seed).alias("seed"))
    provenance = F.struct("n_slices", uid.alias("deident_audit_id"), F.coalesce(F.nullif("canonical_key", F.lit("")), F.col("patient_id").cast("string")).alias("canonical_patient_key"))
    calibration = F.struct(offset_of(F.col("source"), offsets).alias("hu_offset"), F.lit("uniform_fallback").alias("bowtie_profile"))
    meta = F.struct(
        uid.alias("scan_uid"), "patient_id", "series_id", "source", F.lit(SCHEMA_VERSION).alias("schema_version"), acquisition.alias("acquisition"),
        calibration.alias("calibration"), simulation.alias("lowdose_sim"), provenance.alias("provenance"),
    )
    return series.withColumn("meta", meta)


def consolidate_readers(marks: DataFrame, by: list[str], least: float = 0.3, fraction: float = 0.5) -> DataFrame:
    """Marks (by, reader, id, x0, y0, x1, y1, diameter, texture) of one slice fused to one where more than ``fraction`` of its case's readers agree.

    In order of reader and id, an unused mark leads and takes every unused one that overlaps it by ``least``; boxes and diameters are
    medians. Leaders are found in rounds over the overlaps, so a slice's marks are the work of many tasks. The first of ``by`` is the case,
    whose readers are counted.
    """
    # the row's number tells marks apart that repeat reader and id
    numbered = marks.withColumn("id", F.struct("reader", "id", F.monotonically_increasing_id().alias("row")))
    m = Scratch(marks.sparkSession, "marks").keep(numbered, "numbered")
    met = overlapping(m, m, by, _BOX).where((F.col("overlap") >= least) & (F.col("a") < F.col("b")))
    taken = followers(met.select(*by, F.col("a").alias("lo"), F.col("b").alias("hi")), by)
    led = m.join(taken.withColumnRenamed("member", "id"), [*by, "id"], "left").withColumn("leader", F.coalesce("leader", "id"))
    middle = [F.median(F.col(c).cast("double")).alias(c) for c in (*_BOX, "diameter")]
    fused = led.groupBy(*by, "leader").agg(*middle, F.median("texture").cast("long").alias("texture"), F.countDistinct("reader").alias("n_contributing"))
    readers = marks.groupBy(by[0]).agg(F.countDistinct("reader").alias("n_readers"))
    return fused.join(readers, by[0]).where(F.col("n_contributing") > fraction * F.col("n_readers")).select(*by, *_BOX, "diameter", "texture", "n_contributing")


def discordant(a: DataFrame, b: DataFrame, by: str, least: float = 0.3, ratio: float = 1.5) -> DataFrame:
    """Cases of two readers: marks that overlap none of the other's, sizes apart by ``ratio``, different textures; any of these refers the case.

    a, b: marks (by, id, x0, y0, x1, y1, diameter, texture).
    """
    more = ["diameter", "texture"]
    pairs = overlapping(a, b, [by], _BOX, more).where(F.col("overlap") >= least)
    apart = F.greatest("a_diameter", "b_diameter") >= ratio * F.least("a_diameter", "b_diameter")
    of_pairs = pairs.groupBy(by).agg(F.countDistinct("a").alias("met_a"), F.countDistinct("b").alias("met_b"), F.max(apart).alias("sizes"), F.max(F.col("a_texture") != F.col("b_texture")).alias("textures"))
    count = lambda x, n: x.groupBy(by).agg(F.count("*").alias(n))
    out = count(a, "n_a").join(count(b, "n_b"), by).join(of_pairs, by, "left")
    lone = F.col("n_a") - F.coalesce("met_a", F.lit(0)) + F.col("n_b") - F.coalesce("met_b", F.lit(0))
    no = F.lit(False)
    out = out.select(by, lone.alias("lone"), F.coalesce("sizes", no).alias("sizes"), F.coalesce("textures", no).alias("textures"))
    return out.withColumn("discordant", (F.col("lone") > 0) | F.col("sizes") | F.col("textures"))


def write_annotations(marks: DataFrame, path: str) -> None:
    """A folder a reader, whose name keeps letters, digits, - and _."""
    safe = F.regexp_replace("reader", r"[^\p{L}\p{N}_-]", "_")
    marks.withColumn("reader_folder", safe).write.partitionBy("reader_folder").mode("overwrite").json(path)


def folder_splits(spark: SparkSession, path: str) -> DataFrame:
    """(patient, split) as the folders {split}/{source}/{patient} say, whatever the files hold."""
    return spark.read.option("basePath", path).parquet(path).select("patient", "split").distinct()


def credentials(rows: DataFrame, by: list[str], unit: str, reduced: str, full: str, margin: float, replicates: int = REPLICATES) -> DataFrame:
    """One credential a stratum: means, interval of the mean difference, verdict. Units are resampled whole."""
    units = rows.groupBy(*by, unit).agg(F.sum(F.col(reduced) - F.col(full)).alias("t"), F.count("*").alias("c"))
    ci = percentile_ci(replicate_means(units, by, unit, "t", "c", replicates), by)
    means = rows.groupBy(*by).agg(F.avg(reduced).alias("reduced_mean"), F.avg(full).alias("full_mean"), F.avg(F.col(reduced) - F.col(full)).alias("diff_mean"), F.count("*").alias("n_slices"))
    return means.join(ci, by).withColumn("verdict", equivalence_verdict(F.col("low"), F.col("high"), margin))


@query("SELECT l_orderkey, l_linenumber, [l_quantity * 2 - 1024 + CASE l_returnflag WHEN 'R' THEN 12.5 WHEN 'A' THEN -3.0 ELSE 0 END, l_linenumber * 2 - 1024 + CASE l_returnflag WHEN 'R' THEN 12.5 WHEN 'A' THEN -3.0 ELSE 0 END] AS hu FROM lineitem WHERE l_linenumber <> 7")
def prj1_hu_rescale(spark: SparkSession, folder: str) -> DataFrame:
    """Slices without pixels, as an undecodable one is, are dropped."""
    rows = table(spark, folder, "lineitem").withColumn("px", F.when(F.col("l_linenumber") != 7, F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double"))))
    hu = hu_rescale(F.col("px"), F.lit(2.0), F.lit(-1024.0), F.col("l_returnflag"), {"R": 12.5, "A": -3.0})
    return rows.where("px is not null").select("l_orderkey", "l_linenumber", hu.alias("hu"))


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = o_custkey % 7 + 1")
def prj16_nodules_for_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The marks on the slice that is asked for."""
    asked = table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 7 + 1).alias("z"))
    marks = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return asked.join(marks, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linenumber") == F.col("z"))).select("o_orderkey", "l_linenumber", "l_partkey")


@query("SELECT event_id, CASE event_id % 5 WHEN 2 THEN event_id + 0.5 WHEN 4 THEN NULL ELSE event_id::DOUBLE END AS value FROM events")
def prj17_discriminating_value(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("event_id").cast("string")
    first = F.when(F.col("event_id") % 5 == 0, "true").when(F.col("event_id") % 5 == 1, '"7"').when(F.col("event_id") % 5 == 2, F.concat(i, F.lit(".5"))).otherwise("null")
    second = F.when(F.col("event_id") % 5 == 4, '"none"').otherwise(i)
    metrics = F.concat(F.lit('{"bander_roi": '), first, F.lit(', "cnr_mean": '), second, F.lit("}"))
    return table(spark, folder, "events").select("event_id", discriminating_value(metrics, ("bander_roi", "cnr_mean")).alias("value"))


@query(
    "WITH p AS (SELECT p_partkey AS k, p_size::DOUBLE AS s, p_partkey % 3 AS layout FROM part) "
    "SELECT k, m.name, s + m.plus AS psnr_db, NULL::DOUBLE AS ssim, s / 2 AS cnr_mean, NULL::DOUBLE AS bander_roi, 'liver' AS task FROM p, (VALUES ('one', 0), ('two', 1)) m(name, plus) WHERE layout = 0 "
    "UNION ALL SELECT k, 'submission', s, 0.5, NULL, s, 'lung' FROM p WHERE layout = 1 UNION ALL SELECT k, 'flat', s, NULL, s * 2, NULL, NULL FROM p WHERE layout = 2"
)
def prj19_paired_extract(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    block = lambda plus: F.concat(F.lit('{"psnr_db": '), (F.col("p_size") + plus).cast("string"), F.lit(', "detectability": {"cnr_mean": '), (F.col("p_size") / 2).cast("string"), F.lit(', "task": "", "label": "liver"}}'))
    several = F.concat(F.lit('{"validation": {"paired_methods": {"one": '), block(0), F.lit(', "two": '), block(1), F.lit("}}}"))
    one = F.concat(F.lit('{"validation": {"psnr_db": '), s, F.lit(', "ssim": 0.5, "detectability": {"bander_roi": '), s, F.lit(', "task_label": "lung"}}}'))
    flat = F.concat(F.lit('{"method": "flat", "psnr_db": '), s, F.lit(', "cnr_mean": '), (F.col("p_size") * 2).cast("string"), F.lit("}"))
    body = F.when(F.col("p_partkey") % 3 == 0, several).when(F.col("p_partkey") % 3 == 1, one).otherwise(flat)
    return paired_methods(table(spark, folder, "part").select(F.col("p_partkey").alias("k"), body.alias("body")), "k", "body")


@query("SELECT l_orderkey, l_linenumber, round((-l_discount * l_quantity - l_tax * l_linenumber + l_extendedprice) / sqrt(l_discount * l_discount + l_tax * l_tax + 1), 6) AS position FROM lineitem")
def prj22_along_axis_position(spark: SparkSession, folder: str) -> DataFrame:
    one, none = F.lit(1.0), F.lit(0.0)
    at = along_axis([F.col("l_quantity"), F.col("l_linenumber"), F.col("l_extendedprice")], [one, none, F.col("l_discount")], [none, one, F.col("l_tax")])
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(at, 6).alias("position"))


@query(f"{_CURVE}, h AS (SELECT vendor, method, min_by(x0 + ({_LEVEL} - y0) / (y - y0) * (dose - x0), dose) AS hit FROM p WHERE y >= {_LEVEL} AND y0 < {_LEVEL} GROUP BY ALL), g AS (SELECT vendor, method, min_by(y, dose) AS y1, min(dose) AS x1 FROM c GROUP BY ALL) SELECT vendor, method, round(abs(CASE WHEN y1 >= {_LEVEL} THEN x1 ELSE hit END - 0.25) / 0.25, 6) AS error FROM g LEFT JOIN h USING (vendor, method)")
def prj28_equivalent_dose_error(spark: SparkSession, folder: str) -> DataFrame:
    """How far the dose at which a measured curve reaches its level lies from the predicted one, as a share of that."""
    at = knee(_curve(spark, folder), ["vendor", "method"], "dose", "y", _LEVEL)
    return at.select("vendor", "method", F.round(F.abs(F.col("knee") - 0.25) / 0.25, 6).alias("error"))


@query(f"SELECT o_orderkey AS series_id, substr(sha256(o_orderkey::VARCHAR || '{SCHEMA_VERSION}'), 1, 16) AS scan_uid, CASE o_orderstatus WHEN 'F' THEN 12.5 ELSE 0 END AS hu_offset, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE o_orderpriority END AS manufacturer, o_custkey::VARCHAR AS patient_key, 3 AS n_ratios, o_custkey % 9 AS n_slices FROM orders")
def prj29_build_metadata(spark: SparkSession, folder: str) -> DataFrame:
    series = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("series_id"), F.col("o_custkey").alias("patient_id"), F.col("o_orderstatus").alias("source"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")).alias("manufacturer"),
        F.lit(None).cast("double").alias("kvp"), F.lit(None).cast("double").alias("slice_thickness_mm"), F.lit(None).cast("array<double>").alias("pixel_spacing_mm"), (F.col("o_custkey") % 9).alias("n_slices"), F.lit("").alias("canonical_key"),
    )
    m = build_metadata(series, {"F": 12.5}, "in-repository", (0.1, 0.25, 0.5), 42)
    return m.select("series_id", "meta.scan_uid", "meta.calibration.hu_offset", "meta.acquisition.manufacturer", F.col("meta.provenance.canonical_patient_key").alias("patient_key"), F.size("meta.lowdose_sim.ratios").alias("n_ratios"), "meta.provenance.n_slices")


@query("WITH g AS (SELECT DISTINCT l_orderkey AS series, l_linenumber::DOUBLE AS p FROM lineitem), z AS (SELECT o_orderkey AS series, o_custkey AS id, (o_custkey % 80) / 10 AS z, o_custkey % 13 + 1 AS w, o_orderkey % 11 + 1 AS h FROM orders WHERE o_orderkey % 11 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(p - z), p) AS k FROM z JOIN g USING (series)) SELECT series, id, p AS slice, round(greatest(w * 0.7::DOUBLE, h * 0.8::DOUBLE), 3) AS diameter_mm, CASE WHEN series % 5 = 0 THEN 3 ELSE 1 END AS texture FROM r WHERE k = 1")
def prj30_box_to_mm(spark: SparkSession, folder: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rois = table(spark, folder, "orders").select(
        k.alias("series"), c.alias("id"), F.when(k % 11 != 0, (c % 80) / 10).alias("z"), F.lit(5).alias("x0"), F.lit(7).alias("y0"),
        (c % 13 + 6).alias("x1"), (k % 11 + 8).alias("y1"), F.when(k % 5 != 0, 1).alias("texture"),
    )
    grid = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("position"))
    return box_to_mm(rois, grid, "series", (0.8, 0.7))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]{6,}')) AS hits, CASE WHEN len(regexp_extract_all(text, '[0-9]{6,}')) > 0 THEN 'held_for_review' ELSE 'pass' END AS result FROM documents")
def prj31_audit_row(spark: SparkSession, folder: str) -> DataFrame:
    row = audit_row(F.col("doc_id").cast("string"), F.col("source"), F.regexp_extract_all("text", F.lit("[0-9]{6,}"), 0))
    return table(spark, folder, "documents").select("doc_id", row.alias("row")).select("doc_id", F.col("row.stage2_ocr.hits").alias("hits"), F.col("row.result").alias("result"))


@query("SELECT DISTINCT l_linenumber::INT AS patient, l_returnflag AS split FROM lineitem")
def src12_layout_partition_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("split"), F.col("l_linestatus").alias("source"), F.col("l_linenumber").alias("patient"), F.col("l_orderkey").alias("series"))
    path = Scratch(spark, "layout").path("volumes")
    rows.repartition("split", "source", "patient").write.partitionBy("split", "source", "patient").parquet(path)
    return folder_splits(spark, path)


@query("SELECT regexp_replace(event_type || ' #1', '[^A-Za-z0-9_-]', '_', 'g') AS reader, count(*) AS n, count(DISTINCT user_id) AS n_patients FROM events GROUP BY 1")
def snk3_annotation_sink(spark: SparkSession, folder: str) -> DataFrame:
    marks = table(spark, folder, "events").select(F.concat("event_type", F.lit(" #1")).alias("reader"), F.col("user_id").alias("patient"), F.col("event_id").alias("id"))
    path = Scratch(spark, "annotations").path("raw_per_reader")
    write_annotations(marks, path)
    back = spark.read.schema("reader string, patient long, id long, reader_folder string").json(path)
    return back.groupBy(F.col("reader_folder").alias("reader")).agg(F.count("*").alias("n"), F.countDistinct("patient").alias("n_patients"))


_STRATA = f"WITH {SLICES}, u AS (SELECT vendor, dose, series, sum(score_a - score_b) AS t, count(*) AS c FROM s GROUP BY ALL), b AS (SELECT vendor, dose, r.b, {M_SQL.format(u='series', b='r.b')} AS m, t, c FROM u, (SELECT unnest(range({CHECKED})) AS b) r), m AS (SELECT vendor, dose, b, sum(m * t) / sum(m * c) AS mean FROM b WHERE m > 0 GROUP BY ALL), ci AS (SELECT vendor, dose, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM m GROUP BY ALL), d AS (SELECT vendor, dose, avg(score_a) AS reduced, avg(score_b) AS full_, avg(score_a - score_b) AS diff, count(*) AS n FROM s GROUP BY ALL)"
_VERDICT = "CASE WHEN low > -0.6 AND high < 0.6 THEN 'PASS' WHEN low > 0.6 OR high < -0.6 THEN 'FAIL' ELSE 'INDETERMINATE' END AS verdict"


@query(f"{_STRATA} SELECT vendor, dose, round(reduced, 6) AS reduced_mean, round(full_, 6) AS full_mean, round(diff, 6) AS diff_mean, n AS n_slices, round(low, 6) AS low, round(high, 6) AS high, {_VERDICT} FROM ci JOIN d USING (vendor, dose)")
def bs15_task_credential(spark: SparkSession, folder: str) -> DataFrame:
    """Equivalence on detectability: the interval of the paired difference within the margin, with the summary means."""
    out = credentials(slices(spark, folder), ["vendor", "dose"], "series", "score_a", "score_b", 0.6, CHECKED)
    return rounded(out, ["reduced_mean", "full_mean", "diff_mean", "low", "high"])


@query(f"{_STRATA} SELECT 'detection' AS task, dose, vendor, n AS n_slices, {_VERDICT} FROM ci JOIN d USING (vendor, dose)")
def snk10_credential_store(spark: SparkSession, folder: str) -> DataFrame:
    """Credentials stored by task and dose; the index over all strata is the stored table read back."""
    found = credentials(slices(spark, folder), ["vendor", "dose"], "series", "score_a", "score_b", 0.6, CHECKED).withColumn("task", F.lit("detection"))
    path = Scratch(spark, "credentials").path("store")
    found.write.partitionBy("task", "dose").parquet(path)
    return spark.read.schema(found.schema).parquet(path).select("task", "dose", "vendor", "n_slices", "verdict")


def _marks(spark: SparkSession, folder: str, reader: str) -> DataFrame:
    return _boxes(spark, folder, reader).withColumn("diameter", F.col("x1") - F.col("x0")).withColumn("texture", F.col("id") % 5)


@query(f"WITH {_BOXES}, m AS (SELECT *, x1 - x0 AS d, id % 5 AS t FROM b), p AS (SELECT a.slice, a.id AS a, b.id AS b, a.d AS da, b.d AS db, a.t AS ta, b.t AS tb, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i, a.d * a.d + b.d * b.d AS s FROM m a JOIN m b ON a.slice = b.slice AND a.reader = 'click' AND b.reader = 'view'), q AS (SELECT slice, count(DISTINCT a) AS ma, count(DISTINCT b) AS mb, bool_or(greatest(da, db) >= 1.5 * least(da, db)) AS sizes, bool_or(ta <> tb) AS textures FROM p WHERE i / (s - i)::DOUBLE >= 0.3 GROUP BY slice), n AS (SELECT slice, count(*) FILTER (reader = 'click') AS na, count(*) FILTER (reader = 'view') AS nb FROM m GROUP BY slice) SELECT slice, na - coalesce(ma, 0) + nb - coalesce(mb, 0) AS lone, coalesce(sizes, false) AS sizes, coalesce(textures, false) AS textures, na - coalesce(ma, 0) + nb - coalesce(mb, 0) > 0 OR coalesce(sizes, false) OR coalesce(textures, false) AS discordant FROM n LEFT JOIN q USING (slice) WHERE na > 0 AND nb > 0")
def win13_discordance(spark: SparkSession, folder: str) -> DataFrame:
    return discordant(_marks(spark, folder, "click"), _marks(spark, folder, "view"), "slice")


@query()
def ag6_consolidate_readers(spark: SparkSession, folder: str) -> DataFrame:
    """The pass over leaders is not for SQL; a test holds it against a plain one."""
    readers = [_marks(spark, folder, r).withColumn("reader", F.lit(r)) for r in ("click", "view", "purchase")]
    marks = readers[0].union(readers[1]).union(readers[2]).withColumn("z", F.col("id") % 11)
    return consolidate_readers(marks, ["slice", "z"])
