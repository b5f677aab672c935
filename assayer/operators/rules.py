"""Rules on names, paths, headers, declarations and bundles: each an operator with its rule as a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.board import finite
from assayer.operators.matching import missing_parts
from assayer.operators.registry import query
from assayer.sources.tables import table

# Words, patterns and names of the data formats.
PREFIXES = ("lidc",)
ANATOMY = {"abdomen": ("ABDOMEN", "LIVER")}
ROLES = {"fd": ("FULL",), "ld": ("LOW",)}
DOMAINS = {"image": ("IMAGE",), "projection": ("PROJECTION",)}
RESTRICTED = (
    (r"(?i)(^|/)L[0-9]{3}_[^/]*\.(npy|npz)$", "patient pixel derivative"),
    (r"(?i)\.(dcm|dicom)$", "DICOM"),
    (r"(?i)(^|/)DICOMDIR$", "DICOM directory record"),
    (r"(?i)(^|/)(aapm|mayo)[^/]*\.(h5|hdf5)$", "harmonized HDF5"),
)
CRUFT_FOLDERS = ("__pycache__", ".git", ".pytest_cache", ".venv", "node_modules")
CRUFT_ENDINGS = (".pyc", ".pyo", ".egg-info", ".bak", ".legacy", ".flag", ".log.err")
DATE_KINDS = ("DA", "DT", "TM")
KEPT_KEYWORDS = (
    "SOPClassUID", "Modality", "Manufacturer", "ManufacturerModelName", "SeriesDescription", "KVP", "SliceThickness", "SpacingBetweenSlices",
    "DataCollectionDiameter", "ReconstructionDiameter", "DistanceSourceToDetector", "DistanceSourceToPatient", "GantryDetectorTilt", "TableHeight",
    "RotationDirection", "ExposureTime", "XRayTubeCurrent", "Exposure", "FilterType", "ConvolutionKernel", "SpiralPitchFactor",
    "ImagePositionPatient", "ImageOrientationPatient", "InstanceNumber", "PatientPosition", "Rows", "Columns", "PixelSpacing", "BitsAllocated",
    "BitsStored", "HighBit", "PixelRepresentation", "RescaleIntercept", "RescaleSlope", "RescaleType", "PixelData", "PatientSex", "PatientAge",
    "PatientSize", "PatientWeight", "BodyPartExamined", "StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID", "FrameOfReferenceUID",
)
UID_KEYWORDS = ("StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID", "FrameOfReferenceUID")
DENIED_TEXT = r"(?i)[0-9]{6,}|\bDOB\b|[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}|@"
RUNGS = (1, 2, 3, 4, 5, 6)
RUNG_STATES = ("done", "partial", "blocked")
ARTEFACTS = ("metal", "motion", "truncation", "ring_streak")
BUNDLE_FILES = ("method.json", "eval.py", "results.json")
PROTECTED_FILES = ("leaderboard.json", "heldout.json")
HELD_OUT, TRAINING = "heldout-split", "training-split"


def first_of(cases: list[tuple[Column, str]], other: str | None = None) -> Column:
    """The name of the first condition that holds; one that is null does not."""
    out = reduce(lambda c, case: c.when(case[0], case[1]), cases[1:], F.when(*cases[0]))
    return out.otherwise(F.lit(other))


def by_prefix(name: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """The first prefix that a trimmed name begins with, else the name itself; null counts as empty."""
    n = F.coalesce(F.trim(name), F.lit(""))
    return F.coalesce(first_of([(n.startswith(p), p) for p in prefixes]), n)


def by_words(text: Column, words: dict[str, tuple[str, ...]], other: str | None) -> Column:
    """The first label one of whose words, in capitals, occurs in the text in any case."""
    return first_of([(F.upper(text).contains(w), label) for label, many in words.items() for w in many], other)


def series_role(description: Column) -> Column:
    """(role, domain) by keywords; null unless both are told."""
    role, domain = by_words(description, ROLES, None), by_words(description, DOMAINS, None)
    return F.when(role.isNotNull() & domain.isNotNull(), F.struct(role.alias("role"), domain.alias("domain")))


def header_audit(elements: DataFrame, by: str, keyword: str, private: str, kind: str, kept: tuple[str, ...] = KEPT_KEYWORDS) -> DataFrame:
    """Per instance: private and unlisted elements that go, dates among the latter, identifiers that are hashed anew, and what stays."""
    is_private, listed = F.coalesce(F.col(private), F.lit(False)), F.coalesce(F.col(keyword).isin(*kept), F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    gone = ~is_private & ~listed
    return elements.groupBy(by).agg(n(is_private).alias("n_private"), n(gone).alias("n_unlisted"), n(gone & F.col(kind).isin(*DATE_KINDS)).alias("n_dates"), n(~is_private & F.col(keyword).isin(*UID_KEYWORDS)).alias("n_uids"), n(~is_private & listed).alias("n_kept"))


def refusal(path: Column, rules: tuple[tuple[str, str], ...] = RESTRICTED) -> Column:
    """The reason of the first pattern that a path matches, else null."""
    return first_of([(path.rlike(p), why) for p, why in rules])


def refuse(files: DataFrame, path: str, rules: tuple[tuple[str, str], ...] = RESTRICTED) -> DataFrame:
    """The files, if no rule refuses one; else an error that tells of one and of how many."""
    bad = files.withColumn("_why", refusal(F.col(path), rules)).where("_why is not null").agg(F.count("*").alias("n"), F.first(path).alias("p"), F.first("_why").alias("why")).first()
    if bad["n"]:
        raise ValueError(f"{bad['n']} restricted files, as {bad['p']}: {bad['why']}")
    return files


def cruft(path: Column, folders: tuple[str, ...] = CRUFT_FOLDERS, endings: tuple[str, ...] = CRUFT_ENDINGS) -> Column:
    """Whether a path lies in an excluded folder or has an excluded ending."""
    return F.exists(F.split(path, "/"), lambda x: x.isin(*folders)) | reduce(lambda a, b: a | b, (path.endswith(e) for e in endings))


def canonical_sha(object_: Column) -> Column:
    """SHA-256 of a flat map in compact form with sorted keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(object_)))), 256)


def scrub(text: Column, role: Column, denied: str = DENIED_TEXT) -> Column:
    """Free text that matches the denied pattern shrinks to its role."""
    return F.when(text.rlike(denied), role).otherwise(text)


def registry_problems(registries: DataFrame, rungs: DataFrame, key: str, required: tuple[int, ...] = RUNGS, states: tuple[str, ...] = RUNG_STATES) -> DataFrame:
    """(key, rung, problem) of registries with rows (key, rung, status, gate): missing rung, bad status, missing gate."""
    gone = missing_parts(registries.select(key), rungs.select(key, F.col("rung").alias("part")), key, list(required)).select(key, F.col("part").alias("rung"), F.lit("missing rung").alias("problem"))
    bad = F.array_compact(F.array(F.when(~F.coalesce(F.col("status").isin(*states), F.lit(False)), "bad status"), F.when(F.coalesce(F.trim("gate"), F.lit("")) == "", "missing gate")))
    return gone.unionByName(rungs.select(key, "rung", F.explode(bad).alias("problem")))


def artefact_problems(scores: DataFrame, key: str, classes: tuple[str, ...] = ARTEFACTS) -> DataFrame:
    """(key, artefact, problem) of rows (key, artefact, psnr, cnr): unknown class, duplicate, unpaired, not finite."""
    both = F.col("psnr").isNotNull() & F.col("cnr").isNotNull()
    known = F.coalesce(F.col("artefact").isin(*classes), F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    g = scores.groupBy(key, "artefact").agg(F.bool_and(known).alias("known"), F.count("*").alias("n"), n(~both).alias("half"), n(both & ~(finite(F.col("psnr")) & finite(F.col("cnr")))).alias("wild"))
    k = F.col("known")
    found = F.array_compact(F.array(F.when(~k, "unknown"), F.when(k & (F.col("n") > 1), "duplicate"), F.when(k & (F.col("half") > 0), "unpaired"), F.when(k & (F.col("wild") > 0), "not finite")))
    return g.select(key, "artefact", F.explode(found).alias("problem"))


def bundle_problems(names: DataFrame, key: str, name: str, required: tuple[str, ...], allowed: tuple[str, ...]) -> DataFrame:
    """Per bundle: required names that it lacks and names that are not allowed."""
    held = F.collect_set(F.when(F.col(name).isin(*required), F.col(name)))
    other = F.collect_set(F.when(~F.col(name).isin(*required, *allowed), F.col(name)))
    return names.groupBy(key).agg(F.array_sort(F.array_except(F.lit(list(required)), held)).alias("missing"), F.array_sort(other).alias("unknown"))


def publication_state(status: Column, failed: Column, receipt: Column, evidence: Column, stratum: Column) -> Column:
    """One of five states in fixed precedence: a published flag without a referee's evidence is not trusted."""
    s, no = F.lower(status), lambda c: ~F.coalesce(c, F.lit(False))
    cases = [(s == "rejected", "REJECTED"), (failed, "REJECTED"), (status.isNull() & no(receipt), "NO_CLAIM"), ((s == "published") & evidence, "PUBLISHED"), (s == "published", "INCOMPLETE"), (no(stratum), "MISSING_LAYER")]
    return first_of(cases, "INCOMPLETE")


def mentions(leaves: DataFrame, key: str, path: str, value: str, names: tuple[str, ...] = PROTECTED_FILES) -> DataFrame:
    """(key, path, place) of leaves whose key path or value mentions a protected name."""
    hit = lambda c: F.coalesce(reduce(lambda a, b: a | b, (F.col(c).contains(n) for n in names)), F.lit(False))
    return leaves.select(key, path, F.explode(F.array_compact(F.array(F.when(hit(path), "key"), F.when(hit(value), "value")))).alias("place"))


def provenance_state(declared: Column, held_out: str = HELD_OUT, training: str = TRAINING) -> Column:
    """Whether a validation may be published by the split it declares."""
    d = F.lower(declared)
    return first_of([(d.isNull(), "undeclared"), (d == training, "training"), (d != held_out, "unknown")], "accepted")


def pinned(named: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Named artefacts with role and version, the digest of their file, and whether there is none."""
    return named.join(files.select(path, "sha256"), path, "left").withColumn("missing", F.col("sha256").isNull())


def array_pairs(full: DataFrame, low: DataFrame, by: list[str]) -> DataFrame:
    """(by, state) of arrays with a ``shape`` each: paired, unpaired, or of different shapes."""
    f, w = full.select(*by, F.col("shape").alias("_f")), low.select(*by, F.col("shape").alias("_l"))
    j = f.join(w, by, "full_outer")
    return j.select(*by, first_of([(F.col("_f").isNull() | F.col("_l").isNull(), "unpaired"), (F.col("_f") != F.col("_l"), "shape")], "paired").alias("state"))


def described(descriptor: DataFrame, records: DataFrame, kind: str) -> DataFrame:
    """The deposit's descriptor filled from records (kind, bytes, detector): counts, bytes, and an error if detectors differ."""
    r = records.groupBy(kind).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.countDistinct("detector").alias("n_detectors"))
    out = descriptor.join(r, kind, "left").fillna(0, ["n", "bytes", "n_detectors"])
    return out.withColumn("error", F.col("n_detectors") > 1)


def records_of(owners: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Every owner with its number of records; one without any file has none."""
    n = records.groupBy(key).agg(F.count("*").alias("n_records"))
    return owners.select(key).join(n, key, "left").fillna(0, ["n_records"])


def _path(page: Column, url: Column) -> Column:
    k = F.lpad((page % 1000).cast("string"), 3, "0")
    made = {0: F.concat(F.lit("sim/L"), k, F.lit("_full.npy")), 1: F.concat(url, F.lit(".DCM")), 2: F.concat(F.lit("raw/"), k, F.lit("/DICOMDIR")), 3: F.concat(F.lit("d/mayo_"), k, F.lit(".h5")), 4: F.concat(F.lit("code/__pycache__/"), k, F.lit(".py")), 5: F.concat(F.lit("code/"), k, F.lit(".pyc"))}
    return reduce(lambda c, i: F.when(page % 8 == i, made[i]).otherwise(c), made, url)


_K = "lpad((page_id % 1000)::VARCHAR, 3, '0')"
_PATHS = f"p AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'sim/L' || {_K} || '_full.npy' WHEN 1 THEN url || '.DCM' WHEN 2 THEN 'raw/' || {_K} || '/DICOMDIR' WHEN 3 THEN 'd/mayo_' || {_K} || '.h5' WHEN 4 THEN 'code/__pycache__/' || {_K} || '.py' WHEN 5 THEN 'code/' || {_K} || '.pyc' ELSE url END AS path FROM pages)"


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", _path(F.col("page_id"), F.col("url")).alias("path"))


def _sql_list(names: tuple) -> str:
    return ", ".join(f"'{n}'" if isinstance(n, str) else str(n) for n in names)


@query("SELECT source, count(*) AS n FROM (SELECT CASE WHEN p_size % 3 = 0 THEN 'lidc' ELSE trim(p_name) END AS source FROM part) GROUP BY source")
def prj7_source_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Sources with a suffix to their name, and others."""
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" lidc (simulated from "), F.col("p_partkey").cast("string"), F.lit(")"))).otherwise(F.concat(F.col("p_name"), F.lit(" ")))
    return table(spark, folder, "part").groupBy(by_prefix(raw).alias("source")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 < 2 THEN 'abdomen' ELSE 'chest' END AS anatomy, CASE WHEN p_size % 5 IN (0, 1) THEN 'fd' WHEN p_size % 5 = 2 THEN 'ld' END AS role, CASE WHEN p_size % 5 IN (0, 2) THEN 'image' WHEN p_size % 5 = 1 THEN 'projection' END AS domain FROM part")
def prj9_anatomy_of(spark: SparkSession, folder: str) -> DataFrame:
    """Body parts and series descriptions by their words; a series without role or domain has neither."""
    k = F.col("p_size") % 4
    body = F.concat(F.col("p_type"), F.when(k == 0, " Liver").when(k == 1, " abdomen").otherwise(" lung"))
    said = F.get(F.lit(["Full dose images", "Full Dose Projections", "Low dose images", "full dose", "scout image"]), F.col("p_size") % 5)
    p = table(spark, folder, "part").select("p_partkey", by_words(body, ANATOMY, "chest").alias("anatomy"), series_role(said).alias("r"))
    return p.select("p_partkey", "anatomy", "r.role", "r.domain")


_WORDS = ("KVP", "StudyInstanceUID", "PatientName", "StudyDate", "Rows", "PatientBirthDate", "OperatorsName")
_HEADER = f"h AS (SELECT l_orderkey AS sop, [{_sql_list(_WORDS)}][l_linenumber % 7 + 1] AS kw, l_returnflag = 'R' AS pr, CASE WHEN l_linenumber % 7 IN (3, 5) THEN 'DA' ELSE 'LO' END AS vr FROM lineitem)"


@query(f"WITH {_HEADER} SELECT sop, count(*) FILTER (pr) AS n_private, count(*) FILTER (NOT pr AND kw NOT IN ('KVP', 'StudyInstanceUID', 'Rows')) AS n_unlisted, count(*) FILTER (NOT pr AND kw IN ('StudyDate', 'PatientBirthDate')) AS n_dates, count(*) FILTER (NOT pr AND kw = 'StudyInstanceUID') AS n_uids, count(*) FILTER (NOT pr AND kw IN ('KVP', 'StudyInstanceUID', 'Rows')) AS n_kept FROM h GROUP BY sop")
def prj10_header_whitelist(spark: SparkSession, folder: str) -> DataFrame:
    """Header elements by instance."""
    i = (F.col("l_linenumber") % 7).cast("int")
    h = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("sop"), F.get(F.lit(list(_WORDS)), i).alias("keyword"), (F.col("l_returnflag") == "R").alias("private"), F.when(i.isin(3, 5), "DA").otherwise("LO").alias("vr"))
    return header_audit(h, "sop", "keyword", "private", "vr")


@query(f"WITH {_PATHS} SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'patient pixel derivative' WHEN 1 THEN 'DICOM' WHEN 2 THEN 'DICOM directory record' ELSE 'harmonized HDF5' END AS reason FROM p WHERE page_id % 8 < 4")
def prj11_restricted_path(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that a rule refuses, with the first rule's reason."""
    return _paths(spark, folder).select("page_id", refusal(F.col("path")).alias("reason")).where("reason is not null")


@query(f"WITH {_PATHS} SELECT page_id, path FROM p WHERE page_id % 8 NOT IN (4, 5)")
def prj12_skip_cruft(spark: SparkSession, folder: str) -> DataFrame:
    """Paths without an excluded folder or ending."""
    return _paths(spark, folder).where(~cruft(F.col("path")))


@query("SELECT sha256('{\"k\":\"' || (props::JSON->>'k') || '\",\"type\":\"' || event_type || '\"}') AS sha, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY sha")
def prj18_canonical_json_sha(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of an object, whatever order its keys came in."""
    e = table(spark, folder, "events").where("props is not null")
    return e.groupBy(canonical_sha(F.create_map(F.lit("type"), "event_type", F.lit("k"), F.get_json_object("props", "$.k"))).alias("sha")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 3 < 2 THEN role ELSE text END AS description FROM conversations")
def prj33_free_text_scrub(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions, some with a date or a number of a record."""
    c, k = table(spark, folder, "conversations"), F.col("conv_id") % 3
    text = F.when(k == 0, F.concat("text", F.lit(" dob 1961-05-07"))).when(k == 1, F.concat("text", F.lit(" MRN 00123456"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", scrub(text, F.col("role")).alias("description"))


_RUNGS = "r AS (SELECT DISTINCT l_suppkey AS registry, l_linenumber AS rung, CASE l_linestatus WHEN 'O' THEN 'done' ELSE 'open' END AS status, CASE l_returnflag WHEN 'R' THEN ' ' ELSE 'g' END AS gate FROM lineitem WHERE l_quantity > 49)"


@query(f"WITH {_RUNGS} SELECT s_suppkey AS registry, w.rung, 'missing rung' AS problem FROM supplier CROSS JOIN (SELECT unnest([{_sql_list(RUNGS)}]) AS rung) w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.registry = s_suppkey AND r.rung = w.rung) UNION ALL SELECT registry, rung, 'bad status' FROM r WHERE status = 'open' UNION ALL SELECT registry, rung, 'missing gate' FROM r WHERE gate = ' '")
def gt13_registry_rules(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem").where("l_quantity > 49")
    r = line.select(F.col("l_suppkey").alias("registry"), F.col("l_linenumber").alias("rung"), F.when(F.col("l_linestatus") == "O", "done").otherwise("open").alias("status"), F.when(F.col("l_returnflag") == "R", " ").otherwise("g").alias("gate")).distinct()
    return registry_problems(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("registry")), r, "registry")


_CLASSES = ("metal", "motion", "ring_streak", "truncation", "halo")
_ARTEFACTS = f"a AS (SELECT user_id AS report, [{_sql_list(_CLASSES)}][event_id % 5 + 1] AS artefact, CASE WHEN event_id % 11 <> 0 THEN value END AS psnr, CASE WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE ELSE value END AS cnr FROM events), g AS (SELECT report, artefact, count(*) AS n, count(*) FILTER (psnr IS NULL OR cnr IS NULL) AS half, count(*) FILTER (psnr IS NOT NULL AND cnr IS NOT NULL AND NOT (isfinite(psnr) AND isfinite(cnr))) AS wild FROM a GROUP BY ALL)"


@query(f"WITH {_ARTEFACTS} SELECT report, artefact, 'unknown' AS problem FROM g WHERE artefact = 'halo' UNION ALL SELECT report, artefact, 'duplicate' FROM g WHERE artefact <> 'halo' AND n > 1 UNION ALL SELECT report, artefact, 'unpaired' FROM g WHERE artefact <> 'halo' AND half > 0 UNION ALL SELECT report, artefact, 'not finite' FROM g WHERE artefact <> 'halo' AND wild > 0")
def gt14_artefact_rules(spark: SparkSession, folder: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    a = table(spark, folder, "events").select(F.col("user_id").alias("report"), F.get(F.lit(list(_CLASSES)), (i % 5).cast("int")).alias("artefact"), F.when(i % 11 != 0, v).alias("psnr"), F.when(i % 13 == 0, float("inf")).otherwise(v).alias("cnr"))
    return artefact_problems(a, "report")


_NAMES = ("method.json", "eval.py", "results.json", "Dockerfile", "notes.txt")


@query(f"WITH f AS (SELECT DISTINCT l_orderkey AS bundle, [{_sql_list(_NAMES)}][l_partkey % 5 + 1] AS name FROM lineitem), g AS (SELECT bundle, list(name) AS held FROM f GROUP BY bundle) SELECT bundle, list_sort(list_filter([{_sql_list(BUNDLE_FILES)}], lambda x: NOT list_contains(held, x))) AS missing, list_filter(held, lambda x: x = 'notes.txt') AS unknown FROM g")
def gt16_bundle_structure(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a bundle that are missing, and those that have no place there."""
    f = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("bundle"), F.get(F.lit(list(_NAMES)), (F.col("l_partkey") % 5).cast("int")).alias("name"))
    return bundle_problems(f, "bundle", "name", BUNDLE_FILES, ("Dockerfile", "dose_equivalence_credentials.json", "checkpoint"))


@query("SELECT o_orderkey AS board, CASE WHEN o_orderkey % 5 = 0 THEN 'REJECTED' WHEN o_totalprice < 5000 THEN 'REJECTED' WHEN o_orderkey % 5 = 1 AND o_orderstatus <> 'P' THEN 'NO_CLAIM' WHEN o_orderkey % 5 = 2 AND o_totalprice > 100000 THEN 'PUBLISHED' WHEN o_orderkey % 5 = 2 THEN 'INCOMPLETE' WHEN o_orderpriority = '5-LOW' THEN 'MISSING_LAYER' ELSE 'INCOMPLETE' END AS state FROM orders")
def gt19_publish_state(spark: SparkSession, folder: str) -> DataFrame:
    """The first state that applies, in fixed precedence."""
    k, price = F.col("o_orderkey") % 5, F.col("o_totalprice")
    status = F.when(k == 0, "Rejected").when(k == 2, "published").when(k > 2, "pending")
    state = publication_state(status, price < 5000, F.col("o_orderstatus") == "P", price > 100000, F.col("o_orderpriority") != "5-LOW")
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("board"), state.alias("state"))


@query("SELECT event_id, '$.' || CASE WHEN event_id % 7 = 0 THEN 'leaderboard.json' ELSE 'k' END AS path, 'key' AS place FROM events WHERE event_id % 7 = 0 UNION ALL SELECT event_id, '$.' || CASE WHEN event_id % 7 = 0 THEN 'leaderboard.json' ELSE 'k' END, 'value' FROM events WHERE event_id % 5 = 0")
def gt20_forbidden_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves whose key or value mentions a protected file."""
    i = F.col("event_id")
    path = F.concat(F.lit("$."), F.when(i % 7 == 0, "leaderboard.json").otherwise("k"))
    value = F.when(i % 5 == 0, F.concat(F.lit("../data/heldout.json#"), i.cast("string"))).otherwise(F.get_json_object("props", "$.k"))
    return mentions(table(spark, folder, "events").select("event_id", path.alias("path"), value.alias("value")), "event_id", "path", "value")


@query("SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'training' ELSE CASE WHEN l_linenumber = 1 THEN 'undeclared' ELSE 'unknown' END END AS state, count(*) AS n FROM lineitem GROUP BY state")
def gt21_provenance_declared(spark: SparkSession, folder: str) -> DataFrame:
    f = F.col("l_returnflag")
    said = F.when(f == "A", "Heldout-Split").when(f == "N", "training-split").when(F.col("l_linenumber") != 1, "mixed")
    return table(spark, folder, "lineitem").groupBy(provenance_state(said).alias("state")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT l_orderkey AS patient, l_linenumber % 4 AS slice, l_returnflag AS f, max(l_suppkey % 2) AS shape FROM lineitem GROUP BY ALL) SELECT patient, slice, CASE WHEN a.shape IS NULL OR b.shape IS NULL THEN 'unpaired' WHEN a.shape <> b.shape THEN 'shape' ELSE 'paired' END AS state FROM (SELECT * FROM r WHERE f = 'A') a FULL JOIN (SELECT * FROM r WHERE f = 'R') b USING (patient, slice)")
def src14_npy_pair_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Full and low arrays by patient and slice."""
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("patient"), (F.col("l_linenumber") % 4).alias("slice"), "l_returnflag").agg(F.max(F.col("l_suppkey") % 2).alias("shape"))
    return array_pairs(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"), ["patient", "slice"])


@query("SELECT c_custkey AS patient, coalesce(n, 0) AS n_records FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = c_custkey")
def src16_reader_tree_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Records a patient, written by patient and read back; a patient without a file has none."""
    from assayer.plans.store import Scratch

    e = table(spark, folder, "events").select(F.col("user_id").alias("patient"), F.col("event_type").alias("reader"), "value")
    e.write.partitionBy("reader").json(path := Scratch(spark, "files").root)
    read = spark.read.schema("patient long, value double, reader string").json(path)
    return records_of(table(spark, folder, "customer").select(F.col("c_custkey").alias("patient")), read, "patient")


@query("SELECT kind, coalesce(n, 0) AS n, coalesce(bytes, 0)::BIGINT AS bytes, coalesce(n_detectors, 0) AS n_detectors, coalesce(n_detectors, 0) > 1 AS error FROM (SELECT DISTINCT source AS kind FROM documents UNION ALL SELECT 'withdrawn') k LEFT JOIN (SELECT source AS kind, count(*) AS n, sum(n_chars) AS bytes, count(DISTINCT lang) AS n_detectors FROM documents GROUP BY source) r USING (kind)")
def snk9_metadata_fill(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select(F.col("source").alias("kind"), F.col("n_chars").alias("bytes"), F.col("lang").alias("detector"))
    kinds = d.select("kind").distinct().union(spark.range(1).select(F.lit("withdrawn")))
    return described(kinds, d, "kind").withColumn("bytes", F.col("bytes").cast("long"))


@query("SELECT 'd/' || page_id AS path, CASE WHEN page_id % 2 = 0 THEN 'table' ELSE 'figure' END AS role, sha256(text) AS sha256, text IS NULL AS missing FROM pages LEFT JOIN documents ON doc_id = page_id * 3")
def snk11_pinned_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Named artefacts with role and digest; those without a file are missing."""
    at = lambda c: F.concat(F.lit("d/"), c.cast("string")).alias("path")
    named = table(spark, folder, "pages").select(at(F.col("page_id")), F.when(F.col("page_id") % 2 == 0, "table").otherwise("figure").alias("role"))
    files = table(spark, folder, "documents").where("doc_id % 3 = 0").select(at((F.col("doc_id") / 3).cast("long")), F.sha2("text", 256).alias("sha256"))
    return pinned(named, files, "path")
