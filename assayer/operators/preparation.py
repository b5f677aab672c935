"""Preparation: ids, keys, splits, leakage, header rules, and scalar projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.operators.registry import query
from assayer.sources.tables import table


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def hex_decimal(digits: Column) -> Column:
    """A hexadecimal string of any length as a decimal string: base 1e9 limbs, folded eight digits at a time; null of null."""
    base = F.lit(1_000_000_000)
    none = F.array().cast("array<long>")

    def carry(s: Column, limb: Column) -> Column:
        v = limb * (1 << 32) + s["over"]
        return F.struct(F.array_append(s["out"], v % base).alias("out"), F.call_function("div", v, base).alias("over"))

    def step(limbs: Column, word: Column) -> Column:
        # 32 bits more need two limbs more at most, so nothing is left over
        return F.aggregate(F.concat(limbs, F.lit([0, 0]).cast("array<long>")), F.struct(none.alias("out"), word.alias("over")), carry)["out"]

    def decimal(d: Column) -> Column:
        n = F.ceil(F.greatest(F.length(d), F.lit(1)) / 8).cast("int")
        words = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(F.lpad(d, n * 8, "0"), i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
        text = F.array_join(F.transform(F.reverse(F.aggregate(words, none, step)), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
        return F.when(d.isNotNull(), F.regexp_replace(text, "^0+(?=.)", ""))

    # in a list of one, so that the digits are worked out once
    return F.transform(F.array(digits), decimal)[0]


def rehash_id(uid: Column, salt: str) -> Column:
    return F.concat(F.lit("2.25."), hex_decimal(F.substring(digest(salt, uid), 1, 32)))


def short_digest(value: Column, salt: str) -> Column:
    return F.substring(digest(salt, value), 1, 16)


def split_bucket(patient: Column, seed: int = 42) -> Column:
    """The whole 256-bit hash modulo 100."""
    digits = F.split(digest(f"{seed}:", patient), "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * 16 + F.conv(d, 16, 10).cast("long")) % 100)


def split_name(bucket: Column) -> Column:
    return F.when(bucket < 60, "train").when(bucket < 80, "val").otherwise("test")


def leaks(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that lie in more than one split."""
    out = rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return out.where(F.size("splits") > 1)


def reindexed(rows: DataFrame, source: str, native: str) -> DataFrame:
    """(source, native, new_id): source-NNNN in id order; the windows run inside a source over distinct ids."""
    distinct = rows.select(source, native).distinct()
    n = F.row_number().over(Window.partitionBy(source).orderBy(native))
    return distinct.select(source, native, F.concat(F.lower(source), F.lit("-"), F.lpad(n.cast("string"), 6, "0")).alias("new_id"))


def age(text: Column) -> Column:
    """063Y -> 63; over 89 and anything else -> null."""
    years = F.regexp_extract(text, r"^(\d{3})Y$", 1).try_cast("int")
    return F.when(years <= 89, years)


def safe_number(text: Column) -> Column:
    """The first of several values, null unless it is a number."""
    return F.trim(F.get(F.split(text, r"\\"), 0)).try_cast("double")


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two boxes (x0, y0, x1, y1) over their union; 0 without a union."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def sample_size(variance: Column, epsilon: float, z: float = 1.959963984540054, bound: float = 1.0) -> dict[str, Column]:
    """Cases needed for a half width epsilon: by the normal limit, for areas, and by Bernstein's inequality (alpha 0.05)."""
    return {
        "n_clt": F.ceil((z / epsilon) ** 2 * variance),
        "n_auc": F.ceil((z / epsilon) ** 2 * 4 * variance),
        "n_bernstein": F.ceil(F.log(F.lit(40.0)) * (2 * variance + 2 * bound * epsilon / 3) / epsilon**2),
    }


def equivalence_verdict(low: Column, high: Column, epsilon: float) -> Column:
    return F.when((low > -epsilon) & (high < epsilon), "PASS").when((low > epsilon) | (high < -epsilon), "FAIL").otherwise("INDETERMINATE")


def path_classes(path: Column) -> dict[str, Column]:
    """Role, kernel and patient from a path's parts."""
    p = F.lower(path)
    return {
        "role": F.when(p.rlike("full|fd"), "full").when(p.rlike("quarter|low|ld"), "low").otherwise("unknown"),
        "kernel": F.when(p.contains("sharp"), "sharp").when(p.contains("soft"), "soft"),
        "patient": F.nullif(F.regexp_extract(path, r"[LC]\d{2,}", 0), F.lit("")),
    }


@query("SELECT c_custkey, '2.25.' || list_reduce(list_transform(string_split(substr(sha256('salt' || c_custkey), 1, 32), ''), lambda d: (instr('0123456789abcdef', d) - 1)::UHUGEINT), lambda a, d: a * 16 + d)::VARCHAR AS uid FROM customer")
def prj3_rehash_id(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", rehash_id(F.col("c_custkey"), "salt").alias("uid"))


@query("SELECT o_orderkey, substr(sha256(o_orderkey || '0.5.0'), 1, 16) AS scan_uid FROM orders")
def prj4_scan_uid(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", F.substring(digest(F.col("o_orderkey"), "0.5.0"), 1, 16).alias("scan_uid"))


@query("SELECT c_custkey, substr(sha256('key:' || c_name), 1, 16) AS canonical_key FROM customer")
def prj5_canonical_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", short_digest(F.col("c_name"), "key:").alias("canonical_key"))


_BUCKET = "list_reduce(list_transform(string_split(sha256('42:' || {k}), ''), lambda d: (instr('0123456789abcdef', d) - 1)::BIGINT), lambda a, d: (a * 16 + d) % 100)"
_SPLIT = "CASE WHEN {b} < 60 THEN 'train' WHEN {b} < 80 THEN 'val' ELSE 'test' END"


@query(f"WITH b AS (SELECT c_custkey, {_BUCKET.format(k='c_custkey')} AS bucket FROM customer) SELECT c_custkey, bucket, {_SPLIT.format(b='bucket')} AS split FROM b")
def prj6_split_bucket(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "customer").select("c_custkey", split_bucket(F.col("c_custkey")).alias("bucket"))
    return b.withColumn("split", split_name(F.col("bucket")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 120 <= 89 AND c_custkey % 7 <> 0 THEN (c_custkey % 120)::INT END AS age FROM customer")
def prj8_demographics(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    text = F.when(F.col("c_custkey") % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lpad((F.col("c_custkey") % 120).cast("string"), 3, "0"), F.lit("Y")))
    return c.select("c_custkey", age(text).alias("age"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity IS NULL OR l_quantity = 0 OR l_quantity <= 1.5")
def prj13_thin_series_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Thin series, and those of unknown thickness; the filter reaches the scan."""
    q = F.col("l_quantity")
    return table(spark, folder, "lineitem").where(q.isNull() | (q == 0) | (q <= 1.5)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey AS series, coalesce(max(l_extendedprice) FILTER (l_returnflag = 'R'), max(l_extendedprice) FILTER (l_returnflag = 'N')) AS low, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'real' WHEN count(*) FILTER (l_returnflag = 'N') > 0 THEN 'simulated' END AS kind FROM lineitem GROUP BY l_orderkey")
def prj14_low_dose_pick(spark: SparkSession, folder: str) -> DataFrame:
    """The real low-dose value if there is one, else the simulated one, and which it is."""
    of = lambda f: F.max(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice")))
    g = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("series")).agg(of("R").alias("r"), of("N").alias("n"))
    return g.select("series", F.coalesce("r", "n").alias("low"), F.when(F.col("r").isNotNull(), "real").when(F.col("n").isNotNull(), "simulated").alias("kind"))


@query("SELECT l_discount AS ratio, 'r' || lpad(round(l_discount * 100)::INT::VARCHAR, 3, '0') AS dose_key, count(*) AS n FROM lineitem GROUP BY ALL")
def prj15_dose_key(spark: SparkSession, folder: str) -> DataFrame:
    key = F.concat(F.lit("r"), F.lpad(F.round(F.col("l_discount") * 100).cast("int").cast("string"), 3, "0"))
    return table(spark, folder, "lineitem").groupBy(F.col("l_discount").alias("ratio"), key.alias("dose_key")).agg(F.count("*").alias("n"))


@query("SELECT 'sha256:' || sha256(text) AS framework_hash, item_id FROM benchmark")
def prj21_framework_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("framework_hash"), "item_id")


@query("WITH v AS (SELECT n_name AS vendor, var_samp(l_discount - l_tax) AS s2 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name) SELECT vendor, ceil(pow(1.959963984540054 / 0.01, 2) * s2)::BIGINT AS n_clt, ceil(pow(1.959963984540054 / 0.01, 2) * 4 * s2)::BIGINT AS n_auc, ceil(ln(40.0) * (2 * s2 + 2 * 0.01 / 3) / pow(0.01, 2))::BIGINT AS n_bernstein FROM v")
def prj24_sample_size(spark: SparkSession, folder: str) -> DataFrame:
    from assayer.operators.summaries import _supplied

    v = _supplied(spark, folder).groupBy("vendor").agg(F.var_samp(F.col("l_discount") - F.col("l_tax")).alias("s2"))
    return v.select("vendor", *(c.alias(n) for n, c in sample_size(F.col("s2"), 0.01).items()))


@query("WITH v AS (SELECT n_name AS vendor, avg(l_discount - l_tax) AS m, 1.96 * stddev_samp(l_discount - l_tax) / sqrt(count(*)) AS h FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name) SELECT vendor, CASE WHEN m - h > -0.0105 AND m + h < 0.0105 THEN 'PASS' WHEN m - h > 0.0105 OR m + h < -0.0105 THEN 'FAIL' ELSE 'INDETERMINATE' END AS verdict FROM v")
def prj25_equivalence_verdict(spark: SparkSession, folder: str) -> DataFrame:
    from assayer.operators.summaries import _supplied

    d = F.col("l_discount") - F.col("l_tax")
    v = _supplied(spark, folder).groupBy("vendor").agg(F.avg(d).alias("m"), (1.96 * F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("h"))
    return v.select("vendor", equivalence_verdict(F.col("m") - F.col("h"), F.col("m") + F.col("h"), 0.0105).alias("verdict"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(abs(ln(c_acctbal / 5000)), 6) ELSE 'inf'::DOUBLE END AS dev_log, round(abs(c_acctbal / 5000 - 1), 6) AS dev_abs FROM customer")
def prj26_band_deviation(spark: SparkSession, folder: str) -> DataFrame:
    from assayer.operators.board import deviation

    b = F.col("c_acctbal") / 5000
    return table(spark, folder, "customer").select("c_custkey", F.round(deviation(b), 6).alias("dev_log"), F.round(F.abs(b - 1), 6).alias("dev_abs"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 1000 >= 3 AND isfinite(l_quantity) AS ok FROM lineitem")
def prj27_rose_gate(spark: SparkSession, folder: str) -> DataFrame:
    from assayer.operators.board import finite

    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ((F.col("l_extendedprice") / 1000 >= 3) & finite(F.col("l_quantity"))).alias("ok"))


@query("SELECT event_id, try_cast(nullif(trim(props::JSON->>'k'), '') AS DOUBLE) AS k FROM events")
def prj32_safe_number(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", safe_number(F.get_json_object("props", "$.k")).alias("k"))


@query(f"WITH b AS (SELECT o_custkey AS k, {_SPLIT.format(b='(o_orderkey % 100)')} AS split FROM orders) SELECT k, list_sort(list(DISTINCT split)) AS splits FROM b GROUP BY k HAVING count(DISTINCT split) > 1")
def ag26_leak_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("k"), split_name(F.col("o_orderkey") % 100).alias("split"))
    return leaks(rows, "k", "split")


@query("SELECT o_custkey, max_by(o_orderkey, n * 1000000000 - o_orderkey) AS series, max(n) AS n_files FROM (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY o_custkey")
def ag28_largest_series_pick(spark: SparkSession, folder: str) -> DataFrame:
    """The series with most files per patient, the first id of equals."""
    o, line = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    n = o.join(line, line.l_orderkey == o.o_orderkey).groupBy("o_custkey", "o_orderkey").agg(F.count("*").alias("n"))
    return n.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("n", -F.col("o_orderkey"))).alias("series"), F.max("n").alias("n_files"))


@query("SELECT n_name AS source, c_custkey AS native, lower(n_name) || '-' || lpad((row_number() OVER (PARTITION BY n_name ORDER BY c_custkey))::VARCHAR, 6, '0') AS new_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def ag29_id_reindex(spark: SparkSession, folder: str) -> DataFrame:
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("source"), F.col("c_custkey").alias("native"))
    return reindexed(rows, "source", "native")


@query(f"WITH f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'val' END AS folder FROM customer), b AS (SELECT k, folder, {_BUCKET.format(k='k')} AS b FROM f) SELECT k, coalesce(folder, {_SPLIT.format(b='b')}) AS split FROM b")
def jn14_folder_or_rule_split(spark: SparkSession, folder: str) -> DataFrame:
    """The split that the layout gives, else the rule's."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    placed = c.where("k % 3 = 0").select("k", F.lit("val").alias("placed"))
    return c.join(placed, "k", "left").select("k", F.coalesce("placed", split_name(split_bucket(F.col("k")))).alias("split"))


@query("SELECT l_orderkey AS series, l_linenumber AS z, l_partkey AS instance, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1) AS slice_index FROM lineitem")
def win10_z_order(spark: SparkSession, folder: str) -> DataFrame:
    """Slices by position and instance -> index."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("z"), F.col("l_partkey").alias("instance"), (F.row_number().over(w) - 1).cast("long").alias("slice_index"))


@query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) SELECT event_id, event_type || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS reader FROM r")
def win11_dup_suffix(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated ids of one file get _2, _3 and so on."""
    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    e = table(spark, folder, "events").withColumn("k", k)
    return e.select("event_id", F.concat("event_type", F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise("")).alias("reader"))


@query("WITH r AS (SELECT o_custkey AS k, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT k, o_orderkey, o_orderstatus FROM r WHERE n = 1")
def so4_first_distinct(spark: SparkSession, folder: str) -> DataFrame:
    first = F.min_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey"))
    return table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(first.alias("f")).select("k", "f.*")
