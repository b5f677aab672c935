"""Summary tables: quantiles, category counts, histograms and distances, phantom contrast, consistency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.operators.registry import query
from assayer.plans.measures import SLICES, slices
from assayer.sources.tables import table


def summarize_numeric(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group over non-nulls: n, least, quartiles by linear interpolation, most."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), q.alias("q"), F.max(value).alias("most"))
    return out.select(*by, "n", "least", *(F.get("q", i).alias(n) for i, n in enumerate(("q1", "median", "q3"))), "most")


def count_categories(rows: DataFrame, by: list[str], category: str, most: int | None = None) -> DataFrame:
    """Counts without nulls, most common first, ties by name; ``most`` keeps that many a group."""
    out = rows.where(F.col(category).isNotNull()).groupBy(*by, category).agg(F.count("*").alias("n"))
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), category)).cast("long"))
    return out if most is None else out.where(F.col("place") <= most)


def histogram(rows: DataFrame, by: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of fixed-width bins over [low, high]; the last bin is closed on the right."""
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return rows.where(F.col(value).between(low, high)).groupBy(by, at.alias("bin")).agg(F.count("*").alias("n"))


def wasserstein(counts: DataFrame, by: str, width: float, bins: int) -> DataFrame:
    """Area between each group's cumulative distribution and that of all other groups together.

    The grid of groups and bins has a fixed number of bins; the cumulative sums run inside a group.
    """
    spark = counts.sparkSession
    grid = counts.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    full = grid.join(counts, [by, "bin"], "left").fillna(0, ["n"])
    everyone = full.groupBy("bin").agg(F.sum("n").alias("t"))
    both = full.join(everyone, "bin")
    run = Window.partitionBy(by).orderBy("bin")
    own, rest = F.sum("n").over(run), F.sum(F.col("t") - F.col("n")).over(run)
    own_all, rest_all = F.sum("n").over(Window.partitionBy(by)), F.sum(F.col("t") - F.col("n")).over(Window.partitionBy(by))
    return both.select(by, F.abs(own / own_all - rest / rest_all).alias("d")).groupBy(by).agg((F.sum("d") * width).alias("w1"))


def overlap(rows: DataFrame, by: str, category: str) -> DataFrame:
    """For every two groups, the per cent that their category shares have in common."""
    counts = rows.groupBy(by, category).agg(F.count("*").alias("n"))
    share = counts.select(by, category, (F.col("n") / F.sum("n").over(Window.partitionBy(by))).alias("p"))
    a, b = share.alias("a"), share.alias("b")
    joined = a.join(b, (F.col(f"a.{category}") == F.col(f"b.{category}")) & (F.col(f"a.{by}") < F.col(f"b.{by}")))
    return joined.groupBy(F.col(f"a.{by}").alias("a"), F.col(f"b.{by}").alias("b")).agg((100 * F.sum(F.least("a.p", "b.p"))).alias("overlap"))


def bland_altman(rows: DataFrame, by: list[str], x: Column, y: Column) -> DataFrame:
    """Bias, sample deviation and limits of agreement of x - y."""
    d = x - y
    out = rows.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"))
    return out.withColumn("low", F.col("bias") - 1.96 * F.col("sd")).withColumn("high", F.col("bias") + 1.96 * F.col("sd"))


def phantom_contrast(rois: DataFrame, keys: list[str], hot: str, background: str, ratio: float) -> DataFrame:
    """Per key from background regions: hot contrast, cold contrast, variability and contrast to noise."""
    b, sd = F.avg(background), F.stddev_samp(background)
    c = F.avg(hot)
    out = rois.groupBy(*keys).agg(c.alias("hot"), b.alias("background"), sd.alias("sd"), F.count("*").alias("n"))
    return out.select(
        *keys,
        "n",
        ((F.col("hot") / F.col("background") - 1) / (ratio - 1)).alias("contrast_hot"),
        (1 - F.col("hot") / F.col("background")).alias("contrast_cold"),
        (F.col("sd") / F.col("background")).alias("variability"),
        F.when(F.col("sd") > 0, (F.col("hot") - F.col("background")) / F.col("sd")).alias("cnr"),
    )


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison of two result tables: status and the absolute and relative difference."""
    x, y = a.select(*keys, F.col(value).alias("a"), F.lit(1).alias("in_a")), b.select(*keys, F.col(value).alias("b"), F.lit(1).alias("in_b"))
    status = F.when(F.col("in_a").isNull(), "missing_a").when(F.col("in_b").isNull(), "missing_b").otherwise("both")
    gap = F.abs(F.col("a") - F.col("b"))
    return x.join(y, keys, "full_outer").select(*keys, status.alias("status"), gap.alias("abs_diff"), (gap / F.greatest(F.abs("b"), F.lit(1e-12))).alias("rel_diff"))


def tolerance_ladder(diffs: DataFrame, model: str, steps: list[float]) -> DataFrame:
    """Per tolerance: the models whose worst relative difference exceeds it (missing sides always do)."""
    worst = diffs.groupBy(model).agg(F.max(F.coalesce("rel_diff", F.lit(float("inf")))).alias("worst"))
    ladder = worst.select(model, "worst", F.explode(F.lit(steps)).alias("tolerance"))
    failing = F.when(F.col("worst") > F.col("tolerance"), F.col(model))
    out = ladder.groupBy("tolerance").agg(F.count(failing).alias("n_failing"), F.array_join(F.array_sort(F.collect_set(failing)), ",").alias("failing"))
    return out.withColumn("verdict", F.when(F.col("n_failing") == 0, "PASS").otherwise("FAIL"))


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _supplied(spark: SparkSession, folder: str) -> DataFrame:
    line, s, n = table(spark, folder, "lineitem"), table(spark, folder, "supplier"), table(spark, folder, "nation")
    return line.join(s, line.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "vendor")


@query("SELECT c_mktsegment AS source, count(c_acctbal) AS n, min(c_acctbal) AS least, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(quantile_cont(c_acctbal, 0.75), 6) AS q3, max(c_acctbal) AS most FROM customer GROUP BY c_mktsegment")
def ag1_summarize_numeric(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").withColumnRenamed("c_mktsegment", "source")
    return rounded(summarize_numeric(c, ["source"], "c_acctbal"), ["q1", "median", "q3"])


_CATEGORIES = "c AS (SELECT p_brand AS brand, p_type AS kind, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, kind) AS place FROM c)"


@query(f"WITH {_CATEGORIES} SELECT brand, kind, n, place FROM r")
def ag2_count_categories(spark: SparkSession, folder: str) -> DataFrame:
    return count_categories(table(spark, folder, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")), ["brand"], "kind")


@query(f"WITH {_CATEGORIES} SELECT brand, kind, n, place FROM r WHERE place <= 4")
def sl3_top_categories(spark: SparkSession, folder: str) -> DataFrame:
    return count_categories(table(spark, folder, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")), ["brand"], "kind", 4)


@query("WITH p AS (SELECT n_name AS source, c_custkey AS patient, c_acctbal AS age, c_mktsegment AS sex FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT coalesce(source, 'all') AS source, count(*) AS n_patients, count(age) FILTER (age > 0) AS n_known, round(quantile_cont(age, 0.5), 6) AS age_median, round(100.0 * count(*) FILTER (sex = 'BUILDING') / count(*)::DOUBLE, 6) AS building_percent FROM p GROUP BY ROLLUP (source)")
def ag3_demographics(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (source, patient), then per source and over all."""
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    p = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("source"), F.col("c_custkey").alias("patient"), F.col("c_acctbal").alias("age"), F.col("c_mktsegment").alias("sex"))
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("source", "patient").orderBy("age"))).where("k = 1")
    building = 100 * F.count(F.when(F.col("sex") == "BUILDING", 1)) / F.count("*")
    out = p.rollup("source").agg(F.count("*").alias("n_patients"), F.count(F.when(F.col("age") > 0, 1)).alias("n_known"), F.round(F.percentile("age", 0.5), 6).alias("age_median"), F.round(building, 6).alias("building_percent"))
    return out.withColumn("source", F.coalesce("source", F.lit("all")))


@query("WITH a AS (SELECT n_name AS source, l_returnflag AS kernel, l_quantity AS exposure FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) SELECT source, count(*) AS n, count(*) FILTER (kernel = 'A') AS n_a, count(*) FILTER (kernel = 'N') AS n_n, count(*) FILTER (kernel = 'R') AS n_r, round(quantile_cont(exposure, 0.5), 6) AS exposure_median, min(exposure) AS exposure_least, max(exposure) AS exposure_most FROM a GROUP BY source")
def ag4_acquisition(spark: SparkSession, folder: str) -> DataFrame:
    a = _supplied(spark, folder)
    kinds = [F.count(F.when(F.col("l_returnflag") == k, 1)).alias(f"n_{k.lower()}") for k in "ANR"]
    q = F.col("l_quantity")
    return a.groupBy(F.col("vendor").alias("source")).agg(F.count("*").alias("n"), *kinds, F.round(F.percentile(q, 0.5), 6).alias("exposure_median"), F.min(q).alias("exposure_least"), F.max(q).alias("exposure_most"))


@query("WITH k AS (SELECT o_custkey AS patient, l_orderkey AS nodule, least(count(*), 4) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), p AS (SELECT patient, count(*) AS n FROM k GROUP BY patient) SELECT (SELECT count(*) FROM p) AS n_patients, (SELECT max(n) FROM p) AS most_per_patient, count(*) AS n_nodules, round(avg(k), 6) AS mean_contributors, round(avg(k * (k - 1) / 12), 6) AS pair_agreement, count(*) FILTER (k = 4) AS n_by_all FROM k")
def ag5_inter_rater_table(spark: SparkSession, folder: str) -> DataFrame:
    """Contributors a nodule (four readers at most) and the share of reader pairs that agree on it."""
    line, order = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    k = line.join(order, line.l_orderkey == order.o_orderkey).groupBy(F.col("o_custkey").alias("patient"), F.col("l_orderkey").alias("nodule")).agg(F.least(F.count("*"), F.lit(4)).alias("k"))
    p = k.groupBy("patient").agg(F.count("*").alias("n"), F.sum("k").alias("s"), F.sum(F.col("k") * (F.col("k") - 1) / 12).alias("a"), F.count(F.when(F.col("k") == 4, 1)).alias("all4"))
    n = F.sum("n")
    return p.agg(F.count("*").alias("n_patients"), F.max("n").alias("most_per_patient"), n.alias("n_nodules"), F.round(F.sum("s") / n, 6).alias("mean_contributors"), F.round(F.sum("a") / n, 6).alias("pair_agreement"), F.sum("all4").alias("n_by_all"))


_BINS, _LOW, _HIGH = 40, 0.0, 100.0
_HIST = f"{SLICES}, h AS (SELECT vendor, least(floor(cnr / {(_HIGH - _LOW) / _BINS})::BIGINT, {_BINS - 1}) AS bin, count(*) AS n FROM s WHERE cnr BETWEEN {_LOW} AND {_HIGH} GROUP BY ALL)"


@query(f"WITH {_HIST} SELECT vendor, bin, n FROM h")
def ag12_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return histogram(slices(spark, folder), "vendor", "cnr", _LOW, _HIGH, _BINS)


@query(f"WITH {_HIST}, g AS (SELECT v.vendor, b.bin, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT vendor FROM h) v CROSS JOIN (SELECT unnest(range({_BINS})) AS bin) b LEFT JOIN h ON h.vendor = v.vendor AND h.bin = b.bin), t AS (SELECT bin, sum(n) AS t FROM g GROUP BY bin), c AS (SELECT vendor, sum(n) OVER (PARTITION BY vendor ORDER BY g.bin) / (sum(n) OVER (PARTITION BY vendor))::DOUBLE AS p, sum(t - n) OVER (PARTITION BY vendor ORDER BY g.bin) / (sum(t - n) OVER (PARTITION BY vendor))::DOUBLE AS q FROM g JOIN t ON g.bin = t.bin) SELECT vendor, round(sum(abs(p - q)) * {(_HIGH - _LOW) / _BINS}, 6) AS w1 FROM c GROUP BY vendor")
def ag14_wasserstein(spark: SparkSession, folder: str) -> DataFrame:
    h = histogram(slices(spark, folder), "vendor", "cnr", _LOW, _HIGH, _BINS)
    return rounded(wasserstein(h, "vendor", (_HIGH - _LOW) / _BINS, _BINS), ["w1"])


@query("WITH k AS (SELECT l_orderkey AS id, l_linenumber AS line, n_name AS vendor, row_number() OVER (PARTITION BY n_name ORDER BY (l_orderkey * 7919 + l_linenumber * 104729) % 1000003, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) SELECT vendor, id, line, k FROM k WHERE k <= 30")
def ag13_stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Thirty rows a vendor by a seeded order that does not depend on how rows arrive."""
    drawn = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 1000003
    w = Window.partitionBy("vendor").orderBy(drawn, "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    k = _supplied(spark, folder).withColumn("k", F.row_number().over(w).cast("long")).where("k <= 30")
    return k.select("vendor", F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "k")


@query("WITH c AS (SELECT n_name AS vendor, p_type AS kind, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL), p AS (SELECT vendor, kind, n / (sum(n) OVER (PARTITION BY vendor))::DOUBLE AS p FROM c) SELECT a.vendor AS a, b.vendor AS b, round(100 * sum(least(a.p, b.p)), 6) AS overlap FROM p a JOIN p b ON a.kind = b.kind AND a.vendor < b.vendor GROUP BY ALL")
def ag15_overlap_coefficient(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    rows = _supplied(spark, folder).join(part, F.col("l_partkey") == part.p_partkey)
    return rounded(overlap(rows, "vendor", "p_type"), ["overlap"])


@query(f"WITH {SLICES} SELECT dose, count(*) AS n, {r6('bias', 'sd')}, round(bias - 1.96 * sd, 6) AS low, round(bias + 1.96 * sd, 6) AS high FROM (SELECT dose, avg(score_a - score_b) AS bias, stddev_samp(score_a - score_b) AS sd, count(*) AS c FROM s GROUP BY dose) JOIN s USING (dose) GROUP BY ALL")
def ag21_bland_altman(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(bland_altman(slices(spark, folder), ["dose"], F.col("score_a"), F.col("score_b")), ["bias", "sd", "low", "high"])


_PHANTOM = "SELECT l_returnflag AS level, l_linenumber AS sphere, avg(l_extendedprice) AS hot, avg(l_quantity * 1000) AS b, stddev_samp(l_quantity * 1000) AS sd, count(*) AS n FROM lineitem GROUP BY ALL"


@query(f"SELECT level, sphere, n, round((hot / b - 1) / 3, 6) AS contrast_hot, round(1 - hot / b, 6) AS contrast_cold, round(sd / b, 6) AS variability, round(CASE WHEN sd > 0 THEN (hot - b) / sd END, 6) AS cnr FROM ({_PHANTOM})")
def ag22_phantom_contrast(spark: SparkSession, folder: str) -> DataFrame:
    rois = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("level"), F.col("l_linenumber").alias("sphere"), F.col("l_extendedprice").alias("hot"), (F.col("l_quantity") * 1000).alias("bg"))
    return rounded(phantom_contrast(rois, ["level", "sphere"], "hot", "bg", 4.0), ["contrast_hot", "contrast_cold", "variability", "cnr"])


@query(f"WITH p AS ({_PHANTOM}), c AS (SELECT a.sphere, (a.hot / a.b - 1) / 3 - (b.hot / b.b - 1) / 3 AS d FROM p a JOIN p b ON a.sphere = b.sphere AND a.level = 'N' AND b.level = 'R') SELECT count(d) AS n, round(avg(d), 6) AS bias, round(stddev_samp(d), 6) AS sd, round(avg(d) - 1.96 * stddev_samp(d), 6) AS low, round(avg(d) + 1.96 * stddev_samp(d), 6) AS high FROM c")
def ag23_decayed_vs_thinned(spark: SparkSession, folder: str) -> DataFrame:
    """One level's contrasts against another's on the spheres both have."""
    rois = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("level"), F.col("l_linenumber").alias("sphere"), F.col("l_extendedprice").alias("hot"), (F.col("l_quantity") * 1000).alias("bg"))
    c = phantom_contrast(rois, ["level", "sphere"], "hot", "bg", 4.0)
    a, b = c.where("level = 'N'").select("sphere", F.col("contrast_hot").alias("x")), c.where("level = 'R'").select("sphere", F.col("contrast_hot").alias("y"))
    return rounded(bland_altman(a.join(b, "sphere"), [], F.col("x"), F.col("y")), ["bias", "sd", "low", "high"])


@query("SELECT user_id % 50 AS voxel, count(value) AS n, round(avg(value), 6) AS mean, round(CASE WHEN count(value) > 1 THEN var_pop(value) END, 6) AS variance FROM events GROUP BY voxel")
def ag24_realization_stats(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").groupBy((F.col("user_id") % 50).alias("voxel"))
    return e.agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.when(F.count("value") > 1, F.var_pop("value")), 6).alias("variance"))


def tree_fingerprint(files: DataFrame, digest: str, width: int = 2) -> DataFrame:
    """One digest over sorted digests, by prefix and then over the prefixes, so that no task holds them all."""
    leaf = files.groupBy(F.substring(digest, 1, width).alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), "\n"), 256).alias("d"), F.count("*").alias("n"))
    return leaf.agg(F.sum("n").alias("n_files"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "d"))), lambda x: x["d"]), "\n"), 256).alias("fingerprint"))


@query("WITH d AS (SELECT sha256(text) AS d FROM documents), l AS (SELECT substr(d, 1, 2) AS prefix, sha256(string_agg(d, chr(10) ORDER BY d)) AS d, count(*) AS n FROM d GROUP BY prefix) SELECT sum(n)::BIGINT AS n_files, sha256(string_agg(d, chr(10) ORDER BY prefix)) AS fingerprint FROM l")
def ag25_inputs_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return tree_fingerprint(table(spark, folder, "documents").select(F.sha2("text", 256).alias("d")), "d")


@query("SELECT count(DISTINCT coalesce(o_custkey, o_orderkey)) AS n_patients FROM orders")
def ag27_unique_patients(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").agg(F.countDistinct(F.coalesce("o_custkey", "o_orderkey")).alias("n_patients"))


@query("WITH m AS (SELECT vec_id, v.i AS pixel, embedding[v.i + 1]::DOUBLE AS v, label FROM embeddings, (SELECT unnest(range(64)) AS i) v) SELECT label, pixel, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM m GROUP BY ALL")
def ag30_ensemble_reduce(spark: SparkSession, folder: str) -> DataFrame:
    """Per pixel, the mean and population deviation over the members of an ensemble."""
    m = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("pixel", "v"))
    v = F.col("v").cast("double")
    return m.groupBy("label", F.col("pixel").cast("long").alias("pixel")).agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"))


def _runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    s = slices(spark, folder)
    one = s.where("dose <> 0.1 or method <> 'Brand#2'").groupBy("method", "dose").agg(F.avg("cnr").alias("v"))
    two = s.where("dose <> 0.5 or method <> 'Brand#3'").groupBy("method", "dose").agg((F.avg("cnr") * F.when(F.col("dose") == 0.25, 1.0005).otherwise(1.0)).alias("v"))
    return one, two


_RUNS = f"{SLICES}, one AS (SELECT method, dose, avg(cnr) AS v, 1 AS i FROM s WHERE dose <> 0.1 OR method <> 'Brand#2' GROUP BY method, dose), two AS (SELECT method, dose, avg(cnr) * CASE WHEN dose = 0.25 THEN 1.0005::DOUBLE ELSE 1 END AS v, 1 AS i FROM s WHERE dose <> 0.5 OR method <> 'Brand#3' GROUP BY method, dose), d AS (SELECT method, dose, CASE WHEN one.i IS NULL THEN 'missing_a' WHEN two.i IS NULL THEN 'missing_b' ELSE 'both' END AS status, abs(one.v - two.v) AS abs_diff, abs(one.v - two.v) / greatest(abs(two.v), 1e-12) AS rel_diff FROM one FULL JOIN two USING (method, dose))"


@query(f"WITH {_RUNS} SELECT method, dose, status, round(abs_diff, 6) AS abs_diff, round(rel_diff, 6) AS rel_diff FROM d")
def jn8_run_compare(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compare_runs(*_runs(spark, folder), ["method", "dose"], "v"), ["abs_diff", "rel_diff"])


@query(f"WITH {_RUNS}, w AS (SELECT method, max(coalesce(rel_diff, 'inf'::DOUBLE)) AS worst FROM d GROUP BY method), l AS (SELECT *, unnest([1e-6, 1e-5, 1e-4, 1e-3]) AS tolerance FROM w) SELECT tolerance, count(*) FILTER (worst > tolerance) AS n_failing, coalesce(string_agg(method, ',' ORDER BY method) FILTER (worst > tolerance), '') AS failing, CASE WHEN count(*) FILTER (worst > tolerance) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM l GROUP BY tolerance")
def ag31_tolerance_audit(spark: SparkSession, folder: str) -> DataFrame:
    return tolerance_ladder(compare_runs(*_runs(spark, folder), ["method", "dose"], "v"), "method", [1e-6, 1e-5, 1e-4, 1e-3])


@query(f"WITH {_RUNS}, c AS (SELECT * FROM (VALUES (0.1::DOUBLE, 'rel', 1e-6), (0.25::DOUBLE, 'rel', 1e-3)) t(dose, kind, most)) SELECT method, count(*) FILTER (c.dose IS NULL) AS n_unknown, count(*) FILTER (c.dose IS NOT NULL AND NOT coalesce(rel_diff <= most, false)) AS n_failing, CASE WHEN count(*) FILTER (c.dose IS NULL OR NOT coalesce(rel_diff <= most, false)) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM d LEFT JOIN c USING (dose) GROUP BY method")
def ag32_metric_criteria(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict per model with a criterion per metric; rows without a criterion, or that can't be compared, fail."""
    d = compare_runs(*_runs(spark, folder), ["method", "dose"], "v")
    criteria = spark.createDataFrame([(0.1, 1e-6), (0.25, 1e-3)], "dose double, most double")
    bad = ~F.coalesce(F.col("rel_diff") <= F.col("most"), F.lit(False))
    j = d.join(F.broadcast(criteria), "dose", "left")  # one row a metric
    unknown = F.col("most").isNull()
    out = j.groupBy("method").agg(F.count(F.when(unknown, 1)).alias("n_unknown"), F.count(F.when(~unknown & bad, 1)).alias("n_failing"), F.count(F.when(unknown | bad, 1)).alias("all_bad"))
    return out.select("method", "n_unknown", "n_failing", F.when(F.col("all_bad") == 0, "PASS").otherwise("FAIL").alias("verdict"))


@query("WITH a AS (SELECT o_orderkey AS k, o_custkey % 8 AS stored FROM orders), c AS (SELECT l_orderkey AS k, count(*) AS counted FROM lineitem GROUP BY l_orderkey) SELECT CASE WHEN stored IS NULL THEN 'untracked' WHEN counted IS NULL THEN 'missing' WHEN stored = counted THEN 'equal' ELSE 'different' END AS status, count(*) AS n FROM a FULL JOIN c USING (k) GROUP BY status")
def ag33_metadata_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Stored counts against counts taken from the records."""
    stored = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 8).alias("stored"))
    counted = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("counted"))
    status = F.when(F.col("stored").isNull(), "untracked").when(F.col("counted").isNull(), "missing").when(F.col("stored") == F.col("counted"), "equal").otherwise("different")
    return stored.join(counted, "k", "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {SLICES}, t AS (SELECT vendor, series, avg(score_a - score_b) AS m, coalesce(stddev_samp(score_a - score_b), 0) / sqrt(count(*)) AS se, count(*) AS n FROM s GROUP BY vendor, series), c AS (SELECT vendor, m - 1.96 * se AS lo, m + 1.96 * se AS hi FROM t) SELECT vendor, count(*) AS n, round(avg((0 BETWEEN lo AND hi)::INT), 6) AS coverage, round(avg((hi - lo) / 2), 6) AS half_width, round(avg((lo > -1 AND hi < 1)::INT), 6) AS pass_share FROM c GROUP BY vendor")
def ag34_coverage_summary(spark: SparkSession, folder: str) -> DataFrame:
    """From trial intervals: coverage of the true value, mean half width and the share of passes."""
    d = F.col("score_a") - F.col("score_b")
    t = slices(spark, folder).groupBy("vendor", "series").agg(F.avg(d).alias("m"), (F.coalesce(F.stddev_samp(d), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("se"))
    c = t.select("vendor", (F.col("m") - 1.96 * F.col("se")).alias("lo"), (F.col("m") + 1.96 * F.col("se")).alias("hi"))
    share = lambda x: F.round(F.avg(x.cast("int")), 6)
    return c.groupBy("vendor").agg(F.count("*").alias("n"), share(F.lit(0).between(F.col("lo"), F.col("hi"))).alias("coverage"), F.round(F.avg((F.col("hi") - F.col("lo")) / 2), 6).alias("half_width"), share((F.col("lo") > -1) & (F.col("hi") < 1)).alias("pass_share"))
