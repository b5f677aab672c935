"""Governed ranking: per-stratum aggregates, ranks, gaps to a permanent control and its verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.operators.registry import query
from assayer.plans.measures import CONTROL, SLICES, slices

ENTRIES = f"WITH {SLICES}, e AS (SELECT vendor, method, avg(psnr) AS psnr, avg(cnr) AS cnr, count(*) AS n FROM s GROUP BY vendor, method)"
#: Severity, least first: absence is never a pass.
NO_CLAIM, PASS, MISSING_STRATUM, INDETERMINATE, FAIL = "NO_CLAIM", "PASS", "MISSING_STRATUM", "INDETERMINATE", "FAIL"
SEVERITY = (NO_CLAIM, PASS, MISSING_STRATUM, INDETERMINATE, FAIL)


def entries(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One board entry per key: the mean of every metric over its rows, and how many rows."""
    return rows.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in metrics), F.count("*").alias("n"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def eval_aggregate(rows: DataFrame, keys: list[str], psnr: str = "psnr", cnr: str = "cnr") -> DataFrame:
    """Per key: mean psnr; mean, median and population spread of cnr; rows."""
    return rows.groupBy(*keys).agg(F.avg(psnr).alias("psnr_mean"), F.avg(cnr).alias("cnr_mean"), F.percentile(cnr, 0.5).alias("cnr_median"), F.stddev_pop(cnr).alias("cnr_std"), F.count("*").alias("n"))


def spread(board: DataFrame, by: str, metrics: list[str], is_control: Column) -> DataFrame:
    """Per group without controls: span and population deviation of each metric; the deviation only for two or more."""
    out = [F.count("*").alias("n")]
    for m in metrics:
        out += [(F.max(m) - F.min(m)).alias(f"{m}_span"), F.when(F.count(m) > 1, F.stddev_pop(m)).alias(f"{m}_std")]
    return board.where(~is_control).groupBy(by).agg(*out)


def ranked(board: DataFrame, order: list[str], tie: list[str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Adds the rank by the metrics in order, larger first and missing last, ties by ``tie``."""
    keys = [F.col(m).desc_nulls_last() for m in order] + [F.col(t).asc() for t in tie]
    return board.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*keys)).cast("long"))


def gap_to_control(board: DataFrame, metrics: list[str], is_control: Column, by: list[str]) -> DataFrame:
    """Adds each metric minus the control's within the group; null where the group has no control."""
    control = board.where(is_control).groupBy(*by).agg(*(F.min(m).alias(f"_{m}") for m in metrics))
    joined = board.join(control, by, "left")
    return joined.select("*", *((F.col(m) - F.col(f"_{m}")).alias(f"{m}_gap") for m in metrics)).drop(*(f"_{m}" for m in metrics))


def control_verdicts(board: DataFrame, by: list[str], value: str, is_control: Column, min_ratio: float | None = None, placeholder: Column | None = None) -> DataFrame:
    """Per group, whether the control is strictly lowest: one aggregation, no join.

    NO_CLAIM without anything to compare, INDETERMINATE without a control value, FAIL if any entry is at or below the control or
    the least ratio is short of ``min_ratio``.
    """
    real = ~is_control if placeholder is None else ~is_control & ~placeholder
    least = F.min(F.when(real, F.col(value)))
    out = board.groupBy(*by).agg(F.min(F.when(is_control, F.col(value))).alias("control"), least.alias("least"), F.count(F.when(real, F.col(value))).alias("n_compared"))
    ratio = F.when(F.col("control") > 0, F.col("least") / F.col("control"))
    out = out.withColumn("min_ratio", ratio)
    short = F.lit(False) if min_ratio is None else F.coalesce(F.col("min_ratio") < min_ratio, F.lit(False))
    verdict = F.when(F.col("n_compared") == 0, NO_CLAIM).when(F.col("control").isNull(), INDETERMINATE)
    return out.withColumn("verdict", verdict.when((F.col("least") <= F.col("control")) | short, FAIL).otherwise(PASS))


def worst(verdicts: DataFrame, required: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """One row: the worst verdict, with MISSING_STRATUM where a required group has no row."""
    place = F.array_position(F.lit(list(SEVERITY)), F.col("verdict"))
    rows = verdicts.select(place.alias("p"))
    if required is not None:
        missing = required.join(verdicts, key, "left_anti")
        rows = rows.union(missing.select(F.lit(1 + SEVERITY.index(MISSING_STRATUM)).cast("long")))
    return rows.agg(F.element_at(F.lit(list(SEVERITY)), F.coalesce(F.max("p"), F.lit(1)).cast("int")).alias("verdict"), F.count("*").alias("n_groups"))


def rank_shift(board: DataFrame, a: str, b: str, tie: str, by: list[str]) -> DataFrame:
    """Per group: Spearman of the two ranks, how many entries move, and the largest move."""
    two = ranked(ranked(board, [a], [tie], by, "rank_a"), [b], [tie], by, "rank_b")
    d = F.col("rank_a") - F.col("rank_b")
    n = F.count("*")
    rho = F.when(n > 1, 1 - 6 * F.sum(d * d) / (n * (n * n - 1)))
    return two.groupBy(*by).agg(rho.alias("spearman"), F.sum((d != 0).cast("long")).alias("n_moved"), F.max(F.abs(d)).alias("max_shift"))


def deviation(value: Column) -> Column:
    """How far a ratio is from 1 on the log scale; unbounded for ratios of 0 or less."""
    return F.when(value > 0, F.abs(F.log(value))).otherwise(float("inf"))


def is_control() -> Column:
    return F.col("method") == CONTROL



def _board(spark: SparkSession, folder: str) -> DataFrame:
    return entries(slices(spark, folder), ["vendor", "method"], ["psnr", "cnr"])


@query(f"{ENTRIES}, r AS (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY cnr DESC NULLS LAST, psnr DESC NULLS LAST, method) AS rank FROM e) SELECT vendor, method, n, round(psnr, 6) AS psnr, round(cnr, 6) AS cnr, rank FROM r")
def win1_board_rank(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(_board(spark, folder), ["cnr", "psnr"], ["method"], ["vendor"]).select("vendor", "method", "n", F.round("psnr", 6).alias("psnr"), F.round("cnr", 6).alias("cnr"), "rank")


@query(f"{ENTRIES}, c AS (SELECT vendor, psnr AS p, cnr AS c FROM e WHERE method = '{CONTROL}') SELECT e.vendor, method, round(psnr - p, 6) AS psnr_gap, round(cnr - c, 6) AS cnr_gap FROM e LEFT JOIN c USING (vendor)")
def win2_gap_to_control(spark: SparkSession, folder: str) -> DataFrame:
    return gap_to_control(_board(spark, folder), ["psnr", "cnr"], is_control(), ["vendor"]).select("vendor", "method", F.round("psnr_gap", 6).alias("psnr_gap"), F.round("cnr_gap", 6).alias("cnr_gap"))


_TWO_RANKS = "r AS (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY {a} DESC NULLS LAST, method) AS ra, row_number() OVER (PARTITION BY vendor ORDER BY {b} DESC NULLS LAST, method) AS rb FROM {t})"


@query(f"{ENTRIES}, {_TWO_RANKS.format(a='psnr', b='cnr', t='e')} SELECT vendor, round(1 - 6 * sum((ra - rb) * (ra - rb)) / (count(*) * (count(*) * count(*) - 1))::DOUBLE, 6) AS spearman, sum((ra <> rb)::INT)::BIGINT AS n_moved, max(abs(ra - rb)) AS max_shift FROM r GROUP BY vendor")
def win3_rank_shift(spark: SparkSession, folder: str) -> DataFrame:
    return rank_shift(_board(spark, folder), "psnr", "cnr", "method", ["vendor"]).withColumn("spearman", F.round("spearman", 6))


@query(f"{ENTRIES}, b AS (SELECT vendor, method, cnr / avg(cnr) OVER (PARTITION BY vendor) AS ratio FROM e), d AS (SELECT *, abs(ln(ratio)) AS dev FROM b), r AS (SELECT *, rank() OVER (PARTITION BY vendor ORDER BY ratio DESC) AS rank_ratio, rank() OVER (PARTITION BY vendor ORDER BY dev) AS rank_deviation FROM d) SELECT vendor, method, round(dev, 6) AS deviation, rank_ratio, rank_deviation, rank_ratio <> rank_deviation AS moved FROM r")
def win4_rank_under_deviation(spark: SparkSession, folder: str) -> DataFrame:
    by = Window.partitionBy("vendor")
    d = _board(spark, folder).withColumn("ratio", F.col("cnr") / F.avg("cnr").over(by)).withColumn("deviation", deviation(F.col("ratio")))
    d = d.withColumn("rank_ratio", F.rank().over(by.orderBy(F.desc("ratio"))).cast("long")).withColumn("rank_deviation", F.rank().over(by.orderBy("deviation")).cast("long"))
    return d.select("vendor", "method", F.round("deviation", 6).alias("deviation"), "rank_ratio", "rank_deviation", (F.col("rank_ratio") != F.col("rank_deviation")).alias("moved"))


_VERDICT = "CASE WHEN n_compared = 0 THEN 'NO_CLAIM' WHEN control IS NULL THEN 'INDETERMINATE' WHEN least <= control OR coalesce(CASE WHEN control > 0 THEN least / control END < {ratio}, false) THEN 'FAIL' ELSE 'PASS' END"
_GROUPED = f"{ENTRIES}, g AS (SELECT {{by}}, min(cnr) FILTER (method = '{CONTROL}') AS control, min(cnr) FILTER (method <> '{CONTROL}') AS least, count(cnr) FILTER (method <> '{CONTROL}') AS n_compared FROM e GROUP BY ALL), v AS (SELECT *, {_VERDICT.format(ratio='0.9')} AS verdict FROM g)"


@query(f"{_GROUPED.format(by=1)} SELECT round(control, 6) AS control, round(least, 6) AS least, n_compared, round(least / control, 6) AS min_ratio, verdict FROM v")
def gt7_trap_rank(spark: SparkSession, folder: str) -> DataFrame:
    v = control_verdicts(_board(spark, folder), [], "cnr", is_control(), 0.9)
    return v.select(F.round("control", 6).alias("control"), F.round("least", 6).alias("least"), "n_compared", F.round("min_ratio", 6).alias("min_ratio"), "verdict")


@query(f"{_GROUPED.format(by='vendor')} SELECT vendor, round(control, 6) AS control, round(least, 6) AS least, n_compared, round(CASE WHEN control > 0 THEN least / control END, 6) AS min_ratio, verdict FROM v")
def gt8_trap_rank_by_group(spark: SparkSession, folder: str) -> DataFrame:
    v = control_verdicts(_board(spark, folder), ["vendor"], "cnr", is_control(), 0.9)
    return v.select("vendor", F.round("control", 6).alias("control"), F.round("least", 6).alias("least"), "n_compared", F.round("min_ratio", 6).alias("min_ratio"), "verdict")


@query(f"{_GROUPED.format(by='vendor')}, w AS (SELECT list_position(['NO_CLAIM', 'PASS', 'MISSING_STRATUM', 'INDETERMINATE', 'FAIL'], verdict) AS p FROM v UNION ALL SELECT 3 FROM nation WHERE n_name NOT IN (SELECT vendor FROM v)) SELECT ['NO_CLAIM', 'PASS', 'MISSING_STRATUM', 'INDETERMINATE', 'FAIL'][max(p)] AS verdict, count(*) AS n_groups FROM w")
def gt8_worst_verdict(spark: SparkSession, folder: str) -> DataFrame:
    from assayer.sources.tables import table

    required = table(spark, folder, "nation").select(F.col("n_name").alias("vendor"))
    return worst(control_verdicts(_board(spark, folder), ["vendor"], "cnr", is_control(), 0.9), required, "vendor")


@query(f"{ENTRIES} SELECT vendor, count(*) FILTER (method = '{CONTROL}') AS n_controls, count(*) FILTER (method = '{CONTROL}') > 0 AS present FROM e GROUP BY vendor")
def gt9_trap_present(spark: SparkSession, folder: str) -> DataFrame:
    n = F.count(F.when(is_control(), 1))
    return _board(spark, folder).groupBy("vendor").agg(n.alias("n_controls"), (n > 0).alias("present"))


@query(f"WITH {SLICES} SELECT method, dose, round(avg(psnr), 6) AS psnr_mean, round(avg(cnr), 6) AS cnr_mean, round(quantile_cont(cnr, 0.5), 6) AS cnr_median, round(stddev_pop(cnr), 6) AS cnr_std, count(*) AS n FROM s GROUP BY method, dose")
def ag9_eval_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    e = eval_aggregate(slices(spark, folder), ["method", "dose"])
    return e.select("method", "dose", *(F.round(c, 6).alias(c) for c in ("psnr_mean", "cnr_mean", "cnr_median", "cnr_std")), "n")


@query(f"{ENTRIES} SELECT vendor, count(*) AS n, round(max(psnr) - min(psnr), 6) AS psnr_span, round(CASE WHEN count(psnr) > 1 THEN stddev_pop(psnr) END, 6) AS psnr_std, round(max(cnr) - min(cnr), 6) AS cnr_span, round(CASE WHEN count(cnr) > 1 THEN stddev_pop(cnr) END, 6) AS cnr_std FROM e WHERE method <> '{CONTROL}' GROUP BY vendor")
def ag10_spread_board(spark: SparkSession, folder: str) -> DataFrame:
    s = spread(_board(spark, folder), "vendor", ["psnr", "cnr"], is_control())
    return s.select("vendor", "n", *(F.round(c, 6).alias(c) for c in ("psnr_span", "psnr_std", "cnr_span", "cnr_std")))


def folds(rows: DataFrame, by: str, keys: list[str], metric: str) -> DataFrame:
    """Leave-one-group-out means per key from totals minus the group's own: no group is read again for another's fold."""
    own = rows.groupBy(by, *keys).agg(F.sum(metric).alias("s"), F.count(metric).alias("c"))
    w = Window.partitionBy(*keys)
    n = F.sum("c").over(w) - F.col("c")
    return own.select(F.col(by).alias("held_out"), *keys, F.when(n > 0, (F.sum("s").over(w) - F.col("s")) / n).alias("mean"))


def spread_over_folds(fold_means: DataFrame, keys: list[str]) -> DataFrame:
    return fold_means.groupBy(*keys).agg(F.avg("mean").alias("mean"), F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("std"), F.min("mean").alias("least"), F.max("mean").alias("most"), F.count("*").alias("n_folds"))


@query(f"WITH {SLICES}, o AS (SELECT vendor, dose, sum(cnr) AS x, count(*) AS c FROM s GROUP BY vendor, dose), f AS (SELECT a.vendor, a.dose, sum(b.x) / sum(b.c) AS mean FROM o a JOIN o b ON a.dose = b.dose AND a.vendor <> b.vendor GROUP BY a.vendor, a.dose) SELECT dose, round(avg(mean), 6) AS mean, round(coalesce(stddev_samp(mean), 0), 6) AS std, round(min(mean), 6) AS least, round(max(mean), 6) AS most, count(*) AS n_folds FROM f GROUP BY dose")
def ag11_spread_folds(spark: SparkSession, folder: str) -> DataFrame:
    s = spread_over_folds(folds(slices(spark, folder), "vendor", ["dose"], "cnr"), ["dose"])
    return s.select("dose", *(F.round(c, 6).alias(c) for c in ("mean", "std", "least", "most")), "n_folds")


@query(f"WITH {SLICES}, m AS (SELECT method, avg(CASE WHEN dose = 0.1 THEN cnr END) AS r010, avg(CASE WHEN dose = 0.25 THEN cnr END) AS r025, avg(CASE WHEN dose = 0.5 THEN cnr END) AS r050 FROM s GROUP BY method) SELECT method, round(r010, 6) AS r010, round(r025, 6) AS r025, round(r050, 6) AS r050 FROM m")
def ag7_baseline_table(spark: SparkSession, folder: str) -> DataFrame:
    """Method by dose: the mean, or the median of finite values where the mean isn't finite."""
    cnr = F.col("cnr")
    value = F.coalesce(F.when(finite(F.avg(cnr)), F.avg(cnr)), F.percentile(F.when(finite(cnr), cnr), 0.5))
    wide = slices(spark, folder).withColumn("d", F.format_string("r%03d", F.round(F.col("dose") * 100).cast("int"))).groupBy("method").pivot("d", ["r010", "r025", "r050"]).agg(value)
    return wide.select("method", *(F.round(d, 6).alias(d) for d in ("r010", "r025", "r050")))


@query(f"WITH {SLICES}, d AS (SELECT dose, series % 5 AS seed, avg(psnr) AS p, avg(cnr) AS c FROM s GROUP BY dose, seed), l AS (SELECT dose, 'psnr' AS metric, p AS v FROM d UNION ALL SELECT dose, 'cnr', c FROM d) SELECT dose, metric, round(avg(v), 6) AS mean, round(min(v), 6) AS least, round(max(v), 6) AS most, round(max(v) - min(v), 6) AS interval, count(*) AS n FROM l GROUP BY dose, metric")
def ag8_seed_set_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    per_seed = slices(spark, folder).groupBy("dose", (F.col("series") % 5).alias("seed")).agg(F.avg("psnr").alias("psnr"), F.avg("cnr").alias("cnr"))
    long = per_seed.unpivot(["dose", "seed"], ["psnr", "cnr"], "metric", "v")
    out = long.groupBy("dose", "metric").agg(F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), (F.max("v") - F.min("v")).alias("interval"), F.count("*").alias("n"))
    return out.select("dose", "metric", *(F.round(c, 6).alias(c) for c in ("mean", "least", "most", "interval")), "n")


@query(f"{ENTRIES} SELECT method, vendor, round(cnr, 6) AS cnr FROM e WHERE vendor = 'NATION_3' ORDER BY cnr DESC NULLS LAST, method LIMIT 10")
def sl1_prefix_cap(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten entries of one view in a fixed order: the cap is the feature."""
    top = _board(spark, folder).where("vendor = 'NATION_3'").orderBy(F.col("cnr").desc_nulls_last(), "method").limit(10)
    return top.select("method", "vendor", F.round("cnr", 6).alias("cnr"))


@query(f"{ENTRIES} SELECT vendor, max_by(method, cnr) AS best, min_by(method, cnr) AS last FROM e GROUP BY vendor")
def sl2_arg_pick(spark: SparkSession, folder: str) -> DataFrame:
    return _board(spark, folder).groupBy("vendor").agg(F.max_by("method", "cnr").alias("best"), F.min_by("method", "cnr").alias("last"))


@query("WITH e AS (SELECT o_orderpriority AS method, n_name AS vendor, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT method, vendor, y::INT AS year, round(v, 4) AS value, row_number() OVER (ORDER BY v DESC NULLS LAST, method, vendor) AS place FROM e WHERE y = 1997")
def sl4_board_view(spark: SparkSession, folder: str) -> DataFrame:
    """A board filtered by year and sorted by one metric; its place column has one row a (method, vendor)."""
    from assayer.sources.tables import table

    o, c, n = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    e = o.where(F.year("o_orderdate") == 1997).join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    e = e.groupBy(F.col("o_orderpriority").alias("method"), F.col("n_name").alias("vendor"), F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("v"))
    place = F.row_number().over(Window.orderBy(F.col("v").desc_nulls_last(), "method", "vendor"))
    return e.select("method", "vendor", "year", F.round("v", 4).alias("value"), place.cast("long").alias("place"))
