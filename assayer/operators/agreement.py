"""Agreement of raters: kappa, intraclass correlation, drift and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.operators.ranks import positions, ranges, same
from assayer.operators.registry import query
from assayer.operators.summaries import rounded
from assayer.sources.tables import table


def cohen_kappa(rows: DataFrame, by: list[str], a: str, b: str, linear: bool = False) -> DataFrame:
    """Per group from the table of counts: kappa, unweighted or with linear weights over category ranks.

    One shared category gives 1. The rows are counted once; what follows is over pairs of categories.
    """
    counts = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    kinds = counts.select(*by, F.explode(F.array("a", "b")).alias("c")).distinct()
    kinds = kinds.withColumn("r", F.dense_rank().over(Window.partitionBy(*by).orderBy("c")))
    cell = counts.join(kinds.select(*by, F.col("c").alias("a"), F.col("r").alias("ra")), [*by, "a"]).join(kinds.select(*by, F.col("c").alias("b"), F.col("r").alias("rb")), [*by, "b"])
    weight = F.abs(F.col("ra") - F.col("rb")) if linear else (F.col("ra") != F.col("rb")).cast("int")
    seen = cell.groupBy(*by).agg(F.sum(weight * F.col("n")).alias("seen"), F.sum("n").alias("total"))
    left, right = cell.groupBy(*by, "ra").agg(F.sum("n").alias("x")), cell.groupBy(*by, "rb").agg(F.sum("n").alias("y"))
    chance = left.join(right, by).groupBy(*by).agg(F.sum(weight * F.col("x") * F.col("y")).alias("chance"))
    k = 1 - F.col("seen") * F.col("total") / F.when(F.col("chance") > 0, F.col("chance"))
    return seen.join(chance, by).select(*by, F.col("total").alias("n"), F.coalesce(k, F.lit(1.0)).alias("kappa"))


def icc_2k(rows: DataFrame, by: list[str], target: str, rater: str, score: str) -> DataFrame:
    """Two-way random intraclass correlation of the mean of k raters, from sums of squares."""
    g = rows.groupBy(*by).agg(F.avg(score).alias("grand"), F.sum(F.col(score) * F.col(score)).alias("sq"), F.count("*").alias("cells"))
    t = rows.groupBy(*by, target).agg(F.avg(score).alias("mean")).groupBy(*by).agg(F.count("*").alias("m"), F.sum(F.col("mean") * F.col("mean")).alias("rows2"))
    r = rows.groupBy(*by, rater).agg(F.avg(score).alias("mean")).groupBy(*by).agg(F.count("*").alias("k"), F.sum(F.col("mean") * F.col("mean")).alias("cols2"))
    c = g.join(t, by).join(r, by)
    m, k, g2 = F.col("m"), F.col("k"), F.col("grand") * F.col("grand")
    c = c.withColumns({"sst": F.col("sq") - m * k * g2, "ssr": k * (F.col("rows2") - m * g2), "ssc": m * (F.col("cols2") - k * g2)})
    c = c.withColumn("e", (F.col("sst") - F.col("ssr") - F.col("ssc")) / ((m - 1) * (k - 1))).withColumn("r", F.col("ssr") / (m - 1))
    one = (F.col("r") - F.col("e")) / (F.col("r") + (k - 1) * F.col("e") + k * (F.col("ssc") / (k - 1) - F.col("e")) / m)
    c = c.withColumn("one", one)
    return c.select(*by, "m", "k", (k * F.col("one") / (1 + (k - 1) * F.col("one"))).alias("icc"))


def drift(cases: DataFrame, reader: str, order: list[str], agrees: str, window: int = 50, least: float = 0.6) -> DataFrame:
    """Per reader and window of cases: share of agreement, whether it pauses the reader, the last passing window before."""
    k = F.floor((F.row_number().over(Window.partitionBy(reader).orderBy(*order)) - 1) / window)
    w = cases.withColumn("block", k).groupBy(reader, "block").agg(F.count("*").alias("n"), F.avg(F.col(agrees).cast("double")).alias("share"))
    before = Window.partitionBy(reader).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("paused", F.col("share") < least)
    return w.withColumn("last_pass", F.last(F.when(~F.col("paused"), F.col("block")), ignorenulls=True).over(before))


def micros(rows: DataFrame, time: str) -> Column:
    """Microseconds of a time, or a number as it is; a time without a zone counts from 1970 in the session's zone."""
    kind = dict(rows.dtypes)[time]
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col(time))
    return F.unix_micros(time) if kind == "timestamp" else F.col(time)


#: Windows of one reader that are looked over at once.
_CHUNK = 4096


def kappa_drift(cases: DataFrame, reader: str, order: list[str], a: str, b: str, window: int = 50, least: float = 0.6) -> DataFrame:
    """(reader, window, n, kappa, paused, last_pass): kappa against the calibration in every window of a reader's cases, in order, whether it
    pauses the reader, and the last window before that did not.

    Cases are numbered range by range of the first of ``order``, so a reader with most of the cases is not one task's; cases without an
    answer or a calibration take no place.
    """
    c = cases.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(reader, *order, F.col(a).alias("_a"), F.col(b).alias("_b"), micros(cases, order[0]).alias("_at"))
    numbered = positions(c, [reader], order, ranges(c, "_at"), "_place")
    w = cohen_kappa(numbered.withColumn("window", F.floor(F.col("_place") / window)), [reader, "window"], "_a", "_b")
    w = w.withColumns({"paused": F.col("kappa") < least, "_chunk": F.floor(F.col("window") / _CHUNK)})
    passed = F.max(F.when(~F.col("paused"), F.col("window")))
    until = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    chunks = w.groupBy(reader, "_chunk").agg(passed.alias("_p")).withColumn("_before", F.max("_p").over(until([reader], "_chunk"))).drop("_p")
    w = w.withColumn("_own", passed.over(until([reader, "_chunk"], "window")))
    return same(w, chunks, [reader, "_chunk"]).select(reader, "window", "n", "kappa", "paused", F.coalesce("_own", "_before").alias("last_pass"))


_RATED = "e AS (SELECT event_type AS reader, user_id % 4 AS a, CASE WHEN value > 20 THEN (user_id + 1) % 4 ELSE user_id % 4 END AS b FROM events WHERE value IS NOT NULL)"


def _rated(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").where("value is not null")
    return e.select(F.col("event_type").alias("reader"), (F.col("user_id") % 4).alias("a"), F.when(F.col("value") > 20, (F.col("user_id") + 1) % 4).otherwise(F.col("user_id") % 4).alias("b"))


_KAPPA = "c AS (SELECT reader, a, b, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT reader, sum(n) AS n, sum({w} * n) AS seen FROM c GROUP BY reader), x AS (SELECT reader, a, sum(n) AS x FROM c GROUP BY ALL), y AS (SELECT reader, b, sum(n) AS y FROM c GROUP BY ALL), p AS (SELECT reader, sum({w} * x * y) AS chance FROM x JOIN y USING (reader) GROUP BY reader) SELECT reader, n::BIGINT AS n, round(coalesce(1 - seen * n / nullif(chance, 0)::DOUBLE, 1), 6) AS kappa FROM t JOIN p USING (reader)"


@query(f"WITH {_RATED}, {_KAPPA.format(w='(a <> b)::INT')}")
def ag16_cohen_kappa(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cohen_kappa(_rated(spark, folder), ["reader"], "a", "b"), ["kappa"])


@query(f"WITH {_RATED}, {_KAPPA.format(w='abs(a - b)')}")
def ag18_weighted_kappa(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cohen_kappa(_rated(spark, folder), ["reader"], "a", "b", linear=True), ["kappa"])


@query(f"WITH {_RATED}, k AS ({'SELECT * FROM (WITH ' + _KAPPA.format(w='(a <> b)::INT') + ')'}) SELECT round(min(kappa), 6) AS least_kappa, count(*) AS n_pairs, min(kappa) >= 0.6 AS passes FROM k")
def ag20_reader_gate(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs must agree: the least finite kappa against 0.60."""
    k = cohen_kappa(_rated(spark, folder), ["reader"], "a", "b").where(~F.isnan("kappa"))
    return k.agg(F.round(F.min("kappa"), 6).alias("least_kappa"), F.count("*").alias("n_pairs"), (F.min("kappa") >= 0.6).alias("passes"))


_LIKERT = "l AS (SELECT c_mktsegment AS recon, c_custkey AS target, r.i AS rater, c_acctbal + ((c_custkey * 7919 + r.i * 104729) % 2003) AS score FROM customer, (SELECT unnest(range(4)) AS i) r)"


@query(f"WITH {_LIKERT}, g AS (SELECT recon, avg(score) AS g, sum(score * score) AS sq FROM l GROUP BY recon), t AS (SELECT recon, count(*) AS m, sum(x * x) AS r2 FROM (SELECT recon, target, avg(score) AS x FROM l GROUP BY ALL) GROUP BY recon), c AS (SELECT recon, count(*) AS k, sum(x * x) AS c2 FROM (SELECT recon, rater, avg(score) AS x FROM l GROUP BY ALL) GROUP BY recon), s AS (SELECT recon, m, k, sq - m * k * g * g AS sst, k * (r2 - m * g * g) AS ssr, m * (c2 - k * g * g) AS ssc FROM g JOIN t USING (recon) JOIN c USING (recon)), e AS (SELECT *, (sst - ssr - ssc) / ((m - 1) * (k - 1)) AS e, ssr / (m - 1) AS r FROM s), o AS (SELECT *, (r - e) / (r + (k - 1) * e + k * (ssc / (k - 1) - e) / m) AS one FROM e) SELECT recon, m, k, round(k * one / (1 + (k - 1) * one), 6) AS icc FROM o")
def ag19_icc_2k(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    rows = c.select(F.col("c_mktsegment").alias("recon"), F.col("c_custkey").alias("target"), F.col("i").alias("rater"), (F.col("c_acctbal") + (F.col("c_custkey") * 7919 + F.col("i") * 104729) % 2003).alias("score"))
    return rounded(icc_2k(rows, ["recon"], "target", "rater", "score"), ["icc"])


@query("WITH e AS (SELECT event_type AS reader, (value <= 20)::INT AS ok, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 50 AS w FROM events), s AS (SELECT reader, w AS wno, count(*) AS n, avg(ok) AS share FROM e GROUP BY ALL), p AS (SELECT *, share < 0.6 AS paused FROM s) SELECT reader, wno AS block, n, round(share, 6) AS share, paused, last_value(CASE WHEN NOT paused THEN wno END IGNORE NULLS) OVER (PARTITION BY reader ORDER BY wno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_pass FROM p")
def win12_drift_window(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("event_type").alias("reader"), (F.col("value") <= 20).cast("int").alias("ok"), "ts", "event_id")
    return rounded(drift(e, "reader", ["ts", "event_id"], "ok"), ["share"])


_TIMED = "e AS (SELECT event_type AS reader, user_id % 4 AS a, CASE WHEN value > 20 THEN (user_id + 1) % 4 ELSE user_id % 4 END AS b, ts, event_id FROM events WHERE value IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL{more})"
#: Windows of fifty in order of time, and the kappa of each.
KAPPA_WINDOWS = (
    f"{_TIMED}, w AS (SELECT reader, a, b, (row_number() OVER (PARTITION BY reader ORDER BY ts, event_id) - 1) // 50 AS win FROM e), c AS (SELECT reader, win, a, b, count(*) AS n FROM w GROUP BY ALL), "
    "t AS (SELECT reader, win, sum(n) AS n, sum((a <> b)::INT * n) AS seen FROM c GROUP BY ALL), x AS (SELECT reader, win, a, sum(n) AS x FROM c GROUP BY ALL), y AS (SELECT reader, win, b, sum(n) AS y FROM c GROUP BY ALL), "
    "h AS (SELECT reader, win, sum((a <> b)::INT * x * y) AS chance FROM x JOIN y USING (reader, win) GROUP BY ALL), "
    "k AS (SELECT reader, win, n, coalesce(1 - seen * n / nullif(chance, 0)::DOUBLE, 1) AS kappa FROM t JOIN h USING (reader, win))"
)


def timed_ratings(events: DataFrame) -> DataFrame:
    e = events.where("value is not null and ts is not null and user_id is not null")
    other = F.when(F.col("value") > 20, (F.col("user_id") + 1) % 4).otherwise(F.col("user_id") % 4)
    return e.select(F.col("event_type").alias("reader"), "ts", "event_id", (F.col("user_id") % 4).alias("a"), other.alias("b"))


@query(
    f"WITH {KAPPA_WINDOWS.format(more='')} SELECT reader, win AS window, n::BIGINT AS n, round(kappa, 6) AS kappa, kappa < 0.6 AS paused, "
    "max(CASE WHEN kappa >= 0.6 THEN win END) OVER (PARTITION BY reader ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_pass FROM k"
)
def win12_kappa_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Readers held against their calibration in windows of fifty cases, in order of time."""
    return rounded(kappa_drift(timed_ratings(table(spark, folder, "events")), "reader", ["ts", "event_id"], "a", "b"), ["kappa"])
