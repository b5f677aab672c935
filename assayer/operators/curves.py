"""Curves over doses: crossings, knees, gains, and rank statistics of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.operators.board import finite
from assayer.operators.ranks import below, mid_ranks, same
from assayer.operators.registry import query
from assayer.operators.summaries import rounded
from assayer.plans.measures import SLICES, slices
from assayer.sources.tables import table


def steps(curve: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Adds the point before within its curve: x0, y0."""
    w = Window.partitionBy(*by).orderBy(x)
    return curve.withColumns({"x0": F.lag(x).over(w), "y0": F.lag(y).over(w)})


def crossing(curve: DataFrame, by: list[str], x: str, y: str, level: float) -> DataFrame:
    """First x at which the curve rises through the level, by linear interpolation; null if it never does."""
    at = F.col("x0") + F.when(F.col(y) != F.col("y0"), (level - F.col("y0")) / (F.col(y) - F.col("y0"))).otherwise(0.0) * (F.col(x) - F.col("x0"))
    hit = (F.col(y) >= level) & (F.col("y0") <= level)
    s = steps(curve.where(F.col(y).isNotNull()), by, x, y)
    return s.groupBy(*by).agg(F.min_by(F.when(hit, at), F.when(hit, F.col(x))).alias("crossing"), F.max_by(y, x).alias("last"))


def knee(curve: DataFrame, by: list[str], x: str, y: str, level: float) -> DataFrame:
    """The crossing with its status: nan, below (already at the first point), interp or not_reached."""
    s = steps(curve, by, x, y).withColumn("bad", ~finite(F.col(y)))
    at = F.col("x0") + (level - F.col("y0")) / (F.col(y) - F.col("y0")) * (F.col(x) - F.col("x0"))
    hit = (F.col(y) >= level) & (F.col("y0") < level) & ~F.col("bad")
    g = s.groupBy(*by).agg(F.min(x).alias("first_x"), F.min_by(y, x).alias("first_y"), F.min(F.when(F.col("bad"), F.col(x))).alias("bad_x"), F.min(F.when(hit, F.col(x))).alias("hit_x"), F.min_by(F.when(hit, at), F.when(hit, F.col(x))).alias("at"))
    blind = ~finite(F.col("first_y")) | (F.col("bad_x").isNotNull() & (F.col("hit_x").isNull() | (F.col("bad_x") < F.col("hit_x"))))
    start = finite(F.col("first_y")) & (F.col("first_y") >= level)
    status = F.when(start, "below").when(blind, "nan").when(F.col("hit_x").isNotNull(), "interp").otherwise("not_reached")
    return g.select(*by, F.when(start, F.col("first_x")).when(~blind, F.col("at")).alias("knee"), status.alias("status"))


def max_gain(curve: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The step with the largest gain, the first of equals: its ends, middle and gain."""
    s = steps(curve.where(F.col(y).isNotNull()), by, x, y).where("x0 is not null")
    best = F.max_by(F.struct(F.col("x0").alias("low"), F.col(x).alias("high"), (F.col(y) - F.col("y0")).alias("gain")), F.struct(F.col(y) - F.col("y0"), -F.col(x)))
    return s.groupBy(*by).agg(best.alias("b")).select(*by, "b.low", "b.high", ((F.col("b.low") + F.col("b.high")) / 2).alias("middle"), "b.gain")


def mid_rank(by: list[str], value: str) -> Column:
    """Mean rank of tied values, smallest first, for small groups; ``ranks.mid_ranks`` is for groups of any size."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def rank_auc(rows: DataFrame, by: list[str], label: str, score: str, wide: bool = False) -> DataFrame:
    """Mann-Whitney area under the curve, ties counted half: n log n, never all pairs.

    Scores are counted per distinct value first; ``wide`` ranks a group of many distinct scores range by range.
    """
    c = _by_score(rows, by, label, score, wide).withColumn("won", F.col("p") * (F.col("q_below") + F.col("q") / 2))
    out = c.groupBy(*by).agg(F.sum("p").cast("long").alias("n_pos"), F.sum("q").cast("long").alias("n_neg"), F.sum("won").alias("won"))
    return out.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("won") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def _by_score(rows: DataFrame, by: list[str], label: str, score: str, wide: bool) -> DataFrame:
    """Positives p and negatives q per distinct score, with those of smaller scores; a row without a score or label is left out."""
    c = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    return below(c, by, score, ["p", "q"], wide)


def placements(rows: DataFrame, by: list[str], label: str, score: str, name: str, wide: bool = False) -> DataFrame:
    """Adds each row's placement among the other class: the share of it below, ties half.

    Worked out per distinct score and joined back; a row without a score or label is left out.
    """
    c = _by_score(rows, by, label, score, wide)
    share = lambda x: F.try_divide(F.col(f"{x}_below") + F.col(x) / 2, F.col(f"{x}_all"))
    v = same(rows.where(F.col(label).isNotNull()), c.select(*by, score, share("q").alias("_q"), (1 - share("p")).alias("_p")), [*by, score])
    return v.withColumn(name, F.when(F.col(label) == 1, F.col("_q")).otherwise(F.col("_p"))).drop("_q", "_p")


def delong(rows: DataFrame, by: list[str], label: str, a: str, b: str, z: float = 1.959963984540054, wide: bool = False) -> DataFrame:
    """Difference of two paired areas with its interval from the variance of placements; rows need both scores."""
    rows = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    p = placements(placements(rows, by, label, a, "va", wide), by, label, b, "vb", wide).withColumn("d", F.col("va") - F.col("vb"))
    pos = F.when(F.col(label) == 1, F.col("d"))
    neg = F.when(F.col(label) == 0, F.col("d"))
    count = lambda k: F.count(F.when(F.col(label) == k, 1))
    g = p.groupBy(*by).agg(count(1).alias("n_pos"), count(0).alias("n_neg"), F.avg(pos).alias("diff"), F.sqrt(F.try_divide(F.var_samp(pos), F.count(pos)) + F.try_divide(F.var_samp(neg), F.count(neg))).alias("se"))
    return g.select(*by, "n_pos", "n_neg", "diff", (F.col("diff") - z * F.col("se")).alias("low"), (F.col("diff") + z * F.col("se")).alias("high"))


_CURVE = f"WITH {SLICES}, c AS (SELECT vendor, method, dose, avg(cnr) - 20 * (0.6 - dose) AS y FROM s GROUP BY vendor, method, dose), p AS (SELECT *, lag(dose) OVER w AS x0, lag(y) OVER w AS y0 FROM c WINDOW w AS (PARTITION BY vendor, method ORDER BY dose))"
_LEVEL = 40.0


def _curve(spark: SparkSession, folder: str) -> DataFrame:
    return slices(spark, folder).groupBy("vendor", "method", "dose").agg((F.avg("cnr") - 20 * (0.6 - F.col("dose"))).alias("y"))


@query(f"{_CURVE}, h AS (SELECT *, x0 + CASE WHEN y <> y0 THEN ({_LEVEL} - y0) / (y - y0) ELSE 0 END * (dose - x0) AS hit FROM p WHERE y >= {_LEVEL} AND y0 <= {_LEVEL}), f AS (SELECT vendor, method, min_by(hit, dose) AS crossing FROM h GROUP BY ALL) SELECT l.vendor, l.method, round(crossing, 6) AS crossing, round(last, 6) AS last FROM (SELECT vendor, method, max_by(y, dose) AS last FROM c GROUP BY ALL) l LEFT JOIN f USING (vendor, method)")
def win6_rose_crossing(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(crossing(_curve(spark, folder), ["vendor", "method"], "dose", "y", _LEVEL), ["crossing", "last"])


@query(f"{_CURVE}, h AS (SELECT vendor, method, min_by(x0 + ({_LEVEL} - y0) / (y - y0) * (dose - x0), dose) AS hit FROM p WHERE y >= {_LEVEL} AND y0 < {_LEVEL} GROUP BY ALL), g AS (SELECT vendor, method, min_by(y, dose) AS y1, min(dose) AS x1 FROM c GROUP BY ALL) SELECT vendor, method, round(CASE WHEN y1 >= {_LEVEL} THEN x1 ELSE hit END, 6) AS knee, CASE WHEN y1 >= {_LEVEL} THEN 'below' WHEN hit IS NOT NULL THEN 'interp' ELSE 'not_reached' END AS status FROM g LEFT JOIN h USING (vendor, method)")
def win7_knee(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(knee(_curve(spark, folder), ["vendor", "method"], "dose", "y", _LEVEL), ["knee"])


@query(f"{_CURVE}, r AS (SELECT *, row_number() OVER (PARTITION BY vendor, method ORDER BY y - y0 DESC, dose) AS k FROM p WHERE x0 IS NOT NULL) SELECT vendor, method, x0 AS low, dose AS high, round((x0 + dose) / 2, 6) AS middle, round(y - y0, 6) AS gain FROM r WHERE k = 1")
def win8_max_gain_interval(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(max_gain(_curve(spark, folder), ["vendor", "method"], "dose", "y"), ["middle", "gain"])


@query(f"{_CURVE} SELECT vendor, method, list(round(y, 4) ORDER BY dose) AS curve, round(min(abs(y - {_LEVEL})), 6) AS closest FROM c GROUP BY ALL")
def win9_dose_curve(spark: SparkSession, folder: str) -> DataFrame:
    pts = F.array_sort(F.collect_list(F.struct("dose", F.round("y", 4).alias("y"))))
    return _curve(spark, folder).groupBy("vendor", "method").agg(F.transform(pts, lambda p: p["y"]).alias("curve"), F.round(F.min(F.abs(F.col("y") - _LEVEL)), 6).alias("closest"))


_SCORES = "d AS (SELECT lang, quality AS label, n_chars AS a, (doc_id * 7919) % 1009 AS b FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").where("quality is not null")
    return d.select("lang", F.col("quality").alias("label"), F.col("n_chars").alias("a"), ((F.col("doc_id") * 7919) % 1009).alias("b"))


@query(f"WITH {_SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY a) + (count(*) OVER (PARTITION BY lang, a) - 1) / 2 AS r FROM d) SELECT lang, sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg, round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * sum(1 - label), 0), 6) AS auc FROM r GROUP BY lang")
def win5_rank_auc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rank_auc(_scores(spark, folder), ["lang"], "label", "a"), ["auc"])


def _pairs_sql(s: str) -> str:
    return f"CASE WHEN label = 1 THEN (coalesce(sum(1 - label) OVER (PARTITION BY lang ORDER BY {s} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(1 - label) OVER (PARTITION BY lang ORDER BY {s} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2 / nullif(sum(1 - label) OVER (PARTITION BY lang), 0) ELSE 1 - (coalesce(sum(label) OVER (PARTITION BY lang ORDER BY {s} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(label) OVER (PARTITION BY lang ORDER BY {s} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2 / nullif(sum(label) OVER (PARTITION BY lang), 0) END"


@query(f"WITH {_SCORES}, p AS (SELECT lang, label, {_pairs_sql('a')} - {_pairs_sql('b')} AS d FROM d), g AS (SELECT lang, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, avg(d) FILTER (label = 1) AS diff, sqrt(var_samp(d) FILTER (label = 1) / nullif(count(*) FILTER (label = 1), 0) + var_samp(d) FILTER (label = 0) / nullif(count(*) FILTER (label = 0), 0)) AS se FROM p GROUP BY lang) SELECT lang, n_pos, n_neg, round(diff, 6) AS diff, round(diff - 1.959963984540054 * se, 6) AS low, round(diff + 1.959963984540054 * se, 6) AS high FROM g")
def bs3_delong_ci(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(delong(_scores(spark, folder), ["lang"], "label", "a", "b"), ["diff", "low", "high"])


@query(f"WITH {_SCORES}, r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY a) + (count(*) OVER (PARTITION BY lang, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY lang ORDER BY b) + (count(*) OVER (PARTITION BY lang, b) - 1) / 2 AS rb FROM d) SELECT lang, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY lang")
def im18_spearman(spark: SparkSession, folder: str) -> DataFrame:
    r = mid_ranks(mid_ranks(_scores(spark, folder), ["lang"], "a", "ra"), ["lang"], "b", "rb")
    return r.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("rho"))
