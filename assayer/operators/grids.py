"""Image arrays as data: an image is an array in its row, so no pixel is shuffled.

Sums over pixels are array expressions. Stencils need many pixels for each one and go through NumPy an image at a time, in Arrow
batches; there an image is null or of ``side`` by ``side`` pixels, all else gives null, and a missing pixel makes NaN of what it reaches.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.operators.registry import query
from assayer.operators.summaries import rounded
from assayer.sources.tables import table

SIDE = 8
#: A separable smoothing kernel over three neighbours.
TAPS = [(-1, 0.25), (0, 0.5), (1, 0.25)]
#: Width and reach of the Gaussian below the high band, in pixels.
BAND = (1.0, 4)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mse(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))) / F.size(a)


def psnr(a: Column, b: Column, span: float) -> Column:
    """20 log10(span) - 10 log10(mse), infinite for equal images."""
    e = mse(a, b)
    return F.when(e > 0, 20 * F.log10(F.lit(span)) - 10 * F.log10(e)).otherwise(float("inf"))


def normalize(a: Column, low: float, width: float) -> Column:
    return F.transform(a, lambda v: F.least(F.greatest((v.cast("double") - low) / width, F.lit(0.0)), F.lit(1.0)))


def pixels(images: DataFrame, key: str, px: str, side: int) -> DataFrame:
    """key, y, x, v: one row a pixel."""
    return placed(images.select(key, F.col(px).alias("v")), key, side)


def placed(images: DataFrame, key: str, width: int) -> DataFrame:
    """key, y, x, v of an array column ``v`` of rows of ``width``; no shuffle."""
    p = images.select(key, F.posexplode("v").alias("i", "v"))
    return p.select(key, F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).alias("x"), F.col("v").cast("double").alias("v"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where a lambda inside uses it for every element; null of null."""
    return F.get(F.transform(F.array(value), lambda v: F.when(v.isNotNull(), body(v))), F.lit(0))


def doubles(a: Column) -> Column:
    return F.transform(a, lambda v: v.cast("double"))


def image(height: int, width: int, f: Callable[[Column, Column], Column]) -> Column:
    """The array of f(y, x), row by row."""
    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: f(F.floor(i / width).cast("int"), i % width))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def spread(a: Column) -> Column:
    """Population standard deviation."""
    return let(mean(a), lambda m: F.sqrt(total(F.transform(a, lambda v: (v - m) * (v - m))) / F.size(a)))


def gaussian(sigma: float, reach: int) -> list[tuple[int, float]]:
    """Taps of a Gaussian cut at ``reach``, of sum 1."""
    raw = [exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    return [(d, w / sum(raw)) for d, w in zip(range(-reach, reach + 1), raw, strict=True)]


def smooth(a: Column, side: int, taps: list[tuple[int, float]]) -> Column:
    """Separable stencil, one axis a pass; an edge is mirrored with the edge repeated."""
    reach = max(abs(d) for d, _ in taps)

    def stencil(v: np.ndarray) -> np.ndarray:
        p = np.pad(v.reshape(side, side), reach, mode="symmetric")
        down = sum(w * p[reach + d : reach + d + side] for d, w in taps)
        return sum(w * down[:, reach + d : reach + d + side] for d, w in taps).ravel()

    @F.pandas_udf("array<double>")
    def run(images: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or len(v) != side * side else stencil(np.asarray(v, float)) for v in images], dtype=object)

    return run(a)


def highpass(a: Column, side: int, taps: list[tuple[int, float]]) -> Column:
    return F.zip_with(doubles(a), smooth(a, side, taps), lambda v, g: v - g)


def sobel(a: Column, side: int) -> Column:
    """Gradient magnitude of the inner pixels, an array of ``side - 2`` by ``side - 2``."""

    def gradient(v: np.ndarray) -> np.ndarray:
        p = v.reshape(side, side)
        across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
        return np.hypot(across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]).ravel()

    @F.pandas_udf("array<double>")
    def run(images: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or len(v) != side * side else gradient(np.asarray(v, float)) for v in images], dtype=object)

    return run(a)


def ssim(a: Column, b: Column, side: int, taps: list[tuple[int, float]], span: float = 1.0) -> Column:
    """Mean structural similarity over pixels whose window lies inside, from five windowed moments."""
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    reach = max(abs(d) for d, _ in taps)
    inner = side - 2 * reach

    def similarity(x: np.ndarray, y: np.ndarray) -> float:
        def moment(v: np.ndarray) -> np.ndarray:
            down = sum(w * v[reach + d : reach + d + inner] for d, w in taps)
            return sum(w * down[:, reach + d : reach + d + inner] for d, w in taps)

        x, y = x.reshape(side, side), y.reshape(side, side)
        p, t, pp, tt, pt = (moment(v) for v in (x, y, x * x, y * y, x * y))
        return float(np.mean((2 * p * t + c1) * (2 * (pt - p * t) + c2) / ((p * p + t * t + c1) * (pp - p * p + tt - t * t + c2))))

    @F.pandas_udf("double")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        whole = lambda v: v is not None and len(v) == side * side
        return pd.Series([similarity(np.asarray(x, float), np.asarray(y, float)) if whole(x) and whole(y) else None for x, y in zip(xs, ys, strict=True)], dtype=float)

    return run(a, b)


def best_patch(a: Column, size: int, side: int) -> Column:
    """(top, left, score) of the patch with the best score: mean value less a share of its spread; ties by place."""

    def best(v: np.ndarray) -> tuple:
        patches = np.lib.stride_tricks.sliding_window_view(v.reshape(side, side), (size, size))
        score = patches.mean((2, 3)) - 0.5 * patches.std((2, 3))
        top, left = divmod(int(np.argmax(np.round(score, 9))), score.shape[1])
        return top, left, float(score[top, left])

    @F.pandas_udf("top int, left int, score double")
    def run(images: pd.Series) -> pd.DataFrame:
        found = [(None, None, None) if v is None or len(v) != side * side else best(np.asarray(v, float)) for v in images]
        return pd.DataFrame(found, columns=["top", "left", "score"])

    return run(a)


def peak(a: Column, side: int, reach: int = 1, margin: int = 1) -> Column:
    """(y, x, v) of the strongest pixel off the margin that none within ``reach`` exceeds; ties by place, nulls if there is none."""

    def strongest(v: np.ndarray) -> tuple:
        p = v.reshape(side, side)
        around = np.pad(p, reach, constant_values=-np.inf)
        top = np.lib.stride_tricks.sliding_window_view(around, (2 * reach + 1, 2 * reach + 1)).max((2, 3))
        at = np.where(p == top, p, -np.inf)[margin : side - margin, margin : side - margin]
        y, x = divmod(int(np.argmax(at)), at.shape[1])
        return (y + margin, x + margin, float(at[y, x])) if at[y, x] > -np.inf else (None, None, None)

    @F.pandas_udf("y int, x int, v double")
    def run(images: pd.Series) -> pd.DataFrame:
        found = [(None, None, None) if v is None or len(v) != side * side else strongest(np.asarray(v, float)) for v in images]
        return pd.DataFrame(found, columns=["y", "x", "v"])

    return run(a)


def weighed(a: Column, weights: list[float]) -> Column:
    return total(F.zip_with(doubles(a), F.lit(weights), lambda v, w: v * w))


def centred(side: int, sigma: float) -> list[float]:
    """A Gaussian about the middle of the grid, row by row."""
    c = (side - 1) / 2
    return [exp(-((y - c) ** 2 + (x - c) ** 2) / (2 * sigma**2)) for y in range(side) for x in range(side)]


def matched_filter(a: Column, side: int, sigma: float) -> Column:
    """Response to a fixed zero-mean template at the centre: linear, so one weighted sum a slice."""
    raw = centred(side, sigma)
    return weighed(a, [v - sum(raw) / len(raw) for v in raw])


def channel_responses(a: Column, side: int, channels: list[tuple[float, float]]) -> Column:
    """Responses to difference-of-Gaussian channels at the centre."""
    return F.array(*(weighed(a, [u - v for u, v in zip(centred(side, s), centred(side, t), strict=True)]) for s, t in channels))


def part(a: Column, side: int, inside: Callable[[Column, Column], Column]) -> Column:
    """The pixels at places for which ``inside(y, x)`` holds."""
    return F.filter(doubles(a), lambda v, i: inside(F.floor(i / side), i % side))


def level(a: Column, q: float) -> Column:
    """Quantile of an array by linear interpolation; equal neighbours give their own value."""
    def between(s: Column) -> Column:
        at = (F.size(s) - 1) * q
        low = F.floor(at).cast("int")
        return F.get(s, low) + F.coalesce((F.get(s, low + 1) - F.get(s, low)) * (at - low), F.lit(0.0))

    return let(F.array_sort(a), between)


def correlation(a: Column, b: Column) -> Column:
    """Zero-mean correlation of two arrays; 0 if either is constant."""
    n = F.size(a)
    ma, mb = total(a) / n, total(b) / n
    dot = lambda x, y, mx, my: F.aggregate(F.zip_with(x, y, lambda p, q: (p.cast("double") - mx) * (q.cast("double") - my)), F.lit(0.0), lambda s, v: s + v)
    d = F.sqrt(dot(a, a, ma, ma) * dot(b, b, mb, mb))
    return F.when(d > 0, dot(a, b, ma, mb) / d).otherwise(0.0)


def thinned(events: DataFrame, key: str, ratio: float) -> DataFrame:
    """Keeps each event with probability ``ratio`` by its own id, so that any run, batch or stream keeps the same ones."""
    from assayer.operators.resampling import uniform

    return events.where(uniform(F.lit(7), F.col(key)) < ratio)


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


_P = "p AS (SELECT x.vec_id, x.label, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"
_PX = "x AS (SELECT vec_id, label, (i // 8)::INT AS y, (i % 8)::INT AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS i))"
_SMOOTH = "k AS (SELECT unnest([-1, 0, 1]) AS d, unnest([0.25::DOUBLE, 0.5, 0.25]) AS w), a AS (SELECT vec_id, x, CASE WHEN y + d < 0 THEN -1 - y - d WHEN y + d > 7 THEN 15 - y - d ELSE y + d END AS y, sum(v * w) AS v FROM x, k GROUP BY ALL), g AS (SELECT vec_id, y, CASE WHEN x + d < 0 THEN -1 - x - d WHEN x + d > 7 THEN 15 - x - d ELSE x + d END AS x, sum(v * w) AS v FROM a, k GROUP BY ALL)"


@query(f"WITH {_P}, e AS (SELECT vec_id, list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 64 AS e FROM p) SELECT vec_id, round(CASE WHEN e > 0 THEN -10 * log10(e) ELSE 'inf'::DOUBLE END, 6) AS psnr FROM e")
def im1_psnr(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("vec_id", F.round(psnr(F.col("a"), F.col("b"), 1.0), 6).alias("psnr"))


@query(
    f"WITH {_PX}, k AS (SELECT unnest([-1, 0, 1]) AS d, unnest([0.25::DOUBLE, 0.5, 0.25]) AS w), m AS (SELECT a.vec_id, a.y, a.x, a.v AS p, b.v AS t FROM x a JOIN x b ON b.vec_id = a.vec_id + 1 AND a.y = b.y AND a.x = b.x), g AS (SELECT vec_id, y + j.d AS y, x + i.d AS x, sum(p * j.w * i.w) AS p, sum(t * j.w * i.w) AS t, sum(p * p * j.w * i.w) AS pp, sum(t * t * j.w * i.w) AS tt, sum(p * t * j.w * i.w) AS pt FROM m, k j, k i WHERE y + j.d BETWEEN 1 AND 6 AND x + i.d BETWEEN 1 AND 6 GROUP BY ALL) SELECT vec_id, round(avg((2 * p * t + 0.0001) * (2 * (pt - p * t) + 0.0009) / ((p * p + t * t + 0.0001) * (pp - p * p + tt - t * t + 0.0009))), 6) AS ssim FROM g GROUP BY vec_id"
)
def im2_ssim(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("vec_id", F.round(ssim(F.col("a"), F.col("b"), SIDE, TAPS), 6).alias("ssim"))


@query(f"WITH {_PX}, s AS (SELECT vec_id, t.a AS top, l.a AS \"left\", avg(v) - 0.5 * stddev_pop(v) AS score FROM x, (SELECT unnest(range(6))::INT AS a) t, (SELECT unnest(range(6))::INT AS a) l WHERE y BETWEEN t.a AND t.a + 2 AND x BETWEEN l.a AND l.a + 2 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, top, \"left\") AS k FROM s) SELECT vec_id, top, \"left\", round(score, 6) AS score FROM r WHERE k = 1")
def im8_tissue_roi(spark: SparkSession, folder: str) -> DataFrame:
    best = table(spark, folder, "embeddings").select("vec_id", best_patch(F.col("embedding"), 3, SIDE).alias("b"))
    return rounded(best.select("vec_id", "b.*"), ["score"])


@query(f"WITH {_PX}, e AS (SELECT vec_id, v, exp(-((y - 3.5) * (y - 3.5) + (x - 3.5) * (x - 3.5)) / 4.5) AS w FROM x), m AS (SELECT avg(w) AS m FROM e WHERE vec_id = 0) SELECT vec_id, round(sum(v * (w - m)), 6) AS score FROM e, m GROUP BY vec_id")
def im13_npwe_score(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.round(matched_filter(F.col("embedding"), SIDE, 1.5), 6).alias("score"))


@query(f"WITH {_PX}, {_SMOOTH} SELECT vec_id, y, x, round(v, 6) AS v FROM g")
def im4_blur_control(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(placed(table(spark, folder, "embeddings").select("vec_id", smooth(F.col("embedding"), SIDE, TAPS).alias("v")), "vec_id", SIDE), ["v"])


_REFLECT = "CASE WHEN {c} + d < 0 THEN -1 - {c} - d WHEN {c} + d > 7 THEN 15 - {c} - d ELSE {c} + d END"
_HIGH = f"r AS (SELECT d, exp(-0.5 * d * d / {BAND[0] ** 2}) AS e FROM (SELECT unnest(range(-{BAND[1]}, {BAND[1] + 1})) AS d)), k AS (SELECT d, e / (SELECT sum(e) FROM r) AS w FROM r), a AS MATERIALIZED (SELECT vec_id, x, {_REFLECT.format(c='y')} AS y, sum(v * w) AS v FROM x, k GROUP BY ALL), g AS MATERIALIZED (SELECT vec_id, y, {_REFLECT.format(c='x')} AS x, sum(v * w) AS v FROM a, k GROUP BY ALL), h AS MATERIALIZED (SELECT x.vec_id, x.y, x.x, x.v - g.v AS v FROM x JOIN g USING (vec_id, y, x))"


@query(f"WITH {_PX}, {_HIGH} SELECT vec_id, y, x, round(v, 6) AS v FROM h")
def im3_gaussian_highpass(spark: SparkSession, folder: str) -> DataFrame:
    """An image less its Gaussian: the band of about a pixel."""
    return rounded(placed(table(spark, folder, "embeddings").select("vec_id", highpass(F.col("embedding"), SIDE, gaussian(*BAND)).alias("v")), "vec_id", SIDE), ["v"])


@query(f"WITH {_PX}, {_HIGH}, e AS (SELECT vec_id, sum(v * v) AS whole, sum(v * v) FILTER (y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5) AS roi FROM h GROUP BY vec_id) SELECT a.vec_id, round(a.whole / b.whole, 6) AS full_ratio, round(a.roi / greatest(b.roi, 1e-4 * b.whole), 6) AS roi_ratio FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def im5_band_energy_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """High-frequency energy of an image over its reference's, whole and in the centre; the denominator has a floor."""
    h = table(spark, folder, "embeddings").select("vec_id", highpass(F.col("embedding"), SIDE, gaussian(*BAND)).alias("h"))
    sq = lambda a: total(F.transform(a, lambda v: v * v))
    roi = part(F.col("h"), SIDE, lambda y, x: y.between(2, 5) & x.between(2, 5))
    e = h.select("vec_id", sq(F.col("h")).alias("whole"), sq(roi).alias("roi"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("whole").alias("w"), F.col("roi").alias("r"))
    return rounded(e.join(b, "vec_id").select("vec_id", (F.col("whole") / F.col("w")).alias("full_ratio"), (F.col("roi") / F.greatest("r", 1e-4 * F.col("w"))).alias("roi_ratio")), ["full_ratio", "roi_ratio"])


@query("WITH a AS (SELECT x.vec_id, unnest(x.embedding)::DOUBLE AS p, unnest(y.embedding)::DOUBLE AS q FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1) SELECT vec_id, round(coalesce(corr(p, q), 0), 6) AS r FROM a GROUP BY vec_id")
def im6_template_corr(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("vec_id", F.round(correlation(F.col("a"), F.col("b")), 6).alias("r"))


@query(f"WITH {_PX}, m AS (SELECT a.vec_id, a.y, a.x, a.v, max(b.v) AS top FROM x a JOIN x b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, y, x) AS k FROM m WHERE v = top) SELECT vec_id, y, x, round(v, 6) AS v FROM r WHERE k = 1")
def im7_micro_peak(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest local maximum off the margin."""
    best = table(spark, folder, "embeddings").select("vec_id", peak(F.col("embedding"), SIDE).alias("b")).where("b.v is not null")
    return rounded(best.select("vec_id", "b.*"), ["v"])


@query(f"WITH {_PX}, k AS (SELECT * FROM (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)) t(dy, dx, gx, gy)), s AS (SELECT vec_id, y - dy AS y, x - dx AS x, sum(v * gx) AS gx, sum(v * gy) AS gy, count(*) AS n FROM x, k GROUP BY ALL) SELECT vec_id, y, x, round(sqrt(gx * gx + gy * gy), 6) AS g FROM s WHERE n = 8")
def im9_sobel_gradient(spark: SparkSession, folder: str) -> DataFrame:
    g = placed(table(spark, folder, "embeddings").select("vec_id", sobel(F.col("embedding"), SIDE).alias("v")), "vec_id", SIDE - 2)
    return g.select("vec_id", (F.col("y") + 1).alias("y"), (F.col("x") + 1).alias("x"), F.round("v", 6).alias("g"))


@query(f"WITH {_PX}, s AS (SELECT vec_id, avg(v) FILTER (y BETWEEN 3 AND 4 AND x BETWEEN 3 AND 4) AS m1, avg(v) FILTER (y < 2) AS m0, stddev_pop(v) FILTER (y < 2) AS sd FROM x GROUP BY vec_id) SELECT vec_id, round(CASE WHEN sd > 0 THEN (m1 - m0) / sd ELSE 'inf'::DOUBLE END, 6) AS cnr FROM s")
def im10_roi_cnr(spark: SparkSession, folder: str) -> DataFrame:
    px = F.col("embedding")
    inside, outside = part(px, SIDE, lambda y, x: y.between(3, 4) & x.between(3, 4)), part(px, SIDE, lambda y, x: y < 2)
    s = table(spark, folder, "embeddings").select("vec_id", mean(inside).alias("m1"), mean(outside).alias("m0"), spread(outside).alias("sd"))
    return s.select("vec_id", F.round(F.when(F.col("sd") > 0, (F.col("m1") - F.col("m0")) / F.col("sd")).otherwise(float("inf")), 6).alias("cnr"))


_CHANNELS = [(0.5, 1.0), (1.0, 2.0), (2.0, 4.0), (4.0, 8.0)]


@query(f"WITH {_PX}, c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(_CHANNELS)) + ") t(channel, a, b)) SELECT vec_id, channel, round(sum(v * (exp(-((y - 3.5) * (y - 3.5) + (x - 3.5) * (x - 3.5)) / (2 * a * a)) - exp(-((y - 3.5) * (y - 3.5) + (x - 3.5) * (x - 3.5)) / (2 * b * b)))), 6) AS response FROM x, c GROUP BY ALL")
def im11_channel_response(spark: SparkSession, folder: str) -> DataFrame:
    """Responses to difference-of-Gaussian channels at the centre."""
    r = table(spark, folder, "embeddings").select("vec_id", F.posexplode(channel_responses(F.col("embedding"), SIDE, _CHANNELS)).alias("channel", "response"))
    return rounded(r, ["response"])


@query()
def im12_cho_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Area under the curve of a Hotelling template on channel responses: pooled covariance with a ridge, one small solve.

    Sums and products of the channels are added up on the executors; the solve is over as many rows as there are channels.
    """
    import numpy as np

    from assayer.operators.curves import rank_auc

    n = len(_CHANNELS)
    e = table(spark, folder, "embeddings").select((F.col("label") % 2).alias("present"), channel_responses(F.col("embedding"), SIDE, _CHANNELS).alias("r"))
    rows = e.select("present", *(F.get("r", F.lit(i)).alias(str(i)) for i in range(n)))
    c = [F.col(str(i)) for i in range(n)]
    stats = [F.avg(x).alias(f"m{i}") for i, x in enumerate(c)] + [F.covar_samp(c[i], c[j]).alias(f"c{i}{j}") for i in range(n) for j in range(n)]
    by = {s["present"]: s for s in rows.groupBy("present").agg(F.count("*").alias("n"), *stats).collect()}  # two rows
    if any(k not in by or by[k]["n"] < 2 for k in (0, 1)):
        return spark.createDataFrame([(0, 0, 0.5)], "n_pos long, n_neg long, auc double")
    cov = sum(np.array([[by[k][f"c{i}{j}"] for j in range(n)] for i in range(n)]) for k in (0, 1)) / 2
    gap = np.array([by[1][f"m{i}"] - by[0][f"m{i}"] for i in range(n)])
    w = np.linalg.solve(cov + 1e-4 * np.trace(cov) / n * np.eye(n), gap)
    scored = rows.select(F.lit("all").alias("g"), "present", sum((x * float(v) for x, v in zip(c[1:], w[1:], strict=True)), c[0] * float(w[0])).alias("score"))
    return rounded(rank_auc(scored, ["g"], "present", "score", wide=True).drop("g"), ["auc"])


@query(f"WITH {_PX} SELECT vec_id, y, x, round(least(greatest(v + 0.3 * exp(-((y - 3.5) * (y - 3.5) + (x - 3.5) * (x - 3.5)) / 4.5), -1), 1), 6) AS v FROM x")
def im14_lesion_insert(spark: SparkSession, folder: str) -> DataFrame:
    d2 = (F.col("y") - 3.5) * (F.col("y") - 3.5) + (F.col("x") - 3.5) * (F.col("x") - 3.5)
    v = F.least(F.greatest(F.col("v") + 0.3 * F.exp(-d2 / 4.5), F.lit(-1.0)), F.lit(1.0))
    return pixels(table(spark, folder, "embeddings"), "vec_id", "embedding", SIDE).select("vec_id", "y", "x", F.round(v, 6).alias("v"))


@query(f"WITH {_PX} SELECT vec_id, (y // 2)::INT AS y, (x // 2)::INT AS x, round(sum(v * 0.25), 6) AS v FROM x GROUP BY ALL")
def im15_grid_resample(spark: SparkSession, folder: str) -> DataFrame:
    """Bilinear resampling to twice the spacing: targets lie midway between four pixels of equal weight."""
    half = SIDE // 2
    four = lambda px: image(half, half, lambda y, x: sum((F.get(px, (2 * y + j) * SIDE + 2 * x + i) for j, i in ((0, 1), (1, 0), (1, 1))), F.get(px, 2 * y * SIDE + 2 * x)) * 0.25)
    return rounded(placed(table(spark, folder, "embeddings").select("vec_id", let(doubles(F.col("embedding")), four).alias("v")), "vec_id", half), ["v"])


@query(f"WITH {_P}, d AS (SELECT vec_id, unnest(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) AS d FROM p) SELECT vec_id, round(max(d), 6) AS worst, round(sqrt(avg(d * d)), 6) AS rmse, round(avg((d <= 0.1)::INT), 6) AS within FROM d GROUP BY vec_id")
def im16_image_agreement(spark: SparkSession, folder: str) -> DataFrame:
    d = F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    p = _pairs(spark, folder).withColumn("d", d)
    near = F.size(F.filter("d", lambda v: v <= 0.1)) / F.size("d")
    return rounded(p.select("vec_id", F.array_max("d").alias("worst"), F.sqrt(mse(F.col("a"), F.col("b"))).alias("rmse"), near.alias("within")), ["worst", "rmse", "within"])


@query(f"WITH {_PX}, t AS (SELECT vec_id, quantile_cont(abs(v), 0.9) AS t FROM x GROUP BY vec_id), f AS (SELECT x.vec_id, abs(v) > t AS flag, y BETWEEN 3 AND 4 AND x BETWEEN 3 AND 4 AS lesion FROM x JOIN t USING (vec_id)) SELECT vec_id, round(avg(flag::INT), 6) AS flagged_share, count(*) FILTER (flag AND lesion) AS flagged, count(*) FILTER (lesion AND NOT flag) AS missed, round(count(*) FILTER (flag AND lesion) / count(*) FILTER (lesion)::DOUBLE, 6) AS recall FROM f GROUP BY vec_id")
def im17_uq_association(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels above the 90th percentile of uncertainty against the lesion's pixels; recall in its bounded form."""
    u = table(spark, folder, "embeddings").select("vec_id", F.transform(doubles(F.col("embedding")), F.abs).alias("u")).withColumn("t", level(F.col("u"), 0.9))
    lesion = part(F.col("u"), SIDE, lambda y, x: y.between(3, 4) & x.between(3, 4))
    above = lambda a: F.size(F.filter(a, lambda v: v > F.col("t"))).cast("long")
    n = u.select("vec_id", (above(F.col("u")) / F.size("u")).alias("flagged_share"), above(lesion).alias("flagged"), F.size(lesion).cast("long").alias("n"))
    return rounded(n.select("vec_id", "flagged_share", "flagged", (F.col("n") - F.col("flagged")).alias("missed"), (F.col("flagged") / F.col("n")).alias("recall")), ["flagged_share", "recall"])


@query("WITH r AS (SELECT l_suppkey AS series, l_orderkey AS slice, l_linenumber AS line, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem), k AS (SELECT *, i // greatest(n // 48, 1) AS k FROM r WHERE i % greatest(n // 48, 1) = 0) SELECT series, slice, line, k FROM k WHERE k < 48")
def im19_slice_subset(spark: SparkSession, folder: str) -> DataFrame:
    """Every n/48-th slice of a series, 48 at most: the subset is the feature."""
    w = Window.partitionBy("l_suppkey")
    r = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("series"), F.col("l_orderkey").alias("slice"), F.col("l_linenumber").alias("line"), (F.row_number().over(w.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    step = F.greatest(F.floor(F.col("n") / 48), F.lit(1))
    k = r.where(F.col("i") % step == 0).withColumn("k", F.floor(F.col("i") / step).cast("long"))
    return k.where("k < 48").select("series", "slice", "line", "k")


from assayer.operators.resampling import U_SQL  # noqa: E402


@query(f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE {U_SQL.format(u='event_id', b='7')} < 0.25 GROUP BY event_type")
def im20_bernoulli_thin(spark: SparkSession, folder: str) -> DataFrame:
    return thinned(table(spark, folder, "events"), "event_id", 0.25).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH l AS (SELECT vec_id, i AS line, i BETWEEN 3 AND 4 AS centre, {U_SQL.format(u='(vec_id * 8 + i)', b='3')} AS u FROM embeddings, (SELECT unnest(range(8)) AS i)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY centre DESC, u, line) AS k FROM l) SELECT vec_id, line::INT AS line, k <= 4 AS kept FROM r")
def im21_line_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the lines stay: the centre and, by a seeded draw, others."""
    from assayer.operators.resampling import uniform

    e = table(spark, folder, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("line"))
    w = Window.partitionBy("vec_id").orderBy(F.col("line").between(3, 4).desc(), uniform(F.lit(3), F.col("vec_id") * 8 + F.col("line")), "line")
    return e.select("vec_id", "line", (F.row_number().over(w) <= 4).alias("kept"))


@query("SELECT vec_id, list_transform(embedding, lambda v: round(least(greatest((v::DOUBLE * 1000 + 24 + 1024) / 4096, 0), 1), 6)) AS px FROM embeddings")
def prj2_hu_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Rescaled values brought into the unit window."""
    scaled = F.transform("embedding", lambda v: v.cast("double") * 1000 + 24)
    return table(spark, folder, "embeddings").select("vec_id", F.transform(normalize(scaled, -1024.0, 4096.0), lambda v: F.round(v, 6)).alias("px"))
