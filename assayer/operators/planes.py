"""Slices of their own height, width and spacing: resampling to a spacing, and the search for an even patch of tissue.

Both work on one image in its row, in Arrow batches, so no pixel is shuffled. Defined results: an array that is null, empty, or not
of ``height`` by ``width`` pixels gives null, as does a null or non-positive spacing; a missing pixel leaves missing what it reaches.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.registry import query
from assayer.operators.resampling import U_SQL
from assayer.operators.summaries import rounded
from assayer.sources.tables import table

#: Weights of closeness to the band, of an even surface and of a small spread, and the scales of the latter two, in Hounsfield units.
WEIGHTS, GRADIENT_SCALE, SPREAD_SCALE = (0.4, 0.4, 0.2), 20.0, 50.0
CANDIDATES = 50


@lru_cache(maxsize=256)
def axis_operator(n: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower neighbour, upper neighbour and the upper one's weight for ``target`` places spread evenly over ``n``, both ends included."""
    at = np.arange(target) * (n - 1) / max(target - 1, 1)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, n - 1), at - low


def _between(v: np.ndarray, target: int) -> np.ndarray:
    low, high, w = axis_operator(len(v), target)
    w = w.reshape(-1, *[1] * (v.ndim - 1))
    return np.where(w > 0, v[low] * (1 - w) + v[high] * w, v[low])


def _plane(v, height, width) -> np.ndarray | None:
    if v is None or pd.isna(height) or pd.isna(width) or height < 1 or len(v) != height * width or not len(v):
        return None
    return np.asarray(v, float).reshape(int(height), int(width))


def resampled(px: Column, height: Column, width: Column, row_mm: Column, column_mm: Column, target_mm: float) -> Column:
    """(height, width, px) at ``target_mm`` a pixel on both axes, bilinear, an axis at a time; an axis keeps at least one pixel."""
    if not target_mm > 0:
        raise ValueError("the target spacing must be positive")

    def to(n: int, mm: float) -> int:
        return max(1, int(np.rint(n * mm / target_mm)))  # halves go to the even number

    @F.pandas_udf("height int, width int, px array<double>")
    def run(images: pd.Series, hs: pd.Series, ws: pd.Series, rows: pd.Series, columns: pd.Series) -> pd.DataFrame:
        found = []
        for v, h, w, r, c in zip(images, hs, ws, rows, columns, strict=True):
            plane = _plane(v, h, w)
            if plane is None or not (0 < r < np.inf and 0 < c < np.inf):
                found.append((None, None, None))
                continue
            new = (to(plane.shape[0], r), to(plane.shape[1], c))
            found.append((*new, _between(_between(plane, new[0]).T, new[1]).T.ravel()))
        out = pd.DataFrame(found, columns=["height", "width", "px"])
        return out.astype({"height": "Int32", "width": "Int32"})

    return run(px, height, width, row_mm, column_mm)


def draw(seed: int, k: int) -> float:
    """``resampling.uniform`` of two plain numbers."""
    x = (k % 1_000_003 * 7919 + seed * 104_729 + 12_345) % 1_000_003
    return (x * 48_271 + seed * 16_807 + k % 65_537) % 2_147_483_647 * 48_271 % 2_147_483_647 / 2_147_483_647.0


@lru_cache(maxsize=256)
def places(height: int, width: int, size: int, seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tops and lefts of ``n`` seeded candidates: the same for all images of one shape, whichever task holds them."""
    tops = np.array([int(draw(seed, 2 * k) * max(height - size, 1)) for k in range(n)], int)
    return tops, np.array([int(draw(seed, 2 * k + 1) * max(width - size, 1)) for k in range(n)], int)


def _gradient(p: np.ndarray) -> np.ndarray:
    """Sobel's magnitude at every pixel, edges repeated."""
    q = np.pad(p, 1, mode="edge")
    across, down = q[:, 2:] - q[:, :-2], q[2:] - q[:-2]
    return np.hypot(across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:])


def _summed(p: np.ndarray) -> np.ndarray:
    return np.pad(p, ((1, 0), (1, 0))).cumsum(0).cumsum(1)


def patch_scores(p: np.ndarray, size: int, tops: np.ndarray, lefts: np.ndarray, band: tuple[float, float]) -> np.ndarray:
    """Scores of square patches of an image in Hounsfield units: three summed tables, then four reads of each a patch."""
    middle = float(p.mean())
    tables = [_summed(t) for t in (p - middle, (p - middle) ** 2, _gradient(p))]
    mean, square, gradient = ((t[tops + size, lefts + size] - t[tops, lefts + size] - t[tops + size, lefts] + t[tops, lefts]) / size**2 for t in tables)
    spread = np.sqrt(np.maximum(square - mean**2, 0.0))
    centre, reach = (band[0] + band[1]) / 2, (band[1] - band[0]) / 2
    near = np.exp(-0.5 * ((mean + middle - centre) / reach) ** 2)
    return WEIGHTS[0] * near + WEIGHTS[1] * np.exp(-gradient / GRADIENT_SCALE) + WEIGHTS[2] * np.exp(-spread / SPREAD_SCALE)


def even_patch(px: Column, height: Column, width: Column, size: int, band: tuple[float, float], seed: int = 42, n: int = CANDIDATES) -> Column:
    """(top, left, score) of the best of ``n`` seeded patches in an image in Hounsfield units, the first of equal ones.

    An image smaller than a patch gives the middle and no score, as does one without a score that is a number.
    """
    if not band[1] > band[0] or size < 1:
        raise ValueError("a band needs two bounds in order, a patch at least one pixel")

    @F.pandas_udf("top int, left int, score double")
    def run(images: pd.Series, hs: pd.Series, ws: pd.Series) -> pd.DataFrame:
        found = []
        for v, h, w in zip(images, hs, ws, strict=True):
            if (p := _plane(v, h, w)) is None:
                found.append((None, None, None))
                continue
            best = (max(0, p.shape[0] - size) // 2, max(0, p.shape[1] - size) // 2, None)
            if min(p.shape) >= size and n:
                tops, lefts = places(*p.shape, size, seed, n)
                scores = np.round(patch_scores(p, size, tops, lefts, band), 9)
                if not np.isnan(scores).all():
                    k = int(np.nanargmax(scores))
                    best = (int(tops[k]), int(lefts[k]), float(scores[k]))
            found.append(best)
        return pd.DataFrame(found, columns=["top", "left", "score"]).astype({"top": "Int32", "left": "Int32", "score": "Float64"})

    return run(px, height, width)


_SHAPES = ((8, 8), (4, 16), (16, 4))
_H, _W = (" ".join(["CASE vec_id % 3", *(f"WHEN {k} THEN {s[i]}" for k, s in enumerate(_SHAPES)), "END"]) for i in (0, 1))
_ROW, _COLUMN = "0.5::DOUBLE + (vec_id % 7) / 8", "0.625::DOUBLE + (vec_id % 5) / 4"
_SHAPED = f"s AS (SELECT vec_id, embedding AS v, {_H} AS h, {_W} AS w, {_ROW} AS r, {_COLUMN} AS c FROM embeddings)"


def _shaped(spark: SparkSession, folder: str) -> DataFrame:
    e, k = table(spark, folder, "embeddings"), F.col("vec_id") % 3
    side = lambda i: F.when(k == 0, _SHAPES[0][i]).when(k == 1, _SHAPES[1][i]).otherwise(_SHAPES[2][i])
    return e.select("vec_id", F.col("embedding").alias("v"), side(0).alias("h"), side(1).alias("w"), (0.5 + F.col("vec_id") % 7 / 8).alias("r"), (0.625 + F.col("vec_id") % 5 / 4).alias("c"))


@query(
    f"WITH {_SHAPED}, n AS (SELECT *, greatest(1, round_even(h * r / 0.9, 0))::INT AS nh, greatest(1, round_even(w * c / 0.9, 0))::INT AS nw FROM s), g AS (SELECT *, unnest(range(nh * nw))::INT AS i FROM n), a AS (SELECT *, (i // nw)::INT AS y, (i % nw)::INT AS x, (i // nw) * (h - 1) / greatest(nh - 1, 1)::DOUBLE AS fy, (i % nw) * (w - 1) / greatest(nw - 1, 1)::DOUBLE AS fx FROM g), b AS (SELECT *, floor(fy)::INT AS y0, least(floor(fy)::INT + 1, h - 1) AS y1, floor(fx)::INT AS x0, least(floor(fx)::INT + 1, w - 1) AS x1 FROM a) "
    "SELECT vec_id, nh AS height, nw AS width, y, x, round((v[y0 * w + x0 + 1]::DOUBLE * (1 - fy + y0) + v[y1 * w + x0 + 1]::DOUBLE * (fy - y0)) * (1 - fx + x0) + (v[y0 * w + x1 + 1]::DOUBLE * (1 - fy + y0) + v[y1 * w + x1 + 1]::DOUBLE * (fy - y0)) * (fx - x0), 6) AS v FROM b"
)
def im15_resample_spacing(spark: SparkSession, folder: str) -> DataFrame:
    """Slices of three shapes, each with its own spacing, at 0.9 mm a pixel."""
    s = _shaped(spark, folder)
    r = s.select("vec_id", resampled(F.col("v"), F.col("h"), F.col("w"), F.col("r"), F.col("c"), 0.9).alias("n"))
    p = r.select("vec_id", "n.height", "n.width", F.posexplode("n.px").alias("i", "v"))
    return rounded(p.select("vec_id", "height", "width", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), "v"), ["v"])


_NEAR = "(SELECT unnest([-1, 0, 1]) AS d, unnest([1, 2, 1]) AS w)"


@query(
    f"WITH {_SHAPED}, p AS MATERIALIZED (SELECT vec_id, h, w, (i // w)::INT AS y, (i % w)::INT AS x, v[i + 1]::DOUBLE * 100 AS v FROM s, (SELECT unnest(range(64))::INT AS i)), "
    f"gx AS (SELECT q.vec_id, q.y, q.x, sum(k.w * s.d * u.v) AS g FROM p q, {_NEAR} k, (SELECT unnest([-1, 1]) AS d) s JOIN p u ON u.vec_id = q.vec_id AND u.y = least(greatest(q.y + k.d, 0), q.h - 1) AND u.x = least(greatest(q.x + s.d, 0), q.w - 1) GROUP BY ALL), "
    f"gy AS (SELECT q.vec_id, q.y, q.x, sum(k.w * s.d * u.v) AS g FROM p q, {_NEAR} k, (SELECT unnest([-1, 1]) AS d) s JOIN p u ON u.vec_id = q.vec_id AND u.y = least(greatest(q.y + s.d, 0), q.h - 1) AND u.x = least(greatest(q.x + k.d, 0), q.w - 1) GROUP BY ALL), "
    "g AS MATERIALIZED (SELECT p.*, sqrt(gx.g * gx.g + gy.g * gy.g) AS g FROM p JOIN gx USING (vec_id, y, x) JOIN gy USING (vec_id, y, x)), "
    f"k AS (SELECT k, {U_SQL.format(u='(2 * k)', b='42')} AS a, {U_SQL.format(u='(2 * k + 1)', b='42')} AS b FROM (SELECT unnest(range({CANDIDATES})) AS k)), "
    "c AS (SELECT h, w, k, floor(a * greatest(h - 3, 1))::INT AS top, floor(b * greatest(w - 3, 1))::INT AS \"left\" FROM (SELECT DISTINCT h, w FROM s), k), "
    f"m AS (SELECT vec_id, k, top, \"left\", {WEIGHTS[0]} * exp(-0.5 * pow((avg(v) - 10) / 30, 2)) + {WEIGHTS[1]} * exp(-avg(g) / {GRADIENT_SCALE}) + {WEIGHTS[2]} * exp(-stddev_pop(v) / {SPREAD_SCALE}) AS score FROM g JOIN c ON g.h = c.h AND g.w = c.w AND y BETWEEN top AND top + 2 AND x BETWEEN \"left\" AND \"left\" + 2 GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, k) AS n FROM m) SELECT vec_id, top, \"left\", round(score, 6) AS score FROM r WHERE n = 1"
)
def im8_even_patch(spark: SparkSession, folder: str) -> DataFrame:
    """The patch of 3 by 3 nearest to the band of -20 to 40 units, even and of small spread, among 50 seeded ones."""
    s = _shaped(spark, folder)
    hu = F.transform("v", lambda v: v.cast("double") * 100)
    best = s.select("vec_id", even_patch(hu, F.col("h"), F.col("w"), 3, (-20.0, 40.0)).alias("b"))
    return rounded(best.select("vec_id", "b.*"), ["score"])
