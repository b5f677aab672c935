import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import planes
from assayer.operators.resampling import uniform


def plain_resample(px, h, w, r, c, mm):
    """Pixel by pixel, from the four neighbours."""
    nh, nw = (max(1, round(n * s / mm)) for n, s in ((h, r), (w, c)))
    out = []
    for y in range(nh):
        for x in range(nw):
            fy, fx = y * (h - 1) / max(nh - 1, 1), x * (w - 1) / max(nw - 1, 1)
            total = 0.0
            for j, v in ((math.floor(fy), 1 - fy % 1), (min(math.floor(fy) + 1, h - 1), fy % 1)):
                for i, u in ((math.floor(fx), 1 - fx % 1), (min(math.floor(fx) + 1, w - 1), fx % 1)):
                    total += v * u * px[j * w + i]
            out.append(total)
    return nh, nw, out


def test_resampling_against_plain_loops(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        h, w = rng.randint(1, 9), rng.randint(1, 9)
        rows.append((k, [rng.uniform(-1, 1) for _ in range(h * w)], h, w, rng.choice([0.3, 0.45, 0.9, 1.7, 9.0]), rng.choice([0.01, 0.45, 0.9, 2.7])))
    df = spark.createDataFrame(rows, "id int, v array<double>, h int, w int, r double, c double")
    got = df.select("id", planes.resampled(*(F.col(c) for c in "vhwrc"), 0.9).alias("n")).select("id", "n.*")
    for r in got.collect():
        _, *a = rows[r.id]
        h, w, px = plain_resample(*a, 0.9)
        assert (r.height, r.width) == (h, w) and r.px == pytest.approx(px, abs=1e-12)


def test_resampling_odd_rows(spark):
    rows = [(None, 2, 2, 1.0, 1.0), ([], 0, 0, 1.0, 1.0), ([1.0] * 3, 2, 2, 1.0, 1.0), ([1.0] * 4, 2, 2, None, 1.0), ([1.0] * 4, 2, 2, 0.0, 1.0), ([1.0] * 4, None, 2, 1.0, 1.0)]
    rows += [([1.0, None, 3.0, 4.0], 2, 2, 1.0, 1.0)] * 2
    df = spark.createDataFrame(rows, "v array<double>, h int, w int, r double, c double").coalesce(1)
    got = [x.n for x in df.select(planes.resampled(*(F.col(c) for c in "vhwrc"), 1.0).alias("n")).collect()]
    assert all(x is None or x.px is None for x in got[:6])
    for x in got[6:]:
        assert (x.height, x.width) == (2, 2) and [x.px[0], x.px[2], x.px[3]] == [1.0, 3.0, 4.0] and x.px[1] is None
    assert df.limit(0).select(planes.resampled(*(F.col(c) for c in "vhwrc"), 1.0)).count() == 0
    with pytest.raises(ValueError):
        planes.resampled(*(F.col(c) for c in "vhwrc"), 0.0)


def test_draws_are_those_of_columns(spark):
    got = spark.range(0, 300_000, 977).select("id", uniform(F.lit(42), F.col("id")).alias("u")).collect()
    assert all(planes.draw(42, r.id) == r.u for r in got)


def test_patches_against_plain_sums(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(20, 60, h * w)], h, w) for k, (h, w) in enumerate([(9, 14), (20, 7), (5, 5), (6, 31), (4, 40), (40, 40)])]
    df = spark.createDataFrame(rows, "id int, v array<double>, h int, w int")
    got = {r.id: r.b for r in df.select("id", planes.even_patch(F.col("v"), F.col("h"), F.col("w"), 5, (-20.0, 40.0)).alias("b")).collect()}
    for k, v, h, w in rows:
        p = np.array(v).reshape(h, w)
        if min(h, w) < 5:
            assert tuple(got[k]) == (max(0, h - 5) // 2, max(0, w - 5) // 2, None)
            continue
        at = lambda y, x: p[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]  # noqa: B023, E731
        slope = np.array([[math.hypot(sum(c * (at(y + d, x + 1) - at(y + d, x - 1)) for d, c in ((-1, 1), (0, 2), (1, 1))), sum(c * (at(y + 1, x + d) - at(y - 1, x + d)) for d, c in ((-1, 1), (0, 2), (1, 1)))) for x in range(w)] for y in range(h)])
        best = None
        for top, left in zip(*planes.places(h, w, 5, 42, 50), strict=True):
            q, g = p[top : top + 5, left : left + 5], slope[top : top + 5, left : left + 5]
            score = 0.4 * math.exp(-0.5 * ((q.mean() - 10) / 30) ** 2) + 0.4 * math.exp(-g.mean() / 20) + 0.2 * math.exp(-q.std() / 50)
            if best is None or round(score, 9) > round(best[2], 9):
                best = (top, left, score)
        assert tuple(got[k])[:2] == best[:2] and got[k].score == pytest.approx(best[2], abs=1e-8)


def test_patches_odd_rows(spark):
    rows = [(None, 6, 6), ([], 0, 0), ([1.0] * 35, 6, 6), ([None] * 36, 6, 6), ([7.0] * 36, 6, 6), ([7.0] * 36, 6, 6)]
    df = spark.createDataFrame(rows, "v array<double>, h int, w int").coalesce(1)
    got = [r.b for r in df.select(planes.even_patch(F.col("v"), F.col("h"), F.col("w"), 3, (-20.0, 40.0)).alias("b")).collect()]
    assert all(b is None or b.top is None for b in got[:3])
    assert tuple(got[3]) == (1, 1, None) and got[4] == got[5]
    tops, lefts = planes.places(6, 6, 3, 42, 50)
    assert (got[4].top, got[4].left) == (tops[0], lefts[0])  # of equal patches the first
