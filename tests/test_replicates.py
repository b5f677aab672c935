import numpy as np
from pyspark.sql import functions as F

from assayer.operators import resampling as R


def test_matrix_of_weights_is_that_of_the_columns(spark):
    units, b = np.array([0, 1, 7, 1_000_002, 1_000_003, 65_537 * 31, 2**40 + 5, 9 * 10**15]), np.arange(300)
    got = R._weights(units, b)
    df = spark.createDataFrame([(int(u),) for u in units], "unit long").withColumn("b", F.explode(R._numbers(0, 300)))
    want = {(r.unit, r.b): r.m for r in df.select("unit", "b", R.weight(F.col("b"), F.col("unit")).alias("m")).collect()}
    assert all(got[i, k] == want[int(u), int(k)] for i, u in enumerate(units) for k in b)
    many = R._weights(np.arange(20_000), np.arange(50))
    assert abs(many.mean() - 1) < 0.01 and abs(many.var() - 1) < 0.02


def test_sums_against_plain_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(k % 3 if k % 7 else None, k if k % 11 else None, float(rng.normal()) if k % 13 else None, 2) for k in range(900)]
    df = spark.createDataFrame(rows, "b2 int, unit long, t double, c int").withColumnRenamed("b2", "g")
    got = {(r.g, r.b): (r.t, r.c) for r in R.replicate_sums(df, ["g"], "unit", ["t", "c"], 40).collect()}
    for g in (0, 1, 2, None):
        own = [r for r in rows if r[0] == g and r[1] is not None]
        m = R._weights(np.array([r[1] for r in own]), np.arange(40))
        t, c = np.array([r[2] or 0.0 for r in own]), np.array([2.0] * len(own))
        for b in range(40):
            assert np.allclose(got[g, b], (t @ m[:, b], c @ m[:, b]))
    assert R.replicate_sums(df.where("false"), ["g"], "unit", ["t"], 5).count() == 0


def test_a_weigher_serves_blocks_of_any_size():
    units, weigh = np.array([0, 5, 1_000_002, 2**40 + 5, 9 * 10**15, 77, 78]), R._Weigher(300, 4)
    whole = R._weights(units, np.arange(300))
    assert (np.vstack([weigh(units[i : i + 4]).copy() for i in (0, 4)]) == whole).all()


def test_units_with_many_groups_and_groups_of_one_unit(spark):
    rng = np.random.default_rng(2)
    rows = [(g, u, float(rng.normal())) for u in range(60) for g in range(12) for _ in range(1 + u % 2)] + [(100 + u, u, 1.0) for u in range(60, 400)]
    df = spark.createDataFrame(rows, "g int, unit long, t double").coalesce(1)
    got, m = {(r.g, r.b): r.t for r in R.replicate_sums(df, ["g"], "unit", ["t"], 20).collect()}, R._weights(np.arange(400), np.arange(20))
    want = {}
    for g, u, t in rows:
        want[g] = want.get(g, 0) + t * m[u]
    assert len(got) == 20 * len(want) and all(np.isclose(got[g, b], want[g][b]) for g in want for b in range(20))


def test_sums_of_many_groups_leave_the_task(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("g"), F.col("id").alias("unit"), F.lit(1.0).alias("t"))
    got = R.replicate_sums(df, ["g"], "unit", ["t"], 4000).agg(F.count("*"), F.avg("t")).first()
    assert got[0] == 3000 * 4000 and abs(got[1] - 1) < 0.01


def test_a_method_that_is_always_lowest_ranks_last(spark):
    df = spark.range(96).withColumn("method", F.explode(F.array(*map(F.lit, ["a", "b", "c", "blur"]))))
    df = df.select(F.col("id").alias("unit"), "method", F.when(F.col("method") == "blur", 1e-4).otherwise(1e-2 * (1 + F.col("id") % 5)).alias("v"))
    got = {r.method: r for r in R.bootstrap_ranks(df, [], "method", "unit", "v", 200).collect()}
    assert got["blur"].share_last == 1 and got["blur"].rank_sum == 800
    need = R.observers_needed(df, [], "method", "unit", "v", "blur").collect()
    assert {(r.k, r.share, r.needed) for r in need} == {(k, 1.0, 1) for k in R.OBSERVERS}
    assert {r.needed for r in R.observers_needed(df, [], "method", "unit", "v", "a").collect()} == {None}
