import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import resampling as R


def _given(n, seed):
    rng = np.random.default_rng(seed)
    units = rng.permutation(np.concatenate(([0, 1_000_003, 2**40 + 5, -7], rng.choice(10**12, n - 4, replace=False) - 10**6)))
    groups = rng.choice(np.array(["a", "b", "c", None], object), n, p=[0.5, 0.3, 0.15, 0.05])
    return [(int(u), g, float(v)) for u, g, v in zip(units, groups, rng.integers(0, n // 3, n), strict=True)]


def _keys(spark, given, replicates):
    """Keys by the column that SQL follows, in [b, place by unit]."""
    df = spark.createDataFrame([(u,) for u, *_ in given], "u long").withColumn("b", F.explode(R._numbers(1, replicates + 1)))
    found = df.select("b", "u", R.uniform(F.col("b"), F.col("u")).alias("key")).toPandas()
    return found.pivot(index="b", columns="u", values="key").sort_index(axis=1).to_numpy()


def _h(sums, n, r2):
    total = sum(n.values())
    middle = total * ((total + 1) / 2) ** 2
    return (total - 1) * (sum(s * s / n[g] for g, s in sums.items()) - middle) / (r2 - middle)


@pytest.mark.parametrize("block", [1 << 15, 97])
def test_shufflings_against_sorted_units(spark, monkeypatch, block):
    monkeypatch.setattr(R, "_BLOCK", block)
    replicates, given = 37, sorted(_given(1500, 3))
    values = np.array([v for *_, v in given])
    ranks = np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])
    label = [g for _, g, _ in given]
    sums = lambda order: {g: sum(r for r, h in zip(ranks[order], label, strict=True) if h == g) for g in set(label)}
    orders = np.argsort(_keys(spark, given, replicates), axis=1, kind="stable")

    codes = {g: k for k, g in enumerate(["a", "b", "c", None], 5)}
    units = spark.createDataFrame([(u, p, codes[g], int(2 * r)) for p, ((u, g, _), r) in enumerate(zip(given, ranks, strict=True))], "unit long, p long, code long, x long")
    got = {(r.b, r.code): r.s for r in R.shuffled_sums(units, len(given), replicates).collect()}
    assert got == {(b, codes[g]): 2 * s for b, order in enumerate(orders, 1) for g, s in sums(order).items()}

    n, r2 = {g: label.count(g) for g in set(label)}, (ranks**2).sum()
    seen = _h(sums(np.arange(len(given))), n, r2)
    ge = sum(_h(sums(order), n, r2) >= seen - 1e-9 for order in orders)
    df = spark.createDataFrame(given, "u long, g string, v double").repartition(5)
    row = R.permutation_kruskal(df, "u", "g", "v", replicates).first()
    assert np.isclose(row.h, seen) and (row.ge, row.p) == (ge, (ge + 1) / (replicates + 1))


def test_shufflings_do_not_copy_units(spark):
    """A unit was a row a shuffling, ranked by windows; now a block of units is a row a shuffling and range of keys."""
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), F.hash("id").cast("double").alias("v"))
    out = R.permutation_kruskal(df, "id", "g", "v", 20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    assert out.first().p > 0.04


def test_shufflings_of_no_rows_and_of_units_without_a_name(spark):
    df = spark.createDataFrame([(None, "a", 1.0), (2, "a", 2.0), (3, "b", 2.0), (4, "b", 7.0), (5, "a", None)], "u long, g string, v double")
    row = R.permutation_kruskal(df, "u", "g", "v", 9).first()
    assert np.isclose(row.h, _h({"a": 3.5, "b": 6.5}, {"a": 2, "b": 2}, 1 + 2 * 6.25 + 16)) and 0 <= row.ge <= 9
    row = R.permutation_kruskal(df.where("false"), "u", "g", "v", 9).first()
    assert (row.h, row.ge) == (None, 0)
