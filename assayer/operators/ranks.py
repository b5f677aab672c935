"""Ranks and running totals of a whole table: rows are dealt to ranges of the order, so a hot group is ranked by many tasks.

A window over (group, range) gives the place inside the range; one over the ranges' totals, at most ``RANGES`` rows a group,
gives what lies in the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that an order is cut into, by quantiles of the whole table. A range of one group holds about that share of the
#: table at most, but for rows of one value, which aggregation has made one row where values are counted first.
RANGES = 128


def ranges(rows: DataFrame, at: str) -> Column:
    """The range of a number, growing with it. What reaches the driver is ``RANGES`` quantiles."""
    cuts = sorted(set(rows.approxQuantile(at, [k / RANGES for k in range(1, RANGES)], 1 / (4 * RANGES))))
    return F.size(F.filter(F.lit([float(c) for c in cuts]), lambda c: c < F.col(at))) if cuts else F.lit(0)


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys, null with null; the keys stay once."""
    b = b.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    return a.join(b, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]).drop(*(f"_same_{k}" for k in keys))


def _ahead(totals: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Of one row a (group, range): the totals of the ranges before, ``_b_``, and of the group, ``_a_``."""
    group = by or [F.lit(0)]
    w = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_b_{s}") for s in sums]
    return totals.select(*by, "_range", *before, *(F.sum(s).over(Window.partitionBy(*group)).alias(f"_a_{s}") for s in sums))


def below(counts: DataFrame, by: list[str], at: str, sums: list[str], wide: bool = False) -> DataFrame:
    """Adds to rows of distinct ``at``, for each of ``sums``, ``<name>_below`` over smaller ones and ``<name>_all`` over the group.

    ``wide`` is for groups with many distinct values: they are dealt to ranges. Else a group's distinct values are one window.
    """
    before = lambda w: w.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    if not wide:
        group = Window.partitionBy(*(by or [F.lit(0)]))
        return counts.withColumns({f"{s}_below": F.coalesce(F.sum(s).over(before(group)), F.lit(0)) for s in sums} | {f"{s}_all": F.sum(s).over(group) for s in sums})
    c = counts.withColumn("_range", ranges(counts, at))
    ahead = _ahead(c.groupBy(*by, "_range").agg(*(F.sum(s).alias(s) for s in sums)), by, sums)
    inside = c.withColumns({f"_i_{s}": F.coalesce(F.sum(s).over(before(Window.partitionBy(*by, "_range"))), F.lit(0)) for s in sums})
    out = same(inside, ahead, [*by, "_range"])
    out = out.withColumns({f"{s}_below": F.col(f"_i_{s}") + F.col(f"_b_{s}") for s in sums} | {f"{s}_all": F.col(f"_a_{s}") for s in sums})
    return out.drop("_range", *(f"_{k}_{s}" for k in "iba" for s in sums))


def positions(rows: DataFrame, by: list[str], order: list[str], cut: Column, name: str) -> DataFrame:
    """Adds the place of a row in its group's order, from 0; ``cut`` is a range that grows with the first of ``order``."""
    r = rows.withColumn("_range", cut)
    ahead = _ahead(r.groupBy(*by, "_range").agg(F.count("*").alias("n")), by, ["n"])
    inside = r.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1)
    out = same(inside, ahead, [*by, "_range"])
    return out.withColumn(name, F.col("_i") + F.col("_b_n")).drop("_range", "_i", "_b_n", "_a_n")


def mid_ranks(rows: DataFrame, by: list[str], value: str, name: str, wide: bool = False) -> DataFrame:
    """Adds the mean rank of tied values, smallest first, from 1. Values are counted first; rows without a value are left out."""
    r = rows.where(F.col(value).isNotNull())
    c = below(r.groupBy(*by, value).agg(F.count("*").alias("_n")), by, value, ["_n"], wide)
    return same(r, c.select(*by, value, (F.col("_n_below") + (F.col("_n") + 1) / 2).alias(name)), [*by, value])
