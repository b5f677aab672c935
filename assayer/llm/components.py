"""Connected components by alternating large-star and small-star over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.plans.store import Scratch


def _star(pairs: DataFrame, scratch: Scratch, name: str, whole: bool) -> DataFrame:
    """Every ``v`` beside a ``u`` goes to the least node around that ``u``; whole: ``u`` itself goes there too.

    The minima are written first, so that both join sides are plain shuffles and adaptive execution can split the
    neighbourhood of a hub.
    """
    least = scratch.keep(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("u", "m").alias("m")), f"{name}-least")
    joined = pairs.join(least, F.col("u") == F.col("hub"))
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if whole:
        out = out.union(least.select(F.col("hub").alias("u"), F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return scratch.keep(out.where("u <> v").distinct(), name)


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, component (the least node reachable) for every node of ``edges`` (src, dst); other nodes are their own.

    Self-links and repeated edges are allowed; an edge with a null end links nothing; no edges give an empty table.
    """
    kept = F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))
    now = scratch.keep(edges.where(kept).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), f"{name}-0")
    k = 0
    while not _stars(now):
        k += 1
        large = _star(now.union(now.select("v", "u")), scratch, f"{name}-large-{k}", False)
        now = _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), scratch, f"{name}-small-{k}", True)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _stars(pairs: DataFrame) -> bool:
    """Whether every node hangs on one centre and no centre hangs on another: what both steps leave unchanged.

    One aggregation: a node's rows as ``u`` and as ``v`` are counted together.
    """
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(pairs.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return per.where("hangs + holds > 1").isEmpty()
