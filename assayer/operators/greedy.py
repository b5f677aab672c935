"""Greedy choices as rounds: what a sequential pass would take next everywhere at once is taken in one round.

Edges lie in written tables that shrink from round to round. No group goes to one call, and what a node's edges contribute to a round is
a minimum, which combines before the shuffle. The results are those of the sequential pass, as a choice only waits for those before it
that share one of its ends; there are as many rounds as the longest chain of such waits, a few where weights come in no order along the
edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.plans.store import Scratch


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def dominant_pairs(edges: DataFrame, by: list[str]) -> DataFrame:
    """One-to-one pairs (by, a, b, overlap): the largest overlap first, then the least a, then the least b, as long as both are free.

    An edge is taken in the round in which it is the best left at both ends. ``a`` and ``b`` are of one type, and no edge repeats.
    """
    scratch, taken, k = Scratch(edges.sparkSession, "pairs"), [], 0
    left = scratch.keep(edges.select(*by, "a", "b", "overlap"), "left-0", codec="lz4")
    end = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("id"))
    while True:
        ends = left.select(*by, F.struct((-F.col("overlap")).alias("o"), "a", "b").alias("edge"), F.explode(F.array(end(0, "a"), end(1, "b"))).alias("end"))
        best = ends.groupBy(*by, "end").agg(F.min("edge").alias("edge"))
        won = best.groupBy(*by, "edge").agg(F.count("*").alias("n")).where("n = 2")
        taken.append(scratch.keep(won.select(*by, "edge.a", "edge.b", (-F.col("edge.o")).alias("overlap")), f"taken-{k}"))
        free = left.join(taken[-1].select(*by, "a"), [*by, "a"], "left_anti").join(taken[-1].select(*by, "b"), [*by, "b"], "left_anti")
        free = scratch.keep(free.select(*by, "a", "b", "overlap"), f"left-{k + 1}", codec="lz4")
        scratch.drop(f"left-{k}")
        left, k = free, k + 1
        if left.isEmpty():
            return _union(taken)


def followers(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, leader, member): in order, a node that no leader has taken leads, and takes its later neighbours that are free.

    ``edges`` are (by, lo, hi) with lo before hi. Nodes that are nobody's member are leaders, those without an edge too.
    """
    scratch, gone, k = Scratch(edges.sparkSession, "leaders"), [], 0
    everything = scratch.keep(edges.select(*by, "lo", "hi").distinct(), "edges", codec="lz4")
    left = everything
    while True:
        # who waits for nobody leads now; a node whose edges are all gone leads as well, and needs no round
        waiting = left.select(*by, F.col("hi").alias("lo")).distinct()
        led = left.join(waiting, [*by, "lo"], "left_anti")
        gone.append(scratch.keep(led.select(*by, F.col("hi").alias("node")).distinct(), f"members-{k}"))
        members, leaders = gone[-1], led.select(*by, "lo").distinct()
        rest = left.join(leaders, [*by, "lo"], "left_anti")
        for side in ("lo", "hi"):
            rest = rest.join(members.withColumnRenamed("node", side), [*by, side], "left_anti")
        rest, k = scratch.keep(rest.select(*by, "lo", "hi"), f"left-{k + 1}", codec="lz4"), k + 1
        left = rest
        if left.isEmpty():
            break
    members = _union(gone)
    led = everything.join(members.withColumnRenamed("node", "lo"), [*by, "lo"], "left_anti")
    # of several leaders the first has taken it
    return led.groupBy(*by, F.col("hi").alias("member")).agg(F.min("lo").alias("leader")).select(*by, "leader", "member")
