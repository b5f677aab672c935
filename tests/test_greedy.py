import random

from pyspark.sql import functions as F

from assayer.operators import greedy, matching


def plain_pairs(edges):
    used_a, used_b, out = set(), set(), set()
    for g, a, b, o in sorted(edges, key=lambda e: (-e[3], e[1], e[2])):
        if (g, a) not in used_a and (g, b) not in used_b:
            used_a.add((g, a))
            used_b.add((g, b))
            out.add((g, a, b, o))
    return out


def plain_leaders(edges):
    nodes, near, leader = sorted({(g, n) for g, *ends in edges for n in ends}), {}, {}
    for g, lo, hi in edges:
        near.setdefault((g, lo), []).append((g, hi))
    for n in nodes:
        if n not in leader:
            leader.update({m: n for m in near.get(n, ()) if m not in leader})
    return {(n[0], lead[1], n[1]) for n, lead in leader.items()}


def test_pairs_of_a_slice_of_a_hundred_thousand_boxes(spark):
    rng = random.Random(4)

    def boxes(n):
        out = []
        for i in range(n):
            x, y, w = rng.randint(0, 5000), rng.randint(0, 5000), rng.randint(8, 24)
            out.append((1, i, x, y, x + w, y + w))
        return spark.createDataFrame(out, "slice long, id long, x0 long, y0 long, x1 long, y1 long")

    a, b = boxes(100_000).cache(), boxes(100_000).cache()
    box = ["x0", "y0", "x1", "y1"]
    edges = [tuple(r) for r in matching.overlapping(a, b, ["slice"], box).where("overlap > 0.3").collect()]
    got = matching.match_boxes(a, b, ["slice"], box, 0.3)
    assert {tuple(r) for r in got.collect()} == plain_pairs(edges) and len(edges) > 10_000
    assert "Pandas" not in got._jdf.queryExecution().toString()


def test_ties_hot_nodes_and_chains(spark):
    rng = random.Random(6)
    edges = {(g, rng.randint(0, 40), rng.randint(0, 40)): rng.choice([0.25, 0.5, 0.75]) for g in (1, 2) for _ in range(500)}
    edges |= {(3, 0, b): 0.5 for b in range(3000)}  # one box meets all others
    edges |= {(4, i // 2 + i % 2, i // 2): i / 100 for i in range(1, 24)}  # each waits for the next
    rows = [(*k, o) for k, o in edges.items()]
    got = greedy.dominant_pairs(spark.createDataFrame(rows, "g long, a long, b long, overlap double"), ["g"])
    assert {tuple(r) for r in got.collect()} == plain_pairs(rows)
    rows = {(g, min(e), max(e)) for g, *e in edges if e[0] != e[1]}
    df = spark.createDataFrame(sorted(rows), "g long, lo long, hi long")
    assert {tuple(r) for r in greedy.followers(df, ["g"]).collect()} == plain_leaders(rows)
    none = df.where("false")
    assert greedy.followers(none, ["g"]).count() == 0
    assert greedy.dominant_pairs(none.select("g", F.col("lo").alias("a"), F.col("hi").alias("b"), F.lit(1.0).alias("overlap")), ["g"]).count() == 0
