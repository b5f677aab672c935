"""Sharding by a k-d tree: nodes are split at weighted medians along their widest metadata dimension until a leaf has the target bytes.

Rows weigh their text's UTF-8 bytes plus ``OVERHEAD``. Of each node the dimension with the largest extent, as a share of its extent in the
whole table, is cut where the bytes on its left come nearest to half of the node's shards; the shards then go to both sides by their bytes. The
median is found by histograms of ``BINS`` bins a node, each round inside the bin that holds it, for all nodes of a level at once: what
reaches the driver is one row a node and round. Rows that share a coordinate, be it a third of the table, are told apart by a hash and cut
there; so a hot source or group of copies is spread like anything else. DataFrame functions only.

Rows: a null text has no bytes; null metadata is a coordinate below all others. Repeated rows, null or repeated doc_ids are rows of
their own; they differ in the hash by their place in the written intermediate, so which of them goes where may change from run to run, how
many go where does not. A row heavier than a shard's share makes that shard heavier; with fewer rows than shards some stay empty. Columns other
than doc_id, text and the dimensions are left alone, whatever their names. An empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators import ranks
from assayer.plans.store import Scratch

#: Bytes of a row beside its text.
OVERHEAD = 16
#: Bins of a node's histogram.
BINS = 4096
#: The median is near enough where its bin holds this share of a shard's bytes.
NEAR = 0.002
#: Coordinates lie between 0 and this number, the hash that tells equal ones apart below it.
EXTENT = 1 << 30
#: Ranges of a shard that are numbered at once, as a power of two.
SLOT_RANGES = 9


@dataclass
class Node:
    """A part of the table for ``shards`` shards from ``first`` on; once it is split, rows left of the cut go to ``left``."""

    shards: int
    first: int
    cut: tuple[str, int, int] | None = None
    children: list[Node] = field(default_factory=list)


def _before(cut: tuple[str, int, int]) -> Column:
    at, value, tie = F.col(cut[0]), F.lit(cut[1]), F.col("tie")
    return (at < value) | ((at == value) & (tie < cut[2])) if cut[2] else at < value


def _leaf(node: Node) -> Column:
    """The first shard of the leaf that a row falls into."""
    return F.when(_before(node.cut), _leaf(node.children[0])).otherwise(_leaf(node.children[1])) if node.children else F.lit(node.first)


def _metadata(documents: DataFrame, dimensions: list[str]) -> DataFrame:
    """doc_id, size, text_crc32, ``tie`` and the dimensions: texts as a checksum, numbers as they are."""
    text = F.coalesce("text", F.lit(""))
    kinds = dict(documents.dtypes)
    raw = [(F.crc32(F.col(d)) if kinds[d] == "string" else F.col(d).cast("double")).alias(f"d{k}") for k, d in enumerate(dimensions)]
    rows = documents.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *raw)
    return rows.withColumn("tie", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size", F.monotonically_increasing_id()), 34))


def _coordinates(rows: DataFrame, n: int) -> DataFrame:
    """``x<k>`` of each dimension: its place between the least and the greatest value of the table; size is the last one."""
    names = [*(f"d{k}" for k in range(n)), "size"]
    known = [F.when(F.isnan(F.col(d).cast("double")), None).otherwise(F.col(d).cast("double")) for d in names]
    ends = rows.agg(*(f(x).alias(f"{f.__name__}{k}") for k, x in enumerate(known) for f in (F.min, F.max))).first()
    places = []
    for k, x in enumerate(known):
        low, high = ends[f"min{k}"] or 0.0, ends[f"max{k}"] or 0.0
        place = F.floor((x - low) / F.lit(max(high - low, 1e-300)) * (EXTENT - 1)) + 1
        places.append(F.coalesce(place, F.lit(0)).cast("long").alias(f"x{k}"))
    return rows.select("doc_id", "size", "text_crc32", "tie", *places)


def _median(rows: DataFrame, searches: dict[int, dict]) -> None:
    """One round: of each node's bins the one that its aim falls into becomes its range.

    A search has the column, the range from ``low`` on with bins of ``step``, what weighs before it, and, once a single coordinate is
    left, that coordinate, while the hash is searched.
    """
    one = lambda k, s: F.struct(F.lit(k).alias("node"), F.lit(s["by"]).alias("by"), F.lit(s["same"]).cast("long").alias("same"), *(F.lit(v).cast("long").alias(n) for n, v in (("low", s["low"]), ("step", s["step"]), ("aim", s["aim"] - s["before"]))))
    sought = rows.sparkSession.range(1).select(F.inline(F.array(*(one(k, s) for k, s in searches.items()))))
    by = F.coalesce(*(F.when(F.col("by") == d, F.col(d)) for d in rows.columns if d.startswith("x")))
    # as many rows as there are nodes, so no more than shards
    r = rows.join(F.broadcast(sought), "node").withColumn("at", by)
    r = r.withColumn("at", F.when(F.col("same").isNull(), F.col("at")).when(F.col("same") == F.col("at"), F.col("tie")))
    r = r.select("node", "aim", "size", F.expr("(at - low) div step").alias("bin")).where(F.col("bin").between(0, BINS - 1))
    bins = r.groupBy("node", "aim", "bin").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
    found = bins.withColumn("upto", upto).where((F.col("upto") >= F.col("aim")) & (F.col("upto") - F.col("w") < F.col("aim"))).collect()
    for row in found:
        s = searches[row.node]
        s.update(low=s["low"] + row.bin * s["step"], before=s["before"] + row.upto - row.w, weight=row.w, n=row.n, last=s["step"])
        s["step"] = -(-s["step"] // BINS)


def _split(coordinates: DataFrame, level: list[Node], near: float) -> list[Node]:
    """Splits the nodes of one level; returns those that are still for several shards."""
    by_first = {n.first: n for n in level}
    dims = [c for c in coordinates.columns if c.startswith("x")]
    ends = coordinates.groupBy("node").agg(F.sum("size").alias("weight"), F.count("*").alias("n"), *(f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)))
    searches = {}
    for row in ends.collect():
        node = by_first.get(row.node)
        if node is None or row.n < 2:
            continue
        widest = max(dims, key=lambda d: row[f"max_{d}"] - row[f"min_{d}"])
        low, high = row[f"min_{widest}"], row[f"max_{widest}"]
        search = {"by": widest, "same": None, "low": low, "step": -(-(high - low + 1) // BINS), "before": 0, "total": row.weight, "aim": max(1, row.weight * (node.shards // 2) // node.shards)}
        if low == high:
            search |= {"same": low, "low": 0, "step": -(-EXTENT // BINS)}
        searches[row.node] = search
    going = dict(searches)
    while going:
        _median(coordinates, going)
        for first, s in list(going.items()):
            if s["weight"] <= near or s["n"] == 1 or (s["last"] == 1 and s["same"] is not None):
                del going[first]
            elif s["last"] == 1:
                s.update(same=s["low"], low=0, step=-(-EXTENT // BINS))
    after = []
    for first, s in searches.items():
        node = by_first[first]
        # the side of the bin that is nearer to the aim
        below = s["aim"] - s["before"] < s["before"] + s["weight"] - s["aim"]
        at, left = (s["low"], s["before"]) if below and s["before"] else (s["low"] + s["last"], s["before"] + s["weight"])
        if left >= s["total"]:
            at, left = s["low"], s["before"]
        if not 0 < left < s["total"]:
            continue
        node.cut = (s["by"], at, 0) if s["same"] is None else (s["by"], s["same"], at)
        n_left = min(max(round(node.shards * left / s["total"]), 1), node.shards - 1)
        node.children = [Node(n_left, node.first), Node(node.shards - n_left, node.first + n_left)]
        after += [c for c in node.children if c.shards > 1]
    return after


def shards(documents: DataFrame, dimensions: list[str], n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (from 0 in each shard) of every row; ``dimensions`` are columns beside the size.

    The number of shards is given, or follows from the bytes that one should have.
    """
    scratch = Scratch(documents.sparkSession, "shards")
    rows = scratch.keep(_metadata(documents, dimensions), "metadata")
    total = rows.agg(F.sum("size")).first()[0] or 0
    n_shards = n_shards or max(1, -(-total // target_bytes))
    tree, rows = Node(n_shards, 0), scratch.keep(_coordinates(rows, len(dimensions)), "places")
    scratch.drop("metadata")
    level = [tree] if n_shards > 1 else []
    while level:
        level = _split(rows.withColumn("node", _leaf(tree)), level, NEAR * total / n_shards)
    placed = rows.select("doc_id", "size", "text_crc32", "tie", _leaf(tree).alias("shard"))
    return ranks.positions(placed, ["shard"], ["tie", "doc_id"], F.shiftright("tie", 30 - SLOT_RANGES), "slot").drop("tie")
