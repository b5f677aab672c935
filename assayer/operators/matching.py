"""Matching and reconciliation: nearest, greedy one-to-one, full outer and anti joins."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.operators.greedy import dominant_pairs
from assayer.operators.preparation import iou
from assayer.operators.registry import query
from assayer.sources.tables import table


def nearest(points: DataFrame, grid: DataFrame, by: list[str], at: str, position: str) -> DataFrame:
    """Adds to each point the nearest grid position of its group, the lower of equals.

    As-of by two windows over the union: no pair of a point and a position is made.
    """
    both = points.withColumn("_p", F.lit(None).cast("double")).unionByName(grid.select(*by, F.col(position).cast("double").alias(at), F.col(position).cast("double").alias("_p")).distinct(), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at)
    low = F.last("_p", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    high = F.first("_p", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    out = both.withColumns({"_l": low, "_h": high}).where(F.col("_p").isNull())
    pick = F.when(F.col("_l").isNull() | ((F.col("_h") - F.col(at)) < (F.col(at) - F.col("_l"))), F.col("_h")).otherwise(F.col("_l"))
    return out.withColumn("nearest", pick).drop("_p", "_l", "_h")


def runs(rows: DataFrame, by: str, position: str, tolerance: float) -> DataFrame:
    """Adds ``run``: rows of a series within ``tolerance`` of each other share one.

    Positions fall into cells a little wider than the tolerance, and a run is a row of occupied cells; the window is over distinct
    cells, not over rows.
    """
    r = rows.withColumn("_cell", F.floor(F.col(position) / (max(tolerance, 1e-9) * 1.001)))
    w = Window.partitionBy(by).orderBy("_cell")
    cells = r.select(by, "_cell").distinct().withColumn("_new", (F.col("_cell") - F.lag("_cell").over(w)) == 1)
    cells = cells.withColumn("run", F.max(F.when(~F.coalesce("_new", F.lit(False)), F.col("_cell"))).over(w)).drop("_new")
    return r.join(cells, [by, "_cell"]).drop("_cell")


def pair_by_position(full: DataFrame, low: DataFrame, by: str, position: str, key: str, tolerance: float) -> DataFrame:
    """Greedy one-to-one pairs inside a series: in position order, each full slice takes the nearest unused low one in reach, the
    lower of equals. Rows stream through a task run by run, and a task holds one run at a time, as no pair reaches beyond it;
    rows without a position are unpaired.
    """

    def close(run: list[tuple]) -> list[tuple]:
        low_side = [r for r in run if not r[4]]
        at, keys, out = [r[2] for r in low_side], [r[3] for r in low_side], []
        for series, _, p, k, is_full in run:
            if not is_full or not at:
                continue
            right = bisect_left(at, p)
            near = [(abs(at[i] - p), i) for i in ([bisect_left(at, at[right - 1])] if right else []) + ([right] if right < len(at) else [])]
            if min(near)[0] <= tolerance:
                i = min(near)[1]
                out.append((series, k, keys.pop(i), p, at.pop(i)))
        return out

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(batch[c].tolist() for c in (by, "run", position, key, "is_full")), strict=True):
                if run and run[-1][:2] != row[:2]:
                    out += close(run)
                    run = []
                run.append(row)
            yield pd.DataFrame(out, columns=[by, "full_key", "low_key", "full_at", "low_at"])
        yield pd.DataFrame(close(run), columns=[by, "full_key", "low_key", "full_at", "low_at"])

    side = lambda x, n: x.where(F.col(position).isNotNull()).select(by, key, F.col(position).cast("double").alias(position), F.lit(n).alias("is_full"))
    both = runs(side(full, True).unionByName(side(low, False)), by, position, tolerance)
    kinds = dict(full.dtypes)
    schema = f"{by} {kinds[by]}, full_key {kinds[key]}, low_key {kinds[key]}, full_at double, low_at double"
    return both.repartition(by, "run").sortWithinPartitions(by, "run", position, key).mapInPandas(pair, schema)


def pairing_summary(full: DataFrame, low: DataFrame, pairs: DataFrame, by: str, tolerance: float) -> DataFrame:
    """Per series: slices of both sides, pairs, unpaired ones, correlation of paired positions, and pairs beyond the tolerance."""
    n = lambda x, name: x.groupBy(by).agg(F.count("*").alias(name))
    far = F.abs(F.col("full_at") - F.col("low_at")) > tolerance
    p = pairs.groupBy(by).agg(F.count("*").alias("n_paired"), F.when(F.count("*") > 1, F.corr("full_at", "low_at")).alias("r"), F.count(F.when(far, 1)).alias("n_violations"))
    out = n(full, "n_full").join(n(low, "n_low"), by, "full_outer").join(p, by, "left").fillna(0, ["n_full", "n_low", "n_paired", "n_violations"])
    return out.select(by, "n_full", "n_low", "n_paired", (F.col("n_full") - F.col("n_paired")).alias("n_unpaired_full"), (F.col("n_low") - F.col("n_paired")).alias("n_unpaired_low"), "r", "n_violations")


#: Side of the grid cells by which boxes meet.
CELL = 16


def overlapping(a: DataFrame, b: DataFrame, by: list[str], box: list[str], more: list[str] | None = None, cell: int = CELL) -> DataFrame:
    """(by, a, b, overlap, and ``more`` of both sides) for boxes that share some area.

    Boxes meet by the grid cells that they touch, and a pair comes out of the cell that its intersection begins in.
    """
    extra = more or []

    def celled(x: DataFrame, side: str) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / cell)
        out = x.select(*by, F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in box + extra))
        out = out.withColumn("cx", F.explode(F.sequence(at(f"{side}_{box[0]}"), at(f"{side}_{box[2]}"))))
        return out.withColumn("cy", F.explode(F.sequence(at(f"{side}_{box[1]}"), at(f"{side}_{box[3]}"))))

    o = iou([F.col(f"a_{c}") for c in box], [F.col(f"b_{c}") for c in box])
    begins = [F.floor(F.greatest(f"a_{c}", f"b_{c}") / cell) for c in box[:2]]
    met = celled(a, "a").join(celled(b, "b"), [*by, "cx", "cy"]).where((F.col("cx") == begins[0]) & (F.col("cy") == begins[1]))
    return met.select(*by, "a", "b", o.alias("overlap"), *(f"{s}_{c}" for s in "ab" for c in extra)).where("overlap > 0")


def match_boxes(a: DataFrame, b: DataFrame, by: list[str], box: list[str], least: float) -> DataFrame:
    """Greedy one-to-one pairs of boxes of two readers on one slice, best overlap above ``least`` first, ties by id."""
    return dominant_pairs(overlapping(a, b, by, box).where(F.col("overlap") > least), by)


def reconcile(recorded: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """Recorded against found by key: ok, mismatched, missing or untracked."""
    r, f = recorded.select(key, F.col(value).alias("r"), F.lit(1).alias("in_r")), found.select(key, F.col(value).alias("f"), F.lit(1).alias("in_f"))
    status = F.when(F.col("in_r").isNull(), "untracked").when(F.col("in_f").isNull(), "missing").when(F.col("r").eqNullSafe(F.col("f")), "ok").otherwise("mismatched")
    return r.join(f, key, "full_outer").select(key, status.alias("status"))


def missing_parts(records: DataFrame, parts: DataFrame, key: str, required: list) -> DataFrame:
    """Required parts that a record lacks."""
    wanted = records.select(key, F.explode(F.lit(required)).alias("part"))
    return wanted.join(parts.select(key, "part").distinct(), [key, "part"], "left_anti")


def _sha(c: str) -> Column:
    return F.sha2(F.col(c).cast("string"), 256)


@query("WITH g AS (SELECT DISTINCT l_orderkey AS series, l_linenumber::DOUBLE AS p FROM lineitem), z AS (SELECT o_orderkey AS series, (o_custkey % 80) / 10 AS z FROM orders), r AS (SELECT series, z, p, row_number() OVER (PARTITION BY series ORDER BY abs(p - z), p) AS k FROM z LEFT JOIN g USING (series)) SELECT series, z, p AS nearest FROM r WHERE k = 1")
def jn2_nearest_slice(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("p"))
    z = table(spark, folder, "orders").select(F.col("o_orderkey").alias("series"), ((F.col("o_custkey") % 80) / 10).alias("z"))
    return nearest(z, g, ["series"], "z", "p")


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("series"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), (F.col("l_quantity") + F.col("l_tax") * 5).alias("at"), "l_returnflag")
    return rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'")


@query()
def jn1_geometry_pair(spark: SparkSession, folder: str) -> DataFrame:
    return pair_by_position(*_sides(spark, folder), "series", "at", "key", 0.1)


@query()
def jn1_pairing_summary(spark: SparkSession, folder: str) -> DataFrame:
    full, low = _sides(spark, folder)
    return pairing_summary(full, low, pair_by_position(full, low, "series", "at", "key", 0.1), "series", 0.1)


def _boxes(spark: SparkSession, folder: str, reader: str) -> DataFrame:
    e = table(spark, folder, "events").where((F.col("event_type") == reader) & F.col("value").isNotNull())
    x, w = F.floor("value") % 20, 10 + F.col("event_id") % 7
    return e.select(F.col("user_id").alias("slice"), F.col("event_id").alias("id"), x.alias("x0"), (x * 3 % 17).alias("y0"), (x + w).alias("x1"), (x * 3 % 17 + w).alias("y1"))


_BOXES = "b AS (SELECT user_id AS slice, event_id AS id, event_type AS reader, floor(value)::BIGINT % 20 AS x0, (floor(value)::BIGINT % 20) * 3 % 17 AS y0, floor(value)::BIGINT % 20 + 10 + event_id % 7 AS x1, (floor(value)::BIGINT % 20) * 3 % 17 + 10 + event_id % 7 AS y1 FROM events WHERE value IS NOT NULL)"
_BOX = ["x0", "y0", "x1", "y1"]


@query(f"WITH {_BOXES}, p AS (SELECT a.slice, a.id AS a, b.id AS b, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM b a JOIN b ON a.slice = b.slice AND a.reader = 'click' AND b.reader = 'view') SELECT slice, a, b, round(i / (s - i)::DOUBLE, 6) AS overlap FROM p WHERE i > 0")
def prj23_box_iou(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes that share some area; all others have none."""
    met = overlapping(_boxes(spark, folder, "click"), _boxes(spark, folder, "view"), ["slice"], _BOX)
    return met.select("slice", "a", "b", F.round("overlap", 6).alias("overlap"))


@query()
def jn3_box_match(spark: SparkSession, folder: str) -> DataFrame:
    return match_boxes(_boxes(spark, folder, "click"), _boxes(spark, folder, "view"), ["slice"], _BOX, 0.3)


@query()
def ag17_detection_kappa(spark: SparkSession, folder: str) -> DataFrame:
    """Kappa over candidates: matched ones are seen by both, the rest by one reader."""
    from assayer.operators.agreement import cohen_kappa

    a, b = _boxes(spark, folder, "click"), _boxes(spark, folder, "view")
    m = match_boxes(a, b, ["slice"], _BOX, 0.3)
    only = lambda x, k: x.join(m.select(F.col(k).alias("id")), "id", "left_anti")
    seen = lambda x, p, q: x.select(F.lit("click-view").alias("pair"), F.lit(p).alias("a"), F.lit(q).alias("b"))
    return cohen_kappa(seen(m, 1, 1).union(seen(only(a, "a"), 1, 0)).union(seen(only(b, "b"), 0, 1)), ["pair"], "a", "b")


@query("WITH r AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 13 <> 0), f AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 19 <> 0) SELECT doc_id, CASE WHEN r.h IS NULL THEN 'untracked' WHEN f.h IS NULL THEN 'missing' WHEN r.h = f.h THEN 'ok' ELSE 'mismatched' END AS status FROM r FULL JOIN f USING (doc_id)")
def jn5_manifest_verify(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest that lacks some files, lists lost ones and is wrong on others, against the files' digests."""
    d = table(spark, folder, "documents").select("doc_id", _sha("text").alias("h"))
    recorded = d.where("doc_id % 13 <> 0").withColumn("h", F.when(F.col("doc_id") % 17 == 0, "x").otherwise(F.col("h")))
    return reconcile(recorded, d.where("doc_id % 19 <> 0"), "doc_id", "h")


@query("SELECT o_orderkey AS record, p.part FROM orders CROSS JOIN (SELECT unnest([1, 2, 3]) AS part) p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = p.part)")
def jn6_completeness(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "orders").select(F.col("o_orderkey").alias("record"))
    parts = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("part"))
    return missing_parts(records, parts, "record", [1, 2, 3])


@query("WITH a AS (SELECT vec_id, label, embedding FROM embeddings), p AS (SELECT x.vec_id, max(abs(x.e - y.e)) AS worst FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM a) x JOIN (SELECT vec_id - 1 AS vec_id, label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM a) y ON x.vec_id = y.vec_id AND x.label = y.label AND x.i = y.i GROUP BY x.vec_id) SELECT a.vec_id, round(worst, 6) AS worst, CASE WHEN worst IS NULL THEN 'unresolved' WHEN worst <= 0.5 THEN 'ok' ELSE 'different' END AS status FROM a LEFT JOIN p USING (vec_id)")
def jn7_error_map_verify(spark: SparkSession, folder: str) -> DataFrame:
    """A map against its reference, element by element; those without a reference stay apart."""
    a = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), "label", F.col("embedding").alias("reference"))
    diff = F.array_max(F.zip_with("embedding", "reference", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    j = a.join(b, ["vec_id", "label"], "left").withColumn("worst", diff)
    status = F.when(F.col("worst").isNull(), "unresolved").when(F.col("worst") <= 0.5, "ok").otherwise("different")
    return j.select("vec_id", F.round("worst", 6).alias("worst"), status.alias("status"))


@query("WITH l AS (SELECT event_id, '$.k' AS path, (props::JSON->>'k')::DOUBLE AS v FROM events), p AS (SELECT event_id, path, CASE WHEN event_id % 7 = 0 THEN v + 1 ELSE v END AS v FROM l WHERE event_id % 11 <> 0) SELECT event_id, path, CASE WHEN p.event_id IS NULL THEN 'extra' ELSE 'value' END AS kind FROM l LEFT JOIN p USING (event_id, path) WHERE p.event_id IS NULL OR abs(l.v - p.v) > 1e-6")
def jn9_document_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Published against live documents leaf by leaf: extra leaves and values that differ."""
    live = table(spark, folder, "events").select("event_id", F.lit("$.k").alias("path"), F.get_json_object("props", "$.k").cast("double").alias("v"))
    published = live.where("event_id % 11 <> 0").select("event_id", "path", F.when(F.col("event_id") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("w"), F.lit(1).alias("there"))
    j = live.join(published, ["event_id", "path"], "left")
    kind = F.when(F.col("there").isNull(), "extra").when(F.abs(F.col("v") - F.col("w")) > 1e-6, "value")
    return j.select("event_id", "path", kind.alias("kind")).where("kind is not null")


@query("WITH m AS (SELECT p_partkey AS asset, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS h FROM part WHERE p_partkey % 6 <> 0), c AS (SELECT DISTINCT l_partkey AS asset, 1 + l_partkey % 50 AS h FROM lineitem) SELECT c.asset, CASE WHEN m.asset IS NULL THEN 'FAIL' WHEN m.h IS NULL THEN 'UNVERIFIED' WHEN m.h = c.h THEN 'PASS' ELSE 'FAIL' END AS state FROM c LEFT JOIN m USING (asset)")
def jn10_input_binding(spark: SparkSession, folder: str) -> DataFrame:
    """Claims against an asset manifest: absent or different fails, a placeholder is unverified."""
    m = table(spark, folder, "part").where("p_partkey % 6 <> 0").select(F.col("p_partkey").alias("asset"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("m"), F.lit(1).alias("listed"))
    c = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("asset")).distinct().withColumn("h", 1 + F.col("asset") % 50)
    state = F.when(F.col("listed").isNull(), "FAIL").when(F.col("m").isNull(), "UNVERIFIED").when(F.col("m") == F.col("h"), "PASS").otherwise("FAIL")
    return c.join(m, "asset", "left").select("asset", state.alias("state"))


@query("WITH f AS (SELECT c_custkey AS patient, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM customer WHERE c_custkey % 9 <> 0), r AS (SELECT o_custkey AS patient, max(CASE WHEN o_orderkey % 2 = 0 THEN 'test' ELSE 'train' END) AS said FROM orders GROUP BY o_custkey) SELECT patient, CASE WHEN f.split IS NULL THEN 'unknown patient' ELSE 'contradicts split' END AS reason FROM r LEFT JOIN f USING (patient) WHERE f.split IS NULL OR f.split <> said")
def jn11_patient_binding(spark: SparkSession, folder: str) -> DataFrame:
    fixed = table(spark, folder, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("patient"), F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("train").alias("split"))
    r = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("patient")).agg(F.max(F.when(F.col("o_orderkey") % 2 == 0, "test").otherwise("train")).alias("said"))
    reason = F.when(F.col("split").isNull(), "unknown patient").when(F.col("split") != F.col("said"), "contradicts split")
    return r.join(fixed, "patient", "left").select("patient", reason.alias("reason")).where("reason is not null")


@query("SELECT o_orderkey, o_orderstatus IS DISTINCT FROM l.st AS status_differs, l.n FROM orders JOIN (SELECT l_orderkey, min(l_linestatus) AS st, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey WHERE o_orderstatus IS DISTINCT FROM l.st")
def jn12_identity_binding(spark: SparkSession, folder: str) -> DataFrame:
    """Claims whose identity differs from their context, nulls compared as values."""
    line = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min("l_linestatus").alias("st"), F.count("*").alias("n"))
    j = table(spark, folder, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    differs = ~F.col("o_orderstatus").eqNullSafe(F.col("st"))
    return j.where(differs).select("o_orderkey", differs.alias("status_differs"), "n")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey WHERE abs(l_extendedprice / l_quantity - p_retailprice) > 500")
def jn13_attrs_match(spark: SparkSession, folder: str) -> DataFrame:
    """Stored attributes that differ from the metadata's."""
    line, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    j = line.join(part, line.l_partkey == part.p_partkey).where(F.abs(F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice")) > 500)
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("WITH a AS (SELECT l_orderkey * 8 + l_linenumber AS pos, min(l_suppkey) AS p FROM lineitem WHERE l_returnflag = 'A' GROUP BY pos), b AS (SELECT l_orderkey * 8 + l_linenumber AS pos, min(l_suppkey) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY pos) SELECT pos, CASE WHEN a.pos IS NULL OR b.pos IS NULL THEN 'length' ELSE 'patient' END AS why FROM a FULL JOIN b USING (pos) WHERE a.p IS DISTINCT FROM b.p")
def jn15_method_align(spark: SparkSession, folder: str) -> DataFrame:
    """Positions at which two methods do not share the same patient."""
    rows = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), "l_suppkey", "l_returnflag")
    of = lambda f, n: rows.where(F.col("l_returnflag") == f).groupBy("pos").agg(F.min("l_suppkey").alias(n))
    why = F.when(F.col("a").isNull() | F.col("b").isNull(), "length").otherwise("patient")
    return of("A", "a").join(of("R", "b"), "pos", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("pos", why.alias("why"))


@query("SELECT a.c_nationkey AS nation, a.c_mktsegment AS a, b.c_mktsegment AS b, a.n + b.n AS n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) a JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment < b.c_mktsegment")
def jn16_reader_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every unordered pair of readers inside a group, from one row a reader."""
    n = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("nation"), "c_mktsegment").agg(F.count("*").alias("n"))
    a, b = n.alias("a"), n.alias("b")
    j = a.join(b, (F.col("a.nation") == F.col("b.nation")) & (F.col("a.c_mktsegment") < F.col("b.c_mktsegment")))
    return j.select("a.nation", F.col("a.c_mktsegment").alias("a"), F.col("b.c_mktsegment").alias("b"), (F.col("a.n") + F.col("b.n")).alias("n"))


@query("SELECT c_custkey IN (SELECT o_custkey FROM orders) AS occurs, count(*) AS n FROM customer GROUP BY occurs")
def jn17_overlap_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, folder, "customer").join(o, "c_custkey", "left").groupBy(F.coalesce("hit", F.lit(False)).alias("occurs")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS sample, l_linenumber AS slice, l_extendedprice AS value, o_custkey AS patient, c_mktsegment AS source, n_rated FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n_rated FROM events GROUP BY user_id) e ON user_id = c_custkey")
def jn4_metadata_slice_join(spark: SparkSession, folder: str) -> DataFrame:
    """A sample: slice, its series, its patient and, if there are any, the ratings."""
    line, o, c = (table(spark, folder, t) for t in ("lineitem", "orders", "customer"))
    rated = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n_rated"))
    j = line.join(o, line.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(rated, F.col("user_id") == F.col("c_custkey"), "left")
    return j.select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("slice"), F.col("l_extendedprice").alias("value"), F.col("o_custkey").alias("patient"), F.col("c_mktsegment").alias("source"), "n_rated")


@query("SELECT kind, count(*) AS n, round(sum(v), 4) AS total FROM (SELECT 'customer' AS kind, c_acctbal AS v FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY kind")
def so1_union_tables(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("v"))
    s = table(spark, folder, "supplier").select(F.col("s_acctbal").alias("v"), F.lit("supplier").alias("kind"))
    return c.unionByName(s).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def so2_set_difference(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, folder, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def so3_intersection(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))
