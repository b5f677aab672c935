"""Operators without SQL, edge cases, and the streaming forms."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import agreement, board, curves, gates, grids, matching, preparation, ranks, registry, resampling, rules
from assayer.sources import readers, writers
from assayer.streaming import flows


registry.load()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_greedy_pairs_ignore_row_order_and_respect_the_tolerance(spark):
    full = [(1, 10, 0.0), (1, 11, 1.0), (1, 12, 2.0), (2, 20, 5.0)]
    low = [(1, 50, 0.1), (1, 51, 0.9), (1, 52, 9.0), (2, 60, 5.5)]
    random.Random(1).shuffle(low)
    a, b = (spark.createDataFrame(x, "series long, key long, at double") for x in (full, low))
    got = matching.pair_by_position(a, b, "series", "at", "key", 0.5)
    assert rows(got) == [(1, 10, 50, 0.0, 0.1), (1, 11, 51, 1.0, 0.9), (2, 20, 60, 5.0, 5.5)]


def test_boxes_match_one_to_one_best_first(spark):
    s = "slice long, id long, x0 long, y0 long, x1 long, y1 long"
    a = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 1, 1, 11, 11), (2, 3, 0, 0, 5, 5)], s)
    b = spark.createDataFrame([(1, 7, 1, 1, 11, 11), (2, 8, 20, 20, 25, 25)], s)
    got = matching.match_boxes(a, b, ["slice"], ["x0", "y0", "x1", "y1"], 0.3).collect()
    assert [(r.slice, r.a, r.b, r.overlap) for r in got] == [(1, 2, 7, 1.0)]


def test_nearest_takes_the_lower_of_equals(spark):
    points = spark.createDataFrame([(1, 0.5), (1, 0.6), (1, -3.0), (1, 9.0), (2, 1.0)], "series long, z double")
    grid = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "series long, p long")
    assert rows(matching.nearest(points, grid, ["series"], "z", "p")) == [(1, -3.0, 0.0), (1, 0.5, 0.0), (1, 0.6, 1.0), (1, 9.0, 2.0), (2, 1.0, None)]


@pytest.mark.parametrize(
    ("entries", "verdict"),
    [
        ([("c", 0.247, True), ("a", 0.636, False), ("b", 1.04, False)], "PASS"),
        ([("c", 0.247, True), ("a", 0.247, False)], "FAIL"),
        ([("c", 0.247, True), ("a", 0.1, False)], "FAIL"),
        ([("c", None, True), ("a", 0.6, False)], "INDETERMINATE"),
        ([("a", 0.6, False)], "INDETERMINATE"),
        ([("c", 0.247, True)], "NO_CLAIM"),
        ([("c", 0.247, True), ("a", None, False)], "NO_CLAIM"),
        ([("c", 0.5, True), ("a", 0.6, False)], "FAIL"),
    ],
)
def test_control_verdicts_both_ways(spark, entries, verdict):
    df = spark.createDataFrame([("v", *e) for e in entries], "vendor string, method string, value double, control boolean")
    got = board.control_verdicts(df, ["vendor"], "value", F.col("control"), 2.0).collect()
    assert [r.verdict for r in got] == [verdict]


def test_worst_verdict_counts_absent_strata(spark):
    v = spark.createDataFrame([("a", "PASS"), ("b", "NO_CLAIM")], "vendor string, verdict string")
    required = spark.createDataFrame([("a",), ("z",)], "vendor string")
    assert board.worst(v).first().verdict == "PASS"
    assert board.worst(v, required, "vendor").first().verdict == "MISSING_STRATUM"
    assert board.worst(v.limit(0)).first().verdict == "NO_CLAIM"


def test_knee_states(spark):
    data = {"below": [45.0, 50.0, 60.0], "interp": [30.0, 50.0, 60.0], "not_reached": [1.0, 2.0, 3.0], "nan": [float("nan"), 50.0, 60.0], "late": [1.0, float("nan"), 60.0]}
    df = spark.createDataFrame([(k, d, y) for k, v in data.items() for d, y in zip((0.1, 0.25, 0.5), v, strict=True)], "m string, dose double, y double")
    got = {r.m: (r.knee, r.status) for r in curves.knee(df, ["m"], "dose", "y", 40.0).collect()}
    assert got["below"] == (0.1, "below") and got["not_reached"] == (None, "not_reached")
    assert got["interp"][1] == "interp" and math.isclose(got["interp"][0], 0.175)
    assert got["nan"] == (None, "nan") and got["late"] == (None, "nan")


def test_perfect_separation_and_ties(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 0, 1.0), ("b", 1, 1.0), ("b", 0, 1.0), ("c", 1, 1.0)], "g string, label int, score double")
    got = {r.g: r.auc for r in curves.rank_auc(df, ["g"], "label", "score").collect()}
    assert got == {"a": 1.0, "b": 0.5, "c": None}


def test_kappa_of_one_category_and_perfect_agreement(spark):
    df = spark.createDataFrame([("one", 1, 1)] * 3 + [("all", i % 3, i % 3) for i in range(9)], "g string, a int, b int")
    assert {r.g: r.kappa for r in agreement.cohen_kappa(df, ["g"], "a", "b").collect()} == {"one": 1.0, "all": 1.0}


def test_poisson_weights_have_mean_one(spark):
    w = spark.range(200).crossJoin(spark.range(50).withColumnRenamed("id", "b")).select(resampling.weight(F.col("b"), F.col("id")).alias("m"))
    r = w.agg(F.avg("m").alias("mean"), F.var_pop("m").alias("var")).first()
    assert abs(r.mean - 1) < 0.05 and abs(r.var - 1) < 0.1


def test_bca_interval_holds_the_mean(spark):
    units = spark.range(300).select(F.lit("v").alias("g"), "id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("x"), F.lit(1).alias("c"))
    means = resampling.replicate_means(units, ["g"], "id", "x", "c", 200)
    r = resampling.bca_ci(units, means, ["g"], "x").first()
    assert r.low < r.theta < r.high and r.high - r.low < 0.2


def test_rules_reject_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id long, v int")
    assert rows(gates.violations(df, "id", {"positive": "v > 0"})) == [(2, "positive"), (3, "positive")]
    assert rows(gates.passes(df, "id", {"positive": "v > 0"})) == [(1, 0, True), (2, 1, False), (3, 1, False)]


def test_stage_verdicts(spark):
    df = spark.createDataFrame([("a", 1, "PASS"), ("b", 1, "PASS"), ("b", 2, None), ("c", 1, "FAIL"), ("c", 2, None)], "k string, s int, state string")
    assert {r.k: r.verdict for r in gates.stage_verdict(df, "k", "s", "state").collect()} == {"a": "ACCEPT", "b": "INCOMPLETE", "c": "REJECT"}


def test_scalar_preparation(spark):
    df = spark.createDataFrame([("063Y", "1.5\\2"), ("095Y", "x"), (None, ""), ("12", None)], "a string, n string")
    got = df.select(preparation.age(F.col("a")).alias("age"), preparation.safe_number(F.col("n")).alias("n")).collect()
    assert [(r.age, r.n) for r in got] == [(63, 1.5), (None, None), (None, None), (None, None)]
    want = int(hashlib.sha256(b"42:p-0001").hexdigest(), 16) % 100
    assert spark.range(1).select(preparation.split_bucket(F.lit("p-0001")).alias("b")).first().b == want


def test_reader_xml(spark, tmp_path):
    roi = "<roi><imageZposition>-12.5</imageZposition><inclusion>TRUE</inclusion>{}</roi>"
    edge = "".join(f"<edgeMap><xCoord>{x}</xCoord><yCoord>{y}</yCoord></edgeMap>" for x, y in ((3, 9), (7, 2), (5, 5)))
    node = f"<unblindedReadNodule><noduleID>n1</noduleID><characteristics><texture>4</texture></characteristics>{roi.format(edge)}</unblindedReadNodule>"
    session = f"<readingSession><servicingRadiologistID>r1</servicingRadiologistID>{node}</readingSession>"
    (tmp_path / "a.xml").write_text(f"<root>{session}{session}</root>")
    got = readers.reader_xml(spark, str(tmp_path)).collect()
    assert sorted(r.reader for r in got) == ["r1", "r1_2"]
    assert tuple(got[0].box) == (3, 2, 7, 9) and got[0].z == -12.5 and got[0].texture == 4


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "d" / "__pycache__").mkdir(parents=True)
    (tmp_path / "d" / "a.bin").write_bytes(b"abc")
    (tmp_path / "d" / "__pycache__" / "b.bin").write_bytes(b"x")
    assert readers.files(spark, str(tmp_path / "d")).count() == 1
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "id long, v double")
    assert [r.v for r in writers.finite_table(df).orderBy("id").collect()] == [None, None, 1.5]
    empty = df.limit(0)
    assert writers.write_board(df, empty, str(tmp_path / "x")) == "board"
    assert writers.write_board(df, df, str(tmp_path / "y")) == "failed"


def run_stream(query):
    query.processAllAvailable()
    query.stop()


def test_thin_stream_keeps_what_the_batch_keeps(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run_stream(flows.thin_stream(stream, "event_id", 0.25).writeStream.format("memory").queryName("thin").start())
    assert rows(spark.table("thin")) == rows(flows.thin_stream(batch, "event_id", 0.25))


def test_submission_stream_diverts_violations(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 5), (2, -5), (3, None)], "id long, v int").write.json(src)
    stream = spark.readStream.schema("id long, v int").json(src)
    run_stream(flows.submission_stream(stream, "id", {"positive": "v > 0"}, str(tmp_path / "board"), str(tmp_path / "failed"), str(tmp_path / "cp")).start())
    assert [r.id for r in spark.read.parquet(str(tmp_path / "board")).collect()] == [1]
    assert sorted((r.id, r.rule) for r in spark.read.parquet(str(tmp_path / "failed")).collect()) == [(2, "positive"), (3, "positive")]


def test_drift_stream_pauses_a_reader(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", i % 10 != 0) for i in range(120)] + [("b", i % 2 == 0) for i in range(60)], "reader string, ok boolean").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("reader string, ok boolean").parquet(src)
    run_stream(flows.drift_stream(stream, "reader", "ok").writeStream.format("memory").queryName("drift").outputMode("append").start())
    got = {(r.reader, r.window): r.paused for r in spark.table("drift").collect()}
    assert got == {("a", 0): False, ("a", 1): False, ("b", 0): True}


def test_consolidated_readers_against_a_plain_pass(spark):
    import random
    import statistics

    from assayer.operators.records import consolidate_readers

    rng = random.Random(2)
    marks = []
    for i in range(240):
        x, y, w = rng.randint(0, 12), rng.randint(0, 12), rng.randint(6, 10)
        marks.append((i % 3, i % 4, rng.choice("abc"), i, x, y, x + w, y + w, float(w), rng.randint(1, 5)))

    def iou(p, q):
        both = max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))
        return both / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both)

    want = []
    for case, z in sorted({m[:2] for m in marks}):
        own = sorted((m for m in marks if m[:2] == (case, z)), key=lambda m: (m[2], m[3]))
        readers = len({m[2] for m in marks if m[0] == case})
        while own:
            lead, group = own[0], [m for m in own if iou(own[0][4:8], m[4:8]) >= 0.3]
            own = [m for m in own if m not in group]
            n = len({m[2] for m in group})
            assert lead in group
            if n > 0.5 * readers:
                want.append((case, z, *(float(statistics.median(c)) for c in zip(*(m[4:8] for m in group))), float(statistics.median(m[8] for m in group)), int(statistics.median(m[9] for m in group)), n))
    names = "slice long, z long, reader string, id long, x0 long, y0 long, x1 long, y1 long, diameter double, texture long"
    got = consolidate_readers(spark.createDataFrame(marks, names), ["slice", "z"]).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_boxes_meet_in_cells_as_in_all_pairs(spark):
    import random

    from assayer.operators.matching import overlapping

    rng = random.Random(1)
    box = lambda i: (i % 2, i, x := rng.randint(-40, 40), y := rng.randint(-40, 40), x + rng.randint(0, 40), y + rng.randint(0, 40))
    a, b = [box(i) for i in range(60)], [box(i) for i in range(60)]
    names = "s long, id long, x0 long, y0 long, x1 long, y1 long"
    got = overlapping(spark.createDataFrame(a, names), spark.createDataFrame(b, names), ["s"], ["x0", "y0", "x1", "y1"]).collect()
    area = lambda p, q: max(0, min(p[4], q[4]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[3], q[3]))
    assert sorted((r.a, r.b) for r in got) == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and area(p, q) > 0)


def test_friedman_against_listed_orders(spark):
    from itertools import permutations, product

    from assayer.operators.resampling import friedman_exact

    ranks = [(s, c, float(r)) for s, own in enumerate([(1, 2, 3), (1, 3, 2), (1, 2, 3), (2, 1, 3)]) for c, r in enumerate(own)]
    got = friedman_exact(spark.createDataFrame(ranks, "s long, c long, r double"), "s", "c", "r", 3).first()
    q = lambda sums: 12 / (4 * 3 * 4) * sum(x * x for x in sums) - 3 * 4 * 4
    seen = q([sum(r for _, c, r in ranks if c == k) for k in range(3)])
    every = [q([sum(c) for c in zip(*some)]) for some in product(permutations((1, 2, 3)), repeat=4)]
    assert abs(got.q - seen) < 1e-9 and abs(got.p - sum(x >= seen - 1e-9 for x in every) / len(every)) < 1e-9


def test_degenerate_orientation_is_an_error(spark):
    import pytest
    from pyspark.sql import functions as F

    from assayer.operators.records import along_axis

    one = [F.lit(1.0), F.lit(0.0), F.lit(0.0)]
    with pytest.raises(Exception, match="orientation"):
        spark.range(1).select(along_axis(one, one, one)).collect()


def test_image_stencils_in_the_row(spark):
    rng = np.random.default_rng(4)
    a = rng.random((8, 8))
    taps = grids.gaussian(1.0, 4)
    padded = np.pad(a, 4, mode="symmetric")
    down = sum(w * padded[4 + d : 12 + d] for d, w in taps)
    want = sum(w * down[:, 4 + d : 12 + d] for d, w in taps)
    df = spark.createDataFrame([(1, a.ravel().tolist()), (2, None), (3, [1.0] * 64), (4, [])], "k long, px array<double>")
    px = F.col("px")
    got = {r["k"]: r for r in df.select("k", grids.smooth(px, 8, taps).alias("s"), grids.peak(px, 8).alias("p"), grids.best_patch(px, 3, 8).alias("b"), grids.level(px, 0.9).alias("q"), grids.ssim(px, px, 8, grids.TAPS).alias("i")).collect()}
    assert np.allclose(np.array(got[1]["s"]).reshape(8, 8), want)
    assert np.isclose(got[1]["q"], np.quantile(a, 0.9))
    assert np.isclose(got[1]["i"], 1.0)
    assert got[2]["s"] is None and got[2]["b"]["score"] is None and got[2]["q"] is None
    assert tuple(got[3]["p"]) == (1, 1, 1.0) and tuple(got[3]["b"])[:2] == (0, 0)
    assert got[4]["q"] is None and got[4]["p"]["v"] is None
    top = {(y, x): a[y, x] for y in range(1, 7) for x in range(1, 7) if a[y, x] == a[y - 1 : y + 2, x - 1 : x + 2].max()}
    best = max(top, key=lambda k: top[k]) if top else None
    assert tuple(got[1]["p"])[:2] == best


def test_image_stencils_do_not_shuffle(spark, sf):
    for name in ("im3_gaussian_highpass", "im4_blur_control", "im7_micro_peak", "im8_tissue_roi", "im9_sobel_gradient", "im10_roi_cnr", "im11_channel_response", "im13_npwe_score", "im15_grid_resample", "im17_uq_association"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name


def test_pairs_of_runs_are_those_of_whole_series(spark):
    draw = random.Random(5)
    side = lambda n: [(draw.randrange(3), i, draw.choice([draw.randrange(40) / 4, None])) for i in range(n)]
    full, low = side(150), side(170)
    want = []
    for s in range(3):
        free = sorted((p, k) for g, k, p in low if g == s and p is not None)
        for p, k in sorted((p, k) for g, k, p in full if g == s and p is not None):
            near = min(((abs(q - p), i) for i, (q, _) in enumerate(free)), default=None)
            if near and near[0] <= 0.5:
                q, other = free.pop(near[1])
                want.append((s, k, other, p, q))
    a, b = (spark.createDataFrame(x, "series long, key long, at double") for x in (full, low))
    got = matching.pair_by_position(a, b, "series", "at", "key", 0.5)
    assert rows(got) == sorted(want, key=repr)
    summary = {r.series: r for r in matching.pairing_summary(a, b, got, "series", 0.5).collect()}
    for s in range(3):
        n = sum(w[0] == s for w in want)
        assert summary[s].n_paired == n and summary[s].n_unpaired_full == sum(r[0] == s for r in full) - n and summary[s].n_violations == 0


def test_ranks_by_ranges(spark):
    draw = random.Random(6)
    given = [(draw.choice(["a", "b", None]), draw.choice([None, float("nan"), *range(30)]), i) for i in range(500)]
    df = spark.createDataFrame([(g, None if v is None else float(v), i) for g, v, i in given], "g string, v double, i long").repartition(7)
    for wide in (True, False):
        got = {r.i: r.r for r in ranks.mid_ranks(df, ["g"], "v", "r", wide).collect()}
        key = lambda v: math.inf if math.isnan(v) else v
        for g, v, i in given:
            if v is None:
                assert i not in got
                continue
            mine = [key(w) for h, w, _ in given if h == g and w is not None]
            assert got[i] == sum(w < key(v) for w in mine) + (mine.count(key(v)) + 1) / 2
    placed = {r.i: r.pos for r in ranks.positions(df, ["g"], ["i"], ranks.ranges(df, "i"), "pos").collect()}
    assert all(placed[i] == sum(h == g and j < i for h, _, j in given) for g, _, i in given)
    assert ranks.mid_ranks(df.where("false"), ["g"], "v", "r", True).count() == 0


def test_rules_take_their_words(spark):
    df = spark.createDataFrame([("a/L012_x.NPZ", "Full dose image"), ("x.dcm", "low PROJECTION"), ("b/.git/x", None), ("ok/a.json", "full")], "p string, d string")
    got = df.select(rules.refusal(F.col("p")).alias("w"), rules.cruft(F.col("p")).alias("c"), rules.series_role(F.col("d")).alias("r"), rules.by_prefix(F.col("d"), ("Full",)).alias("b")).collect()
    assert [r.w for r in got] == ["patient pixel derivative", "DICOM", None, None]
    assert [r.c for r in got] == [False, False, True, False]
    assert [r.r and tuple(r.r) for r in got] == [("fd", "image"), ("ld", "projection"), None, None]
    assert [r.b for r in got] == ["Full", "low PROJECTION", "", "full"]
    with pytest.raises(ValueError, match="2 restricted files"):
        rules.refuse(df, "p")
    assert rules.refuse(df.where("p like 'ok%'"), "p").count() == 1
    v = spark.createDataFrame([("rejected", False, True, True, True), ("published", False, True, False, True), ("published", False, True, True, False), (None, False, False, None, None), ("x", None, None, None, False)], "s string, f boolean, r boolean, e boolean, t boolean")
    states = [r[0] for r in v.select(rules.publication_state(*(F.col(c) for c in "sfret"))).collect()]
    assert states == ["REJECTED", "INCOMPLETE", "PUBLISHED", "NO_CLAIM", "MISSING_LAYER"]
    told = spark.createDataFrame([(None,), ("HELDOUT-SPLIT",), ("training-split",), ("other",)], "p string")
    assert [r[0] for r in told.select(rules.provenance_state(F.col("p"))).collect()] == ["undeclared", "accepted", "training", "unknown"]
