import random

from pyspark.sql import functions as F

from assayer.operators.agreement import kappa_drift
from assayer.streaming import flows


def test_batch_and_stream_have_the_same_windows_whatever_the_arrival(spark, tmp_path):
    rng = random.Random(8)
    rows = [(r, 1_700_000_000 + t * 60, t, rng.randint(0, 2), rng.randint(0, 2) if r == "b" else t % 3) for t in range(700) for r in ("a", "b")]
    rows = [(r, s, i, x, x if r == "a" and i < 400 else y) for r, s, i, x, y in rows] + [("a", 1_700_000_030, 9999, None, 1)]
    df = spark.createDataFrame(rows, "reader string, s long, id long, x int, y int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want = {(r.reader, r.window): r for r in kappa_drift(df, "reader", ["ts", "id"], "x", "y", window=50).collect()}
    assert {k[1] for k in want} == set(range(14)) and all(r.n == 50 for r in want.values())
    assert want["a", 0].kappa == 1 and not want["a", 7].paused and want["b", 3].paused and want["a", 13].last_pass == max(w for w in range(13) if not want["a", w].paused)

    for k in (1, 0, 3, 2, 5, 4):  # files of two hours, neighbours swapped, each in any order
        df.where(F.floor(F.col("id") / 120) == k).orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = flows.kappa_drift_stream(stream, "reader", "ts", "id", "x", "y", "5 hours", window=50)
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.reader, r.window): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # what lies five hours before the last case has ripened
    assert set(got) == {k for k in want if k[1] < 8}
    assert all(abs(got[k].kappa - want[k].kappa) < 1e-9 and got[k].paused == want[k].paused for k in got)


def test_ripe_windows_come_out_in_order(spark, tmp_path):
    rng = random.Random(9)
    rows = [("a", 1_700_000_000 + t * 60, t, rng.randint(0, 2), rng.randint(0, 2)) for t in range(600)]
    df = spark.createDataFrame(rows, "reader string, s long, id long, x int, y int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.orderBy(F.rand(1)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    found = flows.kappa_drift_stream(stream, "reader", "ts", "id", "x", "y", "1 hour", window=50)
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.window: r.kappa for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.window: r.kappa for r in kappa_drift(df, "reader", ["ts", "id"], "x", "y", window=50).collect()}
    assert set(got) == set(range(10)) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_cases_without_a_key_and_many_windows_in_one_batch(spark, tmp_path):
    rng = random.Random(10)
    rows = [("a", 1_700_000_000 + t // 3 * 3600, None if t % 3 == 0 else t, rng.randint(-1, 2), rng.randint(-1, 2)) for t in range(30_000)]
    df = spark.createDataFrame(rows, "reader string, s long, id long, x int, y int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    found = flows.kappa_drift_stream(stream, "reader", "ts", "id", "x", "y", "1 hour", window=10)
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.window: r.kappa for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.window: r.kappa for r in kappa_drift(df, "reader", ["ts", "id"], "x", "y", window=10).collect()}
    assert set(got) == set(range(2999)) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
