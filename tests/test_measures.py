from assayer.plans import measures


def test_tasks_follow_the_table(spark, sf, monkeypatch):
    few = measures.slices(spark, sf)
    want = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(measures, "_A_TASK", 100)
    many = measures.slices(spark, sf)
    assert many.rdd.getNumPartitions() >= spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100
    assert sorted(map(tuple, many.collect())) == want and few.columns == many.columns
