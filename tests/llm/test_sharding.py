import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayer.llm import queries, sharding
from tests.llm.cases import ODD, documents


def check(df, got, n_shards):
    """Every row once, sizes and checksums of the whole texts, slots without gaps; returns the bytes by shard."""
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n_shards))
    return [sum(r.size for r in got if r.shard == k) for k in range(n_shards)]


def test_query(spark, sf):
    df = queries.op13_sharding(spark, sf.replace("sf0.001", "sf0.01"))
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = df.collect()
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    sizes = check(docs, got, 40)
    heaviest = max(r.size for r in got)
    assert max(sizes) <= sum(sizes) / 40 + heaviest and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    again = queries.op13_sharding(spark, sf.replace("sf0.001", "sf0.01")).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in again) == sorted((r.doc_id, r.shard, r.slot) for r in got)


@pytest.mark.parametrize("n", [2, 7, 40])
def test_hot_metadata_and_copies_are_spread(spark, n):
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50))
    text = F.when(F.col("id") % 3 == 0, F.repeat(F.lit("x"), 300)).otherwise(F.repeat(F.lit("ü"), (F.col("id") % 97 * 5).cast("int")))
    docs = spark.range(20_000).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("doc_id"), text.alias("text"), hot.alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1.5).alias("size"))
    sizes = check(docs, sharding.shards(docs, ["source", "lang"], n_shards=n).collect(), n)
    assert max(sizes) < 1.01 * sum(sizes) / n and min(sizes) > 0.99 * sum(sizes) / n


def test_regions_follow_the_metadata(spark):
    """Of two far groups of numbers with equal bytes each is half the shards; brute force: the widest dimension's weighted median."""
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), 50).alias("text"), F.when(F.col("id") < 4000, F.col("id") % 10).otherwise(1000 + F.col("id") % 10).alias("year"))
    got = sharding.shards(docs, ["year"], n_shards=4).collect()
    assert all((r.doc_id >= 4000) == (r.shard >= 2) for r in got)
    by = {r.doc_id: r.shard for r in got}
    years = [max(d % 10 for d, s in by.items() if s == 0), min(d % 10 for d, s in by.items() if s == 1)]
    assert years[0] <= years[1]
    assert sharding.shards(docs, ["year"], target_bytes=66 * 2000).select("shard").distinct().count() == 4


def test_odd_rows(spark):
    df = documents(spark, ODD * 3)
    check(df, sharding.shards(df, ["source", "lang", "n_chars", "score"], n_shards=40).collect(), 40)
    assert sharding.shards(df.where("false"), ["source", "lang"], n_shards=40).count() == 0
    nan = df.limit(3).withColumn("score", F.expr("double('NaN')"))
    check(nan, sharding.shards(nan, ["score"], n_shards=3).collect(), 3)


def test_no_python_on_the_way(spark, sf):
    plan = queries.op13_sharding(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
