from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases, test_decontaminate, test_minhash
from tests.llm.test_tokens import check_packing


def without_repeats(docs, length=400):
    """The stage by brute force: bytes left, cut characters dropped."""
    from collections import Counter

    import numpy as np

    raws = [(d, (t or "").encode()) for d, t in docs]
    starts = Counter(b[i : i + length] for _, b in raws for i in range(len(b) - length + 1))
    out = []
    for d, b in raws:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                hit[i : i + length] = True
        out.append((d, bytes(np.frombuffer(b, np.uint8)[~hit]).decode(errors="ignore")))
    return out


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    stage = dict(corpus_pipeline.STAGES)

    clean = stage[names[0]](spark, docs, sf)
    assert clean.columns == columns
    texts = [(r.doc_id, r.text) for r in clean.collect()]
    assert 0 < len(texts) < docs.count()

    texts = sorted((d, t) for d, t in texts if {x: k for x, _, _, k in test_minhash.brute(texts, 5, 80)}[d])
    texts = without_repeats(texts)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, *_, contaminated in test_decontaminate.brute(texts, items) if contaminated}
    texts = [(d, t) for d, t in texts if d not in bad]
    used, least = check_packing(corpus_pipeline.run(spark, sf).collect(), texts)
    assert used <= least + 1


def test_columns_and_n_chars_follow_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert out.where("n_chars <> length(text)").isEmpty()


def test_odd_rows_go_through_every_stage(spark, sf):
    """Nulls in any column, repeated rows, empty and long texts, no row at all, and columns that clash with names inside the stages."""
    odd = cases.documents(spark, cases.ODD * 2).withColumn("_gone", F.lit(1)).withColumn("doc id.2", F.lit("x")).withColumn("id", F.lit(0))
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            kept = [r.doc_id for r in out.select("doc_id").collect()]
            assert set(kept) <= {r.doc_id for r in docs.select("doc_id").collect()}, name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert len(packed) >= docs.count()
