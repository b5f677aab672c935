from assayer.operators import corpus

FILES = [
    ("reconstructions/ge/s1/r100/image.nii", 10),
    ("reconstructions/ge/s1/r025/image.nii", 7),
    ("reconstructions/ge/s1/r025/error_abs.nii", 5),
    ("baselines/median/ge/s1/r025/error_abs.nii", 4),
    ("tree=baselines/method=mean/vendor=ge/scan=s2/level=r010/name=image.nii/part-000.txt", 3),
    ("tree=baselines/method=mean/vendor=ge/scan=s2/level=r010/name=image.nii/part-001.txt", 0),
    ("README.md", 2),
    ("reconstructions/ge/s1/image.nii", 1),
]


def test_layout_counts_and_gaps(spark):
    r = corpus.typed(spark.createDataFrame(FILES, "path string, length long"))
    assert {tuple(x) for x in corpus.by_type(r).collect()} == {("image.nii", 3, 20, 3, 2), ("error_abs.nii", 2, 9, 2, 1), ("other", 2, 3, 0, 0)}
    got = {(x.tree, x.method, x.scan, x.level, x.name) for x in corpus.lacking(r, ["image.nii"], ["image.nii", "error_abs.nii"]).collect()}
    assert got == {("baselines", "median", "s1", "r025", "image.nii"), ("baselines", "mean", "s2", "r010", "error_abs.nii")}
    assert corpus.lacking(r, [], []).count() == 0
    empty = corpus.typed(spark.createDataFrame([], "path string, length long"))
    assert corpus.by_type(empty).count() == corpus.lacking(empty, ["a"], ["b"]).count() == 0


def test_listing_reads_no_content(spark, tmp_path):
    for path, n in FILES:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x" * n)
    found = corpus.listing(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {f for f in FILES if f[1]}
    assert "ReadSchema: struct<path:string,length:bigint>" in found._jdf.queryExecution().executedPlan().toString()


def test_stored_counts(spark):
    found = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "name string, n long, bytes long")
    stored = spark.createDataFrame([("a", 1, 4), ("c", 3, 7)], "name string, n long, bytes long")
    got = {tuple(r) for r in corpus.counts_differ(found, stored, "name", ["n", "bytes"]).collect()}
    assert got == {("a", "bytes", 4, 5), ("b", "n", None, 2), ("b", "bytes", None, 6), ("c", "n", 3, None), ("c", "bytes", 7, None)}
