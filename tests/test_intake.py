from pathlib import Path

from pyspark.sql import functions as F

from assayer.operators.preparation import hex_decimal
from assayer.sources import readers, writers


def test_one_object_a_file_in_many_folders(spark, tmp_path):
    rows = spark.range(60).withColumn("name", F.concat(F.lit("n"), "id"))
    writers.json_files(rows, "id", str(tmp_path / "f"), in_folder=10)
    files = list(Path(tmp_path / "f").rglob("*.json"))
    assert len(files) == 60 and len({f.parent for f in files}) > 2
    got = readers.json_objects(spark, str(tmp_path / "f"), "id long, name string").collect()
    assert sorted((r.id, r.name) for r in got) == [(i, f"n{i}") for i in range(60)] and all(r.file.endswith(".json") for r in got)
    writers.json_files(rows.where("false"), "id", str(tmp_path / "none"))
    assert readers.json_objects(spark, str(tmp_path / "none"), "id long").count() == 0


def test_hexadecimal_numbers_of_any_length(spark):
    numbers = ["0", "f", "00000000", "0001", "3b9aca00", "f" * 32, "8" + "0" * 31, "abc" * 21 + "d", "f" * 77]
    df = spark.createDataFrame([(x,) for x in numbers] + [(None,)], "x string")
    assert [r[0] for r in df.select(hex_decimal(F.col("x"))).collect()] == [str(int(x, 16)) for x in numbers] + [None]
