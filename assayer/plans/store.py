"""Written intermediate tables: the way this library cuts lineage.

A table goes to the shared folder that the cluster names in ``spark.checkpoint.dir``, so a lost executor costs a
re-read and nothing else. Where the setting is absent, a local master uses a temporary folder of this process and
any other master the warehouse, which its executors share as well.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_root(spark: SparkSession) -> str:
    """The folder for written intermediates that driver and executors both see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _own_folder()
    return spark.conf.get("spark.sql.warehouse.dir")


class Scratch:
    """A new folder below the shared root; ``keep`` writes a table there and returns its re-read form."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Removes a table that nothing lazy reads any more."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(name))
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
