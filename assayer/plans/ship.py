"""Makes this package importable in Spark's Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


#: Spark's own bound for the Arrow batches that go to Python workers, and the one set here: several workers share an executor.
_DEFAULT, _BATCH = str(64 << 20), str(8 << 20)


def ship(spark: SparkSession) -> None:
    """Makes workers ready: bounds Arrow batches by bytes where the user has not, and adds the package's source to the
    application once; the latter is a no-op where the workers' path already has it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == _DEFAULT:
        spark.conf.set(name, _BATCH)
    context, home = spark.sparkContext, Path(__file__).resolve().parents[2]
    listed = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.applicationId in _SHIPPED or str(home) in listed:
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "assayer.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted((home / "assayer").rglob("*.py")):
            z.write(source, source.relative_to(home))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
