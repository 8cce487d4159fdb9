"""Makes the package importable in the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: list = []


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per Spark context."""
    sc = spark.sparkContext
    if any(known is sc for known in _SHIPPED):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="kinmatch-")) / "kinmatch.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent).as_posix())
    sc.addPyFile(str(archive))
    _SHIPPED[:] = [sc]
