"""Give the executors this package, wherever the session was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors' Python workers, once for each Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_covagrid_sent", False):
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="covagrid-")) / "covagrid.zip"
        with zipfile.ZipFile(target, "w") as packed:
            for path in sorted(top.rglob("*.py")):
                packed.write(path, os.path.join("covagrid", path.relative_to(top)))
        context.addPyFile(str(target))
        context._covagrid_sent = True
    return spark
