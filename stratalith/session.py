"""Making the library importable where Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per context, so functions pickled by name load
    there whatever the workers' folder is. Returns the session."""
    sc = spark.sparkContext
    if not getattr(sc, "_stratalith_shipped", False):
        package = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="stratalith-"), "stratalith.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(package.rglob("*.py")):
                z.write(path, path.relative_to(package.parent))
        sc.addPyFile(target)
        sc._stratalith_shipped = True
    return spark
