"""Sends this package to the executors' Python, wherever the driver imported it from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a session; Spark's own file server carries the archive."""
    context = spark.sparkContext
    if not getattr(context, "_package_shipped", False):
        root = Path(__file__).resolve().parents[2]
        place = Path(tempfile.mkdtemp(prefix="package")) / "stintforge_package.zip"
        with zipfile.ZipFile(place, "w") as out:
            for file in sorted((root / "stintforge").rglob("*.py")):
                out.write(file, file.relative_to(root))
        context.addPyFile(str(place))
        context._package_shipped = True
