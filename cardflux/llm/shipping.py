"""The package's own code on executors that do not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import cardflux

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add this package to the application's Python files, once per application."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        root = Path(cardflux.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="cardflux-")) / "cardflux-code.zip"
        with zipfile.ZipFile(archive, "w") as packed:
            for file in sorted(root.rglob("*.py")):
                packed.write(file, Path("cardflux") / file.relative_to(root))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(application)
    return spark
