"""Make this package importable for Python workers that were started without it."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


@functools.lru_cache(maxsize=4)
def _shipped(application: str, spark: SparkSession) -> None:
    root = Path(__file__).parent.parent
    archive = Path(tempfile.mkdtemp(prefix="lumenframe-")) / "lumenframe.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in [*sorted((root / "lumenframe").rglob("*.py")), *root.glob("corpus_pipeline.py")]:
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's files to the executors, once an application."""
    _shipped(spark.sparkContext.applicationId, spark)
    return spark
