"""Send the package to the executors, which need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def attach(spark: SparkSession) -> SparkSession:
    """Once for an application: its Python workers can import this package."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="quarry-code-")) / "quarry_code.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(target))
        _sent.add(sc.applicationId)
    return spark
