"""Getting this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once an application; a local session whose PYTHONPATH leads to it needs none."""
    root = Path(__file__).resolve().parent
    sc = spark.sparkContext
    on_path = str(root.parent) in [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if (on_path and sc.master.startswith("local")) or sc.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="markgrove-")) / "markgrove.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
