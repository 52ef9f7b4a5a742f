"""What every query needs of a session: the package on the executors' Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, so that it needn't be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="tidemark-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch the file from the driver at any time
    with zipfile.ZipFile(path := f"{folder}/{root.name}.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped[sc.applicationId] = path
