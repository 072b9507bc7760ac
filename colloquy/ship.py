"""Make the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once for each application, unless PYTHONPATH names it."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    _done.add(app)
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp(prefix="colloquy-")) / "colloquy_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(target))
