"""Sends this package to the executors, for sessions whose workers do not find it by their own path."""

from __future__ import annotations

import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Adds the package's modules as a zip to the session's files, once for each context."""
    context = spark.sparkContext
    if context in _SENT:
        return
    home = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="pathspring-")) / "pathspring.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for module in sorted(home.rglob("*.py")):
            archive.write(module, module.relative_to(home.parent))
    context.addPyFile(str(path))
    _SENT.add(context)
