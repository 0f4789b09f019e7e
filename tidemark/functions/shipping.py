"""Making this package importable in Python workers that don't share the driver's search path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once a context, unless the workers' search path has it anyway."""
    shared = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if _ROOT in shared or context.applicationId in _shipped or (context.master.startswith("local[") and os.getcwd() == _ROOT):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "tidemark")):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), _ROOT))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
