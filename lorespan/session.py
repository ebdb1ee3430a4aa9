"""Make the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, unless the Python path already leads them to it."""
    app = spark.sparkContext.applicationId
    paths = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p}
    if app not in _shipped and str(ROOT) not in paths:
        target = os.path.join(tempfile.mkdtemp(prefix="lorespan-code-"), "lorespan.zip")
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted((ROOT / "lorespan").rglob("*.py")):
                z.write(f, str(f.relative_to(ROOT)))
        spark.sparkContext.addPyFile(target)
    _shipped.add(app)
    return spark
