"""Makes this package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the workers, once per application and only where their path may lack them."""
    context = spark.sparkContext
    seen = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if ROOT in seen or Path.cwd() == ROOT or getattr(context, "_lacuna_shipped", False):
        return
    with tempfile.NamedTemporaryFile(suffix=".zip", prefix="lacuna-", delete=False) as file:
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as bundle:
            for path in sorted((ROOT / "lacuna").rglob("*.py")):
                bundle.write(path, path.relative_to(ROOT))
    context.addPyFile(file.name)
    context._lacuna_shipped = True
