"""Puts this package where Python workers can import it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Sends the package to the session's workers once, unless they find it on their path anyway."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or any(f.endswith("/mercantor.zip") for f in context.listFiles):
        return
    with tempfile.TemporaryDirectory() as there:
        kept = Path(there) / "package"
        shutil.copytree(ROOT / "mercantor", kept / "mercantor", ignore=shutil.ignore_patterns("__pycache__"))
        out = tempfile.mkdtemp(prefix="mercantor-")
        context.addPyFile(shutil.make_archive(f"{out}/mercantor", "zip", kept))
