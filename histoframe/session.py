"""Session helpers shared by every part of the package."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
_shipping = threading.Lock()


def build_session(name: str = "histoframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; any setting can be overridden by keyword (dots as __)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers when it isn't on their PYTHONPATH already."""
    app = spark.sparkContext.applicationId
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p}
    if str(ROOT) in on_path:
        return
    with _shipping:  # queries may start from several threads
        if app in _shipped:
            return
        stage = tempfile.mkdtemp(prefix="histoframe-zip-")
        shutil.copytree(ROOT / "histoframe", f"{stage}/src/histoframe", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{stage}/histoframe", "zip", f"{stage}/src"))
        _shipped.add(app)


def bound_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Smaller Arrow batches for tables of long texts, where the session has Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
