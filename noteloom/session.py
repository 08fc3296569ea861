"""A session with the settings the engine expects."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless PYTHONPATH gives it to them already; once per application."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _SHIPPED or root in known:
        return
    _SHIPPED.add(app)
    base = os.path.join(tempfile.mkdtemp(prefix="noteloom-ship-"), "noteloom")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "noteloom"))


def local_session(cores: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8, app: str = "noteloom") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
