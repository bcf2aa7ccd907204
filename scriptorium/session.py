"""Session construction for tests, benchmarks and interactive work."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "scriptorium") -> SparkSession:
    """A local session with adaptive execution; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SCRIPTORIUM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One driver table as a DataFrame; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below the one that ``spark.checkpoint.dir`` names.

    Where the setting is missing and the session runs inside one process (tests) it is a temporary
    folder of this process; a cluster without the setting is an error.
    """
    global _local
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if _local is None:
            _local = tempfile.mkdtemp(prefix="scriptorium-")
            atexit.register(shutil.rmtree, _local, ignore_errors=True)
        base = f"file://{_local}"
    return f"{base.rstrip('/')}/scriptorium-{context.applicationId}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, so Python functions load anywhere."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="scriptorium-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = f"{folder}/scriptorium.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
