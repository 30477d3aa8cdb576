"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_FOLDERS: dict[str, str] = {}       # application to its folder


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "slicewise", **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC time.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: adaptive execution
    coalesces from the cluster's own (large) initial partition number.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")
         .config("spark.ui.enabled", "false"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    spark = b.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Gives the workers this package, wherever the driver was started. Spark serves the
    archive from the driver; it is made once per application."""
    name = f"slicewise-{spark.sparkContext.applicationId}"
    if name in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="slicewise-ship-")
    root = Path(__file__).resolve().parents[1]
    try:
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{name}", "zip", root, "slicewise"))
    finally:
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _SHIPPED.add(name)


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the application's folder in ``spark.checkpoint.dir``.

    The application's folder is removed when its JVM ends, so nothing is left in the shared
    store. Only a local session may fall back to a temporary folder of the machine.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            base = tempfile.gettempdir()
        _FOLDERS[app] = f"{base.rstrip('/')}/slicewise-{app}-{uuid.uuid4().hex[:8]}"
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(_FOLDERS[app])
        store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(folder)
        store.deleteOnExit(folder)
    return f"{_FOLDERS[app]}/{label}-{uuid.uuid4().hex}"
