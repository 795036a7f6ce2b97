"""Session defaults, and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import weakref
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: "weakref.WeakSet" = weakref.WeakSet()

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine. On a cluster use the session that it gives."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("curaspark")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per context.

    Functions given to mapInArrow and the like are pickled by reference to this package,
    which executors on other machines, or workers started from another folder, need not find.
    """
    context = spark.sparkContext
    if context in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="curaspark-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file while it runs
    context.addPyFile(shutil.make_archive(os.path.join(folder, "curaspark_src"), "zip", root.parent, root.name))
    _SHIPPED.add(context)
