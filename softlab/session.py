"""Session helpers.

The library never creates a session on its own; ``local_session`` is only
for tests, ``bench.py`` and command-line use.  ``checkpoint_dir`` reads the
cluster's shared ``spark.checkpoint.dir`` and only falls back to a fresh
scratch folder when the setting is absent (local runs, tests).
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "softlab") -> SparkSession:
    """A local session configured the way a cluster job would be.

    AQE is on (coalescing + skew-join splitting), the UI is off, Arrow is
    enabled for the few pandas paths, and time is UTC.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SOFTLAB_DRIVER_MEM", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        # local test tables are files of one row group: see fixtures.spread
        .config("spark.softlab.scanPartitions", str(os.cpu_count() if cores == "*" else cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # broadcast only what we broadcast explicitly after a size check
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder; use it (it
    is a core setting, read from the session, never overwritten here).  Only
    in local mode, where it may be unset (tests), a fresh scratch folder is
    made and registered; on a cluster a missing setting is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="softlab-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (never machine-local
    on a cluster, because the parent comes from ``spark.checkpoint.dir``)."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per application: functions that run
    there name its modules, and only the driver's path is known to hold them."""
    sc = spark.sparkContext
    if getattr(sc, "_softlab_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="softlab-ship-"), "softlab_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._softlab_shipped = True


def release(spark: SparkSession) -> None:
    """Let the driver drop what finished steps left: plans that nobody holds any
    more, and with them their shuffles and broadcasts (Spark's cleaner waits for a
    collection, which a large heap puts off), and give free heap back."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_table(df, name: str):
    """``df`` written to the shared checkpoint folder and read again: its
    lineage ends there, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
