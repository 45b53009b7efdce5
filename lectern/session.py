"""Session helpers.

Operators never create sessions; only entry points (bench, tests, the
driver contract) do.  ``configure`` applies the settings every plan in
this package assumes (AQE on, UTC, no UI) to an existing session, and
``ensure_checkpoint_dir`` gives the folder for intermediate tables: the
cluster's ``spark.checkpoint.dir``, or a private one in local mode.
``remove_intermediate`` empties it.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Broadcast decisions are Spark's, from file sizes and at runtime from
# measured ones; the threshold stays at its default.
_SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "lectern") -> SparkSession:
    """Create (or reuse) a session for local runs, tests and benchmarks."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LECTERN_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    )
    for key, value in _SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    for key, value in _SESSION_CONF.items():
        spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only in local mode, where nothing is shared, an unset folder is replaced
    by a private one that goes when the process ends."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/object store) so intermediate tables survive executor loss")
        configured = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def remove_intermediate(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; call it when no
    result that reads them is needed any more."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.delete(path, True)
        system.mkdirs(path)
