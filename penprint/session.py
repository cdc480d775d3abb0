"""Session helpers: one place for the settings every job relies on.

Nothing here changes settings a cluster already made; it only fills in what is
unset (local runs and tests).
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs assume. Applied only when the session does not set them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# Heap of a local run's single JVM.
LOCAL_MEMORY = "8g"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "penprint") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local") and not os.environ.get("PYSPARK_SUBMIT_ARGS"):
            # A local run is one JVM; Spark's default heap of 1 GB makes it spill on small tables.
            builder = builder.config("spark.driver.memory", LOCAL_MEMORY)
    builder = builder.config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints, if any."""
    value = spark.conf.get("spark.checkpoint.dir", None)
    if not value:
        value = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not value:
        value = spark.sparkContext.getCheckpointDir()
    return value or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder. Without one a local master (tests) gets a temporary folder; a cluster,
    whose executors could not share it, is an error."""
    value = checkpoint_dir(spark)
    if value:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(value)
        return value
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="penprint-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table; deleted when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex[:12]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _scratch[app] = folder
    return f"{_scratch[app]}/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers if they could not import it themselves.

    An installed package, or one on PYTHONPATH or in the working folder, is
    left alone. Otherwise (a notebook that only changed ``sys.path``) a zip is
    handed to Spark, which serves it to its executors.
    """
    app = spark.sparkContext.applicationId
    root = Path(__file__).resolve().parent.parent
    seen = [Path.cwd(), *map(Path, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))]
    if app in _shipped or root in [p.resolve() for p in seen] or "site-packages" in root.parts:
        return
    name = os.path.join(tempfile.mkdtemp(prefix="penprint-code-"), "penprint")
    spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", root, "penprint"))
    _shipped.add(app)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as compressed Parquet under the shared checkpoint folder; smaller than a checkpoint."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
