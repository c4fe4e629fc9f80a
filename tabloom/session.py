"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that change results (time zone) or keep skewed joins spread out.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: str | int = "*", name: str = "tabloom") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    n = 8 if str(cpus) == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", _own_folder())
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _own_folder() -> str:
    """A folder of this process alone, gone when it ends."""
    folder = tempfile.mkdtemp(prefix="tabloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def work_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, from ``spark.checkpoint.dir``.

    A cluster must name a shared folder there: a machine-local folder would
    vanish with its machine.  Only a local master that names none gets a
    folder of its own, which goes when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _own_folder()
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the work folder."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df, label: str):
    """Write ``df`` once to the work folder and read it back.

    Used where a result is read more than once and recomputing it would
    repeat a shuffle; unlike a cache it survives lost executors.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
