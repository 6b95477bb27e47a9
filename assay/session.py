"""Session helpers.

On a cluster the session already exists and carries the operator's settings; we only
fill in what is unset (shuffle partitions, checkpoint folder) so local tests behave.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every query in this package assumes.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "assay", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    parts = shuffle_partitions or (8 if cores == "*" else max(2, int(cores)))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.driver.memory", os.environ.get("ASSAY_DRIVER_MEMORY", "8g"))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the required SQL settings to an existing session and ship the package to the
    executors' Python workers (idempotent)."""
    for k, v in REQUIRED_CONF.items():
        if k != "spark.sql.execution.arrow.pyspark.enabled":
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``assay`` importable on every executor (UDFs and ``mapInPandas`` functions refer to it).

    The package is zipped on the driver once per session and added with ``addPyFile``: Spark's
    own file server hands it to the executors, so no shared folder or URI is involved.
    """
    if spark.conf.get("spark.assay.shipped", "false") == "true":
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="assay-code-"), "assay")
    spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root_dir=os.path.dirname(pkg_dir), base_dir="assay"))
    spark.conf.set("spark.assay.shipped", "true")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (the cluster names a shared, durable folder there).
    Only when it is unset and the master is local - tests - do we create a scratch folder
    ourselves; on a cluster an unset folder is an error, since executors share no local disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="assay-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured
