"""Session helpers.

The library never creates its own session in library code paths: every
public function takes DataFrames (or a ``SparkSession``) from the caller.
``get_session`` is a convenience for tests, the bench and examples.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "dyadic",
                shuffle_partitions: int | None = None) -> SparkSession:
    master = master or os.environ.get("DYADIC_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("DYADIC_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DYADIC_DRIVER_MEMORY", "16g"))
        .config("spark.python.worker.reuse", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared, reliable folder and is
    used as is. Only when it is unset (tests, a laptop) a fresh local folder is
    created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a shared, reliable folder for checkpoints")
    path = tempfile.mkdtemp(prefix="dyadic-ckpt-")
    sc.setCheckpointDir(path)
    return path


def stored_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the checkpoint directory and read back, for tables that several passes read:
    its plan runs once. A table that was stored here is returned as it is."""
    if getattr(df, "_dyadic_stored", False):
        return df
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/dyadic-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._dyadic_stored = True
    return out


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers wherever the driver was
    started: a zip of it is handed to Spark's file distribution once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_dyadic_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="dyadic-zip-"), "dyadic.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("dyadic", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._dyadic_shipped = True


def default_slices(spark: SparkSession) -> int:
    """Number of range slices used by ordered scans (see ``operators.scan``)."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
