"""Session settings and the few cluster facts operators ask for."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

from .errors import LoomError

# Upper bound for anything an operator ships to every executor.
BROADCAST_BYTES_KEY = "vectorloom.broadcast.bytes"
BROADCAST_BYTES_DEFAULT = 64 << 20


def build_session(master: str = "local[*]", app: str = "vectorloom", shuffle_partitions: int = 8) -> SparkSession:
    """A session for local runs; on a cluster use the one you are given."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_BYTES_KEY, str(BROADCAST_BYTES_DEFAULT)))


SMALL_BYTES = 4 << 20


def shuffle_width(df: DataFrame, ceiling: int = 4096) -> int:
    """How many ranges an ordered operator splits into.

    One where the optimizer's own size estimate is a few megabytes, else one
    per shuffle partition.  An estimate that is off changes only the balance.
    """
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL_BYTES:
        return 1
    return max(1, min(ceiling, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints and intermediate tables.

    Where none is named a local session gets a temporary one; a cluster is refused,
    as its executors could not see it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise LoomError("SHARED_FOLDER_MISSING", "spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vectorloom-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and ends the plan's history."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application.

    Needed where the workers cannot import it, as when it is only on the
    driver's path.
    """
    context = spark.sparkContext
    name = f"vectorloom-{context.applicationId}.zip"
    if name in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    shared = shared_folder(spark).removeprefix("file:")
    # A store that is not a mounted folder cannot hold the archive; Spark
    # uploads it from the driver either way.
    folder = shared if "://" not in shared else tempfile.mkdtemp(prefix="vectorloom-package-")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with zipfile.ZipFile(path, "w") as pack:
        for inside, _inner, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(inside, file)
                    pack.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _SHIPPED.add(name)


_SHIPPED: set[str] = set()
