"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Settings that change results (time zone) or let AQE repair skew and
#: partition counts at run time.  Sizes stay with the cluster's own defaults.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # shuffled joins hash instead of sort where every build partition was measured to be small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "67108864",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_CONF` to a session that already exists."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Single-machine session used by the tests and ``bench.py``."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidegauge")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def at_once(spark: SparkSession, *steps: Callable) -> list:
    """Results of steps that start jobs of their own, side by side: what one leaves idle at the end of a stage the other takes."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def is_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only on a single machine (tests) that names none a temporary folder is made
    and set on the context, so it is found again; a cluster has to name one,
    since its executors do not share /tmp.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not is_one_machine(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tidegauge-", dir="/tmp"))
        folder = context.getCheckpointDir()
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint`` usable; an already set folder is kept."""
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written mid-query."""
    return f"{shared_folder(spark).rstrip('/')}/tidegauge/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage at a place any executor can read again, computes a result
    that several later steps share only once, and gives the planner its true
    size, so that joins with it are broadcast only while it is small.  ``rows``:
    the most rows of a file (0: no limit).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
