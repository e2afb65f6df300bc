"""Session construction and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the reporting plans rely on.  AQE re-plans joins from measured
# shuffle sizes (broadcast only what turned out small, split skewed
# partitions); the rest keeps local runs quiet and deterministic.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "2m",
    "spark.sql.files.openCostInBytes": "256k",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


RUN: ContextVar[str | None] = ContextVar("scratch folder of the current run", default=None)


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "12g", **conf: str
) -> SparkSession:
    """A local session for tests and the bench (a cluster brings its own)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("sellerdesk")
    settings = {
        **DEFAULT_CONF,
        "spark.driver.memory": driver_memory,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    It must be set: a folder that every executor and the driver can reach.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused location under the checkpoint folder, or under that of the run."""
    root = (RUN.get() or checkpoint_root(spark)).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """A scratch folder of one run: what is staged inside the block is deleted at its end.

    For jobs that write their results (``sinks.publish``) inside the block; a
    DataFrame that still reads staged tables must not outlive it.
    """
    folder = scratch_path(spark, "run")
    token = RUN.set(folder)
    try:
        yield folder
    finally:
        RUN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


HASH_JOIN_MB = 64  # of a partition of a join's smaller side, as shuffled


def hash_joins(spark: SparkSession) -> None:
    """Let Spark join by hash where each shuffled partition of one side is small.

    Of two large sides neither is then sorted.  Spark decides from the measured sizes;
    a side with a larger partition is still joined by sorting, so memory stays bounded.
    """
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", f"{HASH_JOIN_MB}m")


HUGE_METHOD = 8000  # bytes of a method from which HotSpot leaves it to its interpreter


def compiled_methods(spark: SparkSession) -> None:
    """Run operators one by one where their common generated method would not be compiled.

    Cleaning many columns in one step makes such methods; Spark's own limit is eight times
    HotSpot's, and each row would be interpreted.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(HUGE_METHOD))


def drop_used_shuffles(spark: SparkSession) -> None:
    """Let Spark delete a query's shuffle files when the query has ended.

    Plans of several written steps would else hold the shuffles of every
    step on the executors' disks until the driver happens to collect garbage.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    A stage boundary for an intermediate that several branches of one plan
    read: it is computed once, survives the loss of any executor (it is in
    the shared folder, not in executor memory or local disk) and cuts the
    lineage; readers get column pruning and filter pushdown on it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
