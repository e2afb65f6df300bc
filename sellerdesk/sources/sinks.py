"""Report sinks.

Reports are written once per job from one lazy plan; there is no CSV round
trip between stages (D19).  The per-BDM extracts of the reference (a loop of
sheet writes per manager) are one partitioned write.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How a missing value is spelled in written reports.
REPORT_NULL = "NA"


def write_report(
    df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", compression: str = "none"
) -> str:
    """Write a report (CSV with header and 'NA' for missing, or Parquet).

    ``compression`` is of the CSV files: those of a report of many rows take a
    fraction of their room as ``gzip``."""
    w = df.write.mode(mode)
    if fmt == "csv":
        (
            w.option("header", True)
            .option("nullValue", REPORT_NULL)
            .option("compression", compression)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    else:
        w.format(fmt).save(path)
    return path


# ---- publishing ------------------------------------------------------------
# A published report is a folder of versions and a small file that names the
# current one.  The file is replaced by one rename after the version is whole,
# so a run that dies at any point leaves the report as it was.
CURRENT = "_CURRENT"


def _filesystem(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(path), conf)


def _jpath(jvm, path: str):
    return jvm.org.apache.hadoop.fs.Path(path)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the published version of the report at ``path``; None before the first."""
    jvm, files = _filesystem(spark, path)
    name = _jpath(jvm, f"{path}/{CURRENT}")
    if not files.util().exists(name):
        return None
    stream = files.open(name)
    try:
        return f"{path}/" + jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def publish(
    df: DataFrame,
    path: str,
    write: Callable[[DataFrame, str], object] = write_report,
    keep: int = 2,
) -> str:
    """Write a new version of the report at ``path`` and switch to it.

    Readers take :func:`current_version`.  ``keep`` versions stay, the published
    one included, for readers that are not done with it; older ones, and what runs
    that died have left, are deleted after the switch.
    """
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    before = current_version(spark, path)
    write(df, f"{path}/{version}")
    jvm, files = _filesystem(spark, path)
    fresh = _jpath(jvm, f"{path}/{CURRENT}-{version}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0)
    out = files.create(fresh, flags, no_options)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fresh, _jpath(jvm, f"{path}/{CURRENT}"), overwrite)
    _delete_old(spark, path, version, before, keep)
    return f"{path}/{version}"


def _delete_old(spark: SparkSession, path: str, version: str, before: str | None, keep: int) -> None:
    jvm, files = _filesystem(spark, path)
    found = [s for s in files.util().listStatus(_jpath(jvm, path)) if s.getPath().getName().startswith("version-")]
    found.sort(key=lambda s: s.getModificationTime(), reverse=True)
    last = before.rsplit("/", 1)[1] if before else ""
    order = sorted(found, key=lambda s: [version, last].index(s.getPath().getName()) if s.getPath().getName() in (version, last) else 2)
    for s in order[max(keep, 1) :]:
        files.delete(s.getPath(), True)


def write_partitioned(df: DataFrame, column: str, path: str) -> str:
    """One folder per value of ``column``, Parquet; a hot value has several writers."""
    df.hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(path)
    return path


def write_bdm_extracts(
    report: DataFrame, targets: DataFrame, path: str, max_records_per_file: int = 1_000_000
) -> str:
    """One extract folder per ``target`` of ``targets(bdm, target)``, in it the rows
    of the target's BDM and the date of the update.

    Rows without a BDM never match a target (N14).  The target list is a join,
    not a driver loop.  ``rebalance`` on the target lets AQE split a BDM that
    holds a large share of the rows over several writers, so no single task
    writes a hot manager's whole extract.
    """
    rows = report.join(targets.select("bdm", "target").distinct(), "bdm")
    rows = rows.withColumn("update_date", F.current_date())
    (
        rows.hint("rebalance", "target")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("target")
        .parquet(path)
    )
    return path
