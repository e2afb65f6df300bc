"""Incremental ingest of a growing export folder.

The reporting job re-reads every order export in its folder on each run
(minutes of parsing that grow with history).  A file-source stream with
``trigger(availableNow=True)`` reads only files it has not seen, cleans
them with the same column functions as the batch path, appends them to the
order-line table and stops.  The stream's checkpoint lives in the shared
folder, so a lost executor or a killed run resumes without re-reading or
double-counting a file.

Streaming file sources need one declared layout per folder (the header is
checked against it); folders mixing layouts go through the batch
``scan_union_by_name``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sellerdesk.plans.inputs import clean_sales
from sellerdesk.session import scratch_path
from sellerdesk.sources.files import ORDER_HEADERS, orders_from_export, string_schema

KEY_TYPES = {
    "o_key": "bigint",
    "line_no": "int",
    "part_key": "bigint",
    "supp_key": "bigint",
    "qty_raw": "double",
    "ext_price": "double",
}


def order_export_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming rows of the order exports landing in ``folder``, typed and keyed."""
    header = [*ORDER_HEADERS, *KEY_TYPES]
    raw = (
        spark.readStream.schema(string_schema(header))
        .option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("recursiveFileLookup", True)
        .csv(folder)
    )
    named = raw.select(
        *[F.col(f"`{h}`").alias(n) for h, n in ORDER_HEADERS.items()],
        *[F.col(k).cast(t).alias(k) for k, t in KEY_TYPES.items()],
    )
    return clean_sales(orders_from_export(named))


def ingest_order_exports(
    spark: SparkSession, folder: str, table: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Append every not-yet-seen export file under ``folder`` to ``table``
    (Parquet), then stop.  Returns the started query; call
    ``awaitTermination()`` to wait for it."""
    lines = order_export_stream(spark, folder)
    return (
        lines.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "order-ingest-checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
