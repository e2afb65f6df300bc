"""Proportional stratified interleaving of rows into shards.

Rows of each source are put in a seeded random order; a row's fractional rank
is its place there over the source's size, shifted by a phase of the source
(so that small sources do not all meet at one point).  Sorting all rows by
fractional rank interleaves the sources in proportion, and equal cuts of that
order give shards that each hold the whole mixture, with row counts at most
one apart.

No global sort and no task that owns a source: ranks come in two steps, a
prefix sum over bucket counts (a bucket holds about ``BUCKET_ROWS`` rows, cut
by the draw, so a source with a third of all rows is many buckets) and a row
number inside each bucket.  The same is done for the global order.  Only the
narrow rows (key, source, digests) are shuffled, never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sellerdesk.llm.common import DRAW_RANGE, draw
from sellerdesk.session import stage

BUCKET_ROWS = 4096


def _bucket_starts(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Exclusive prefix sum of ``_n`` over buckets (one row per bucket)."""
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")


def interleave_shards(
    rows: DataFrame,
    n_shards: int = 16,
    strata: str = "source",
    key: str = "doc_id",
    digest: str = "text_crc32",
    seed: int = 20240501,
) -> DataFrame:
    """Add ``shard`` (int, 0 to n_shards - 1) and ``slot`` (long, gapless from 0).

    ``rows``: narrow rows (no texts).  A null source is a stratum of its own; a
    null key draws from the digest alone.  Repeated rows are separate rows, each
    with its own slot.  An empty table gives an empty result.  Other columns of
    ``rows`` are kept and never read, whatever their names, except for the
    names given here and those beginning with ``_``.
    """
    spark = rows.sparkSession
    drawn = stage(
        rows.withColumn("_draw", draw(seed, F.col(key), F.col(digest))), "shard-rows"
    )
    total = drawn.count()
    if not total:
        return drawn.drop("_draw").select(
            "*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")
        )

    def same(a: str, b: str) -> Column:
        return F.col(a).eqNullSafe(F.col(b))

    # 1. size and phase of each source
    sizes = drawn.groupBy(F.col(strata).alias("_s")).agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_phase", draw(seed + 1, F.col("_s")) / F.lit(DRAW_RANGE))
    placed = drawn.join(sizes, same(strata, "_s"), "left").drop("_s")
    placed = placed.withColumn(
        "_b",
        F.floor(F.col("_draw") / F.lit(DRAW_RANGE) * F.ceil(F.col("_size") / F.lit(BUCKET_ROWS))),
    )
    # 2. rank inside the source: rows of earlier buckets + place in the own bucket
    starts = _bucket_starts(
        placed.groupBy(F.col(strata).alias("_s"), F.col("_b").alias("_sb")).agg(F.count("*").alias("_n")),
        ["_s"],
        "_sb",
    )
    placed = placed.join(starts, same(strata, "_s") & (F.col("_b") == F.col("_sb")), "left")
    ties = [c for c in ("_draw", key, digest) if c]
    inside = Window.partitionBy(strata, "_b").orderBy(*ties)
    rank = F.col("_start") + F.row_number().over(inside)
    placed = placed.withColumn("_frac", (rank - F.lit(1) + F.col("_phase")) / F.col("_size"))
    placed = placed.drop("_s", "_sb", "_b", "_start", "_size", "_phase")
    # 3. global place by fractional rank, again in buckets
    n_buckets = -(-total // BUCKET_ROWS)
    placed = stage(
        placed.withColumn(
            "_b", F.least(F.floor(F.col("_frac") * F.lit(n_buckets)), F.lit(n_buckets - 1))
        ),
        "shard-ranks",
    )
    starts = _bucket_starts(
        placed.groupBy(F.col("_b").alias("_sb")).agg(F.count("*").alias("_n")), [], "_sb"
    )
    placed = placed.join(starts, F.col("_b") == F.col("_sb"), "left")
    inside = Window.partitionBy("_b").orderBy("_frac", strata, *ties)
    place = F.col("_start") + F.row_number().over(inside) - F.lit(1)
    placed = placed.withColumn("_place", place)
    # 4. equal cuts
    shard = F.expr(f"_place * {n_shards} div {total}")
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("slot", F.col("_place") - first).drop(
        "_draw", "_frac", "_b", "_sb", "_start", "_place"
    )


def shard_rows(docs: DataFrame) -> DataFrame:
    """The narrow rows of ``docs``: doc_id, source, size, text_crc32.

    ``size`` is the text's UTF-8 bytes plus 1, ``text_crc32`` its unsigned
    CRC-32; a null text counts as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
