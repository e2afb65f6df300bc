"""Mixing sources to target weights by capped water-filling.

Every source has a weight and may be repeated at most ``max_epochs`` times.
Water-filling: sources get the budget in proportion to their weights; those
above their cap are clamped there and the excess is shared again by weight
until none is above.  With sources sorted by cap over weight the clamped ones
are a prefix, so running sums over the table of sources (one row per source)
give the final level without a loop.

Sampling: a source with target t and size s takes every document floor(t / s)
times, and one time more the documents whose seeded draw lies under the
source's cut.  The cut is found in two steps, from the sizes of draw buckets
(a few thousand documents each) and inside the one bucket in which the rest
ends, so no task owns a whole source.  The taken words of a source differ from
its target by at most half a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sellerdesk.llm.common import DRAW_RANGE, draw, n_words, row_of
from sellerdesk.session import stage

BUCKET_ROWS = 4096
SEED = 6


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Targets for ``sources(source, source_size, weight)``, one row per source.

    The budget is the sum of all sizes.  Adds ``target`` (double).
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * F.lit(max_epochs)
    order = [F.asc("_ratio"), F.asc_nulls_last("source")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    ) / F.sum("weight").over(onward)
    return (
        sources.withColumn("_cap", cap)
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_level", level)
        .withColumn("_clamped", F.col("_cap") <= F.col("weight") * F.col("_level"))
        .withColumn(
            "_final", F.max(F.when(~F.col("_clamped"), F.col("_level"))).over(everything)
        )
        .withColumn(
            "target",
            F.when(F.col("_clamped"), F.col("_cap").cast("double")).otherwise(
                F.col("weight") * F.col("_final")
            ),
        )
        .drop("_cap", "_ratio", "_level", "_clamped", "_final")
    )


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights repeating over the sources in code-point order, null last."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    pick = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    return sources.withColumn("weight", pick)


def narrow(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size (words) and the seeded draw of every document."""
    return docs.select(
        "doc_id",
        "source",
        n_words(F.col("text")).alias("size"),
        draw(seed, F.col("doc_id"), F.col("text")).alias("draw"),
    )


def mixing_plan(rows: DataFrame, max_epochs: int = 3) -> DataFrame:
    """One row per source: source, source_size, target, whole, cut.

    ``rows`` are those of :func:`narrow`, read several times (stage them).  A
    document is taken ``whole`` times, and once more if its draw is at most
    ``cut``.
    """
    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("_n")
    )
    plan = water_fill(cyclic_weights(sizes), max_epochs)
    rate = F.col("target") / F.col("source_size")
    plan = (
        plan.withColumn(
            "whole", F.when(F.col("source_size") > 0, F.floor(rate)).otherwise(F.lit(0))
        )
        .withColumn("_rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("_buckets", F.ceil(F.col("_n") / F.lit(BUCKET_ROWS)))
    )
    plan = stage(plan, "mix-sources")

    slim = plan.select(
        F.col("source").alias("_s"), "_rest", "_buckets"
    )
    placed = rows.join(slim, F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "_b", F.floor(F.col("draw") / F.lit(DRAW_RANGE) * F.col("_buckets"))
    )
    by_bucket = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        placed.groupBy("_s", "_b")
        .agg(F.sum("size").alias("_size"), F.first("_rest").alias("_rest"))
        .withColumn("_until", F.sum("_size").over(by_bucket))
        .withColumn("_before", F.col("_until") - F.col("_size"))
    )
    # the bucket in which the rest ends; earlier ones are taken whole
    last = ends.where(
        (F.col("_rest") > 0) & (F.col("_before") <= F.col("_rest")) & (F.col("_until") > F.col("_rest"))
    ).select(F.col("_s").alias("_ls"), F.col("_b").alias("_lb"), "_before")
    inside = (
        Window.partitionBy("_s")
        .orderBy("draw", F.asc_nulls_last("doc_id"), "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    cuts = (
        placed.join(last, F.col("_s").eqNullSafe(F.col("_ls")) & (F.col("_b") == F.col("_lb")))
        .withColumn("_middle", F.col("_before") + F.sum("size").over(inside) - F.col("size") / 2)
        .groupBy("_s")
        .agg(
            F.max(F.when(F.col("_middle") <= F.col("_rest"), F.col("draw"))).alias("_cut"),
            # none inside: everything before the bucket, that is under its first draw
            (F.min("draw") - 1).alias("_under"),
        )
        .select(F.col("_s").alias("_cs"), F.coalesce("_cut", "_under").alias("_c"))
    )
    found = plan.join(cuts, F.col("source").eqNullSafe(F.col("_cs")), "left").select(
        "source",
        "source_size",
        "target",
        F.col("whole").cast("long").alias("whole"),
        F.coalesce(F.col("_c"), F.lit(-1)).alias("cut"),
    )
    # written: its size is then known, so documents meet it by a broadcast if it is
    # small, else by a join whose hot sources AQE can split
    return stage(found, "mix-plan")


def take_counts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with source and draw) plus source_size, target and ``times``."""
    right = plan.select(
        F.col("source").alias("_s"), "source_size", "target", "whole", "cut"
    )
    times = F.col("whole") + (F.col("draw") <= F.col("cut")).cast("long")
    return (
        rows.join(right, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("times", times)
        .drop("_s", "whole", "cut")
    )


def mix(docs: DataFrame, max_epochs: int = 3, seed: int = SEED) -> DataFrame:
    """The mix's size, source_size, target and taken words per document.

    Null texts have no words; a null source is a source of its own, last in
    order; a null doc_id draws from its text.  Repeated rows (same id and text)
    share one draw and are taken alike.  An empty table gives no rows; sources
    without words have target 0.  Other columns are not read.
    """
    rows = stage(narrow(docs, seed), "mix-rows")
    taken = take_counts(rows, mixing_plan(rows, max_epochs))
    return taken.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("times")).alias("taken"),
        "times",
    )


def mixed_documents(docs: DataFrame, max_epochs: int = 3, seed: int = SEED) -> DataFrame:
    """``docs`` with every document repeated as often as the mix takes it."""
    rows = stage(narrow(docs, seed), "mix-rows")
    plan = mixing_plan(rows, max_epochs)
    keyed = docs.select(  # the row apart, as its columns may have any names
        row_of(docs).alias("row"),
        "source",
        draw(seed, F.col("doc_id"), F.col("text")).alias("draw"),
    )
    taken = take_counts(keyed, plan).where(F.col("times") > 0)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return taken.withColumn("copy", copies).select("row.*")
