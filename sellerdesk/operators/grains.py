"""First-row grains and the campaign-date join.

"First" in the reference is file order.  Here it is an explicit ordering
key, and the pick is ``row_number() = 1`` over a key partition.  Spark plans
that as a map-side ``WindowGroupLimit`` before the shuffle, so a hot key
sends at most one row per map task across the network; ``dropDuplicates``
is not used because it keeps an arbitrary row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sellerdesk.functions.nulls import salted_join
from sellerdesk.sources.fixtures import ORDER_KEY

BROADCAST_MB = 32  # of shops, whose campaign dates are sent to every executor
ROW_BYTES = 48  # of a shop's row in a hash table, beside its name


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per ``keys``: the first by ``order`` (ties must not occur)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def first_line_per_invoice(sales: DataFrame) -> DataFrame:
    """The first paid line of each invoice, with ``count = 1``."""
    return keep_first(sales, ["invoice"], ORDER_KEY).withColumn("count", F.lit(1.0))


def place_in_invoice(sales: DataFrame, by: str = "invoice") -> DataFrame:
    """W1 as a column: each line's ``place`` in its invoice; the first line has 1.

    ``by`` may name another column that is one to one with the invoice."""
    w = Window.partitionBy(by).orderBy(*ORDER_KEY)
    return sales.withColumn("place", F.row_number().over(w))


def campaign_dates(unq_sales: DataFrame) -> DataFrame:
    """Each shop's campaign date = order date of its first invoice-first line.

    Taken over the W1 rows, not over all lines, so a shop whose lines all
    sit behind other shops' first lines has no campaign date (D23).  An
    aggregation: nothing is sorted.
    """
    return unq_sales.groupBy("shop_name").agg(first_order_date().alias("campaign_date"))


def first_order_date() -> Column:
    """Aggregate: the order date of the first row.  File order begins with the order date
    (missing dates first), so it is the least date, or missing if any is."""
    return F.when(F.count_if(F.col("order_date").isNull()) == 0, F.min("order_date"))


def sales_with_campaign(sales: DataFrame, unq_shop: DataFrame) -> DataFrame:
    """Order lines with their shop's campaign date (outer merge = left join).

    The lines stay where they are if the shops' dates fit into each task's memory: their
    size is counted, as Spark's guess knows neither the names nor a row's overhead.  Else the
    shops' rows are dealt by a salt, and Spark may not broadcast those copies, which
    it takes to be as small as the shops.
    """
    size = F.sum(F.octet_length("shop_name") + F.lit(ROW_BYTES)).alias("size")
    if (unq_shop.agg(size).first().size or 0) <= BROADCAST_MB << 20:
        return sales.join(unq_shop.hint("broadcast"), ["shop_name"], "left")
    return salted_join(sales.hint("shuffle_merge"), unq_shop, "shop_name", "invoice", "left")


def first_price() -> Column:
    """Aggregate: W3, the order price of the first line, inside an aggregation by shop-item."""
    return F.min_by("unit_order_price", F.struct(*ORDER_KEY)).alias("unit_order_price")


def e_price(sales: DataFrame) -> DataFrame:
    """Order price of the first line of each shop-item."""
    return keep_first(sales, ["shop_name", "order_item"], ORDER_KEY).select(
        "shop_name", "order_item", "unit_order_price"
    )
