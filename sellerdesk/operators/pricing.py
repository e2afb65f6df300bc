"""Price sources: catalog filter, catalog fallback, price table
(SURVEY F2, F3, F7, W4, U1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerdesk.functions.nulls import matches, null_safe_join
from sellerdesk.operators.grains import e_price

SHOP_ITEM = ["shop_name", "order_item"]
FALLBACK_PRICES = ("unit_seller_price", "unit_mrp")
LEAST_KEY = -(1 << 63)

# Shops whose prices come from the override file only
# (case-sensitive patterns on normalised shop names).
OVERRIDE_SHOP_PATTERNS = ("for t10 july 30", "for t10 july 23")


def catalog_margin_filter(catalog: DataFrame) -> DataFrame:
    """positive prices and a real margin (mrp strictly above seller price)."""
    mrp, sp = F.col("unit_mrp"), F.col("unit_seller_price")
    return catalog.where((mrp > 0) & (sp > 0) & (mrp > sp))


def catalog_fallback(catalog: DataFrame, sales_prod: DataFrame) -> DataFrame:
    """One price row per shop-item; the catalog wins over order-derived
    prices, and inside a source the lowest part key wins.  Two-column key,
    so ('ab','c') and ('a','bc') stay apart (D14).

    The prices of the lowest part key of either source are aggregated by hash: neither
    source is sorted.  A missing part key goes before all others."""
    cols = [*SHOP_ITEM, *FALLBACK_PRICES, "part_key"]
    both = catalog.select(*cols, F.lit(0).alias("source_rank")).unionByName(
        sales_prod.select(*cols, F.lit(1).alias("source_rank"))
    )
    key = F.coalesce(F.col("part_key").cast("bigint"), F.lit(LEAST_KEY))
    in_catalog = F.col("source_rank") == 0
    firsts = [F.count_if(in_catalog).alias("__n")]
    for c in FALLBACK_PRICES:
        firsts.append(F.min_by(c, F.when(in_catalog, key)).alias(f"__{c}_0"))
        firsts.append(F.min_by(c, F.when(~in_catalog, key)).alias(f"__{c}_1"))
    g = both.groupBy(*SHOP_ITEM).agg(*firsts)
    won = [F.when(F.col("__n") > 0, F.col(f"__{c}_0")).otherwise(F.col(f"__{c}_1")).alias(c) for c in FALLBACK_PRICES]
    return g.select(*SHOP_ITEM, *won)


def price_table(
    sales: DataFrame | None,
    fallback: DataFrame,
    override: DataFrame,
    override_shops: tuple[str, ...] = OVERRIDE_SHOP_PATTERNS,
    first_prices: DataFrame | None = None,
) -> DataFrame:
    """Order, seller and list price per shop-item (the second script's ePrice).

    The reference joins every order line to the catalog and then keeps the
    first line per shop-item.  The catalog side is unique per shop-item, so
    keeping the first line first (W3) and joining after gives the same rows
    with a join at shop-item grain instead of line grain.  Shops covered by
    the override file are removed, the override rows appended, and F3 keeps
    positive prices with mrp >= seller price.  ``first_prices``: the order prices
    of the first lines, where they are known already.
    """
    first = null_safe_join(e_price(sales) if first_prices is None else first_prices, fallback, SHOP_ITEM, "left")
    covered = None
    for p in override_shops:
        m = matches("shop_name", p)
        covered = m if covered is None else covered | m
    if covered is not None:
        first = first.where(~covered)
    cols = [*SHOP_ITEM, "unit_order_price", "unit_seller_price", "unit_mrp"]
    prices = first.select(*cols).unionByName(override.select(*cols))
    mrp, sp, op = F.col("unit_mrp"), F.col("unit_seller_price"), F.col("unit_order_price")
    return prices.where((mrp > 0) & (sp > 0) & (op > 0) & (mrp >= sp))
