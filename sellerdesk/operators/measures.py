"""Per shop-item measures: delivery time, rebate, values, cost, rates
(SURVEY A1, A6-A9, P20-P23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sellerdesk.functions.nulls import capped, exact_parts, exact_total, line_sum, matches, money_sum, null_safe_join, ratio, salted_join
from sellerdesk.operators.status import BASIC

SHOP_ITEM = ["shop_name", "order_item"]

# The rebate scheme of the second script (a payment method,
# 10 % of the line value, at most 2000 per line).
REBATE_METHOD = "nagad"
REBATE_RATE = 0.1
REBATE_CAP = 2000.0


def payment_rollup(bills: DataFrame) -> DataFrame:
    """A1: bill amounts per shop, missing amounts skipped."""
    return bills.groupBy("shop_name").agg(
        line_sum("submitted").alias("corporate_submitted"),
        line_sum("approved").alias("corporate_approved"),
        line_sum("paid").alias("corporate_paid"),
        line_sum("due").alias("corporate_due"),
    )


def delivery_days(sales: DataFrame, unq_shop: DataFrame) -> DataFrame:
    """Sum over delivered, non-refund lines of (last update - campaign date).

    The campaign date is constant per shop, so the sum is
    ``sum(last_update) - n * campaign_date`` over lines with a last-update
    date.  The lines are pre-aggregated per shop-item first and only the
    small shop-item result meets the shop table: the line-grain table is
    never joined on the (possibly very skewed) shop key.  A missing campaign
    date makes every term missing, which sums to 0 (N1).
    """
    return delivery_days_from(sales.groupBy(*SHOP_ITEM).agg(*delivery_aggs()), unq_shop)


DELIVERY_SUMS = ("__lu_days", "__n", "__n_lines")


def delivery_aggs() -> list[Column]:
    """Conditional aggregates behind ``delivery_days``, so they can ride along
    in another per shop-item aggregation over the same lines (one pass)."""
    cond = F.coalesce(BASIC.buckets["delivered_and_shipped"](), F.lit(False))
    return [
        F.sum(F.when(cond, F.unix_date("last_update_date"))).alias("__lu_days"),
        F.count_if(cond & F.col("last_update_date").isNotNull()).alias("__n"),
        F.count_if(cond).alias("__n_lines"),
    ]


def delivery_days_from(per_item: DataFrame, unq_shop: DataFrame) -> DataFrame:
    """Finish ``delivery_days`` from per shop-item ``delivery_aggs`` columns."""
    per_item = per_item.where(F.col("__n_lines") > 0).select(*SHOP_ITEM, *DELIVERY_SUMS)
    j = salted_join(per_item, unq_shop, "shop_name", "order_item", "left")
    return j.select(*SHOP_ITEM, delivery_time().alias("shop_item_deli_time"))


def delivery_time() -> Column:
    """A6 from ``delivery_aggs`` and ``campaign_date`` of one row; missing without delivered lines."""
    days = F.col("__lu_days") - F.col("__n") * F.unix_date("campaign_date")
    none = (F.col("__n") == 0) | F.col("campaign_date").isNull()
    return F.when(F.col("__n_lines") > 0, F.when(none, F.lit(0.0)).otherwise(days.cast("double")))


def avg_delivery_time(delivered_inv: DataFrame, deli_days: DataFrame) -> DataFrame:
    """Delivery days over delivered invoices, per shop-item."""
    j = null_safe_join(delivered_inv, deli_days, SHOP_ITEM, "full")
    return j.select(
        *SHOP_ITEM,
        ratio("shop_item_deli_time", "delivered_and_shipped_inv").alias("avg_deli_time"),
    )


def capped_rebate(
    sales: DataFrame,
    prices: DataFrame,
    method: str = REBATE_METHOD,
    rate: float = REBATE_RATE,
    cap: float = REBATE_CAP,
) -> DataFrame:
    """Per shop-item sum of min(qty * price * rate, cap) over lines paid by
    ``method`` (any order status, D9), priced from the price table.

    The cap applies per line, so lines cannot be summed before pricing; but
    lines of one shop-item with the same quantity have the same rebate.  They
    are counted per (shop, item, quantity) first, with map-side partial
    aggregation, and only that small table meets the price table: the join
    never sees line grain, and a hot shop costs one row per quantity value.
    The exact sum makes ``n * rebate`` the sum of n rebates.
    """
    lines = sales.where(matches("payment_method", method, ignore_case=True))
    per_qty = lines.groupBy(*SHOP_ITEM, "order_quantity").agg(F.count(F.lit(1)).alias("__n"))
    return rebate_of(per_qty, prices, rate, cap)


def rebate_of(per_qty: DataFrame, prices: DataFrame, rate: float = REBATE_RATE, cap: float = REBATE_CAP) -> DataFrame:
    """Finish ``capped_rebate`` from the number ``__n`` of lines per shop-item and quantity."""
    j = null_safe_join(per_qty, prices.select(*SHOP_ITEM, "unit_order_price"), SHOP_ITEM, "inner")
    value = F.col("order_quantity") * F.col("unit_order_price") * F.lit(rate)
    return j.groupBy(*SHOP_ITEM).agg(
        money_sum(capped(value, cap), times="__n").alias("nagad_discount_value")
    )


def _q(name: str) -> Column:
    return F.col(name)


def item_values(df: DataFrame, margin: bool = False) -> DataFrame:
    """Seller-price and order-value columns of the item reports."""
    sp, op, mrp = _q("unit_seller_price"), _q("unit_order_price"), _q("unit_mrp")
    tq = _q("total_quantity")
    cols = {
        "total_seller_price": tq * sp,
        "processing_seller_price": _q("processing_quantity") * sp,
        "picked_seller_price": _q("picked_quantity") * sp,
        "delivered_and_shipped_seller_price": _q("delivered_and_shipped_quantity") * sp,
        "undelivered_seller_price": _q("undelivered_quantity") * sp,
        "total_order_value": tq * op,
        "processing_value": _q("processing_quantity") * op,
        "picked_value": _q("picked_quantity") * op,
        "delivered_and_shipped_value": _q("delivered_and_shipped_quantity") * op,
        "undelivered_value": _q("undelivered_quantity") * op,
        "refund_value": _q("refunded_quantity") * sp,
    }
    if margin:
        cols |= {
            "total_market_value": tq * mrp,
            "commission_value": (mrp - sp) * tq,
            "discount_value": (mrp - op) * tq,
            "burn_value": (sp - op) * tq,
        }
    else:
        cols["commission"] = ratio(mrp - sp, mrp)
    cols["count"] = F.lit(1.0)
    return df.withColumns(cols)


def item_cost(df: DataFrame, name: str = "cost") -> DataFrame:
    """A9 + J17: per shop-item sum of delivered seller price, undelivered seller
    price and refund value over all report rows of the shop-item (copies from
    a non-unique catalog included, D8), written back onto each row.

    A window over the shop-item keys instead of an aggregation and a join.
    """
    w = Window.partitionBy(*SHOP_ITEM)

    def part(c: str) -> Column:
        coarse, fine = exact_parts(c)
        return exact_total(F.sum(coarse).over(w), F.sum(fine).over(w))

    total = (
        part("delivered_and_shipped_seller_price")
        + part("undelivered_seller_price")
        + part("refund_value")
    )
    return df.withColumn(name, total)


def margin_rates(df: DataFrame) -> DataFrame:
    """Row-level rates of the margin report; a missing rebate
    gives missing burn and discount rates (N7, D10)."""
    tmv, tsp, tov = _q("total_market_value"), _q("total_seller_price"), _q("total_order_value")
    net = tov - _q("nagad_discount_value")
    return df.withColumns(
        {
            "commission_rate": ratio(tmv - tsp, tmv),
            "burn_rate": ratio(tsp - net, tmv),
            "discount_rate": ratio(tmv - net, tmv),
            "cost_ratio": ratio(_q("cost"), tov),
            "avg_deli_time": ratio(_q("shop_item_deli_time"), _q("delivered_and_shipped_inv")),
        }
    )
