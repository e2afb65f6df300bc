"""Campaign tags and grouped margin reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerdesk.functions.nulls import matches, money_sum, null_safe_join, ratio

# Campaign name, the pattern a normalised shop name must
# contain, and the pattern it must not contain (case-sensitive).
# 'for t10 july 2' also matches the 20s except 23 (kept as is, D18).
CAMPAIGN_RULES: tuple[tuple[str, str, str | None], ...] = (
    ("T10 July 2", "for t10 july 2", "for t10 july 23"),
    ("T10 July 9", "for t10 july 9 2021", None),
    ("T10 July 16", "for t10 july 16", None),
    ("T10 July 23", "for t10 july 23", None),
    ("T10 July 30", "for t10 july 30", None),
)

# Groupings of the margin report; the campaign ones need tags.
MARGIN_GROUPINGS: dict[str, list[str]] = {
    "campaign_report": ["campaign_name"],
    "margin_by_mc": ["category", "bdm", "kam", "mother_company"],
    "margin_by_mc_month": ["category", "bdm", "kam", "mother_company", "month"],
    "margin_by_mc_week": ["category", "bdm", "kam", "mother_company", "week"],
    "margin_by_mc_campaign": ["category", "bdm", "kam", "mother_company", "campaign_name"],
    "margin_by_kam_month": ["category", "bdm", "kam", "month"],
    "margin_by_bdm_month": ["category", "bdm", "month"],
    "margin_by_category": ["category"],
    "margin_by_category_month": ["category", "month"],
    "margin_by_category_week": ["category", "week"],
    "margin_by_month": ["month"],
    "margin_overall": [],
}

MARGIN_SUMS = {
    "total_invoice": "total_invoice",
    "processing_invoice": "processing_invoice",
    "picked_invoice": "picked_invoice",
    "delivered_and_shipped_invoice": "delivered_and_shipped_inv",
    "refunded_invoice": "refunded_invoice",
    "submitted": "corporate_submitted",
    "approved": "corporate_approved",
    "paid": "corporate_paid",
    "due": "corporate_due",
    "revenue": "total_order_value",
    "cost": "cost",
    "delivered_and_shipped_value": "delivered_and_shipped_value",
    "undelivered_value": "undelivered_value",
    "delivered_and_shipped_seller_price": "delivered_and_shipped_seller_price",
    "undelivered_seller_price": "undelivered_seller_price",
    "shop_item_deli_time": "shop_item_deli_time",
    "total_market_value": "total_market_value",
    "total_seller_price": "total_seller_price",
    "nagad_discount_value": "nagad_discount_value",
}
PAYMENT_SUMS = ("submitted", "approved", "paid", "due")

MARGIN_REPORT_COLUMNS = [
    "total_invoice",
    "processing_invoice",
    "picked_invoice",
    "delivered_and_shipped_invoice",
    "refunded_invoice",
    "revenue",
    "delivered_and_shipped_value",
    "undelivered_value",
    "cost",
    "delivered_and_shipped_seller_price",
    "undelivered_seller_price",
    "total_market_value",
    "total_seller_price",
    "nagad_discount_value",
    "avg_commission_rate",
    "avg_burn_rate",
    "avg_discount_rate",
    "credit_performance",
    "avg_refund_ratio",
    "avg_deli_time",
    "avg_cost_ratio",
    "submitted",
    "approved",
    "paid",
    "due",
]


def campaign_tag_column(
    shop: Column | str = "shop_name", rules: Sequence[tuple[str, str, str | None]] = CAMPAIGN_RULES
) -> Column:
    """Array of the campaign names whose rule the shop name satisfies."""
    tags = []
    for name, include, exclude in rules:
        cond = matches(shop, include)
        if exclude is not None:
            cond = cond & ~matches(shop, exclude)
        tags.append(F.when(cond, F.lit(name)))
    return F.filter(F.array(*tags), lambda t: t.isNotNull())


def tag_campaigns(df: DataFrame, rules=CAMPAIGN_RULES) -> DataFrame:
    """One row per (row, matching campaign); rows matching none are dropped.

    The reference builds one filtered copy per campaign and merges them with
    full outer joins on every column; copies differ in the tag, so nothing
    ever matches and the merge is a union.  Here: one scan and an explode.
    """
    return df.withColumn("campaign_name", F.explode(campaign_tag_column("shop_name", rules)))


def _margin_ratios(df: DataFrame) -> DataFrame:
    tmv, tsp = F.col("total_market_value"), F.col("total_seller_price")
    net = F.col("revenue") - F.col("nagad_discount_value")
    return df.withColumns(
        {
            "credit_performance": ratio("delivered_and_shipped_seller_price", "paid"),
            "avg_refund_ratio": ratio("refunded_invoice", "total_invoice"),
            "avg_deli_time": ratio("shop_item_deli_time", "delivered_and_shipped_invoice"),
            "avg_cost_ratio": ratio("cost", "revenue"),
            "avg_commission_rate": ratio(tmv - tsp, tmv),
            "avg_burn_rate": ratio(tsp - net, tmv),
            "avg_discount_rate": ratio(tmv - net, tmv),
        }
    )


def margin_report(
    item_report: DataFrame, keys: Sequence[str], row_pattern: str | None = None
) -> DataFrame:
    """19 sums and 7 ratios of sums per grouping.

    ``row_pattern`` (F8) keeps the rows whose shop name it finds, case-sensitive;
    a missing name is not found.  The report's joins and aggregations below carry
    the shop, so the filter reaches the scans of the order lines and of the prices.

    Shop payments repeat on every item row of a shop and are summed as such
    (D5, kept; see ``margin_report_shop_grain``)."""
    if row_pattern is not None:
        item_report = item_report.where(matches("shop_name", row_pattern))
    aggs = [money_sum(c).alias(n) for n, c in MARGIN_SUMS.items()]
    out = item_report.groupBy(*keys).agg(*aggs)
    return _margin_ratios(out).select(*keys, *MARGIN_REPORT_COLUMNS)


def margin_report_shop_grain(item_report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``margin_report`` but each shop's payments count once per group."""
    # A constant key stands in for "no grouping", so the two halves always
    # meet in an equi-join.
    g = [*keys, "__all"]
    df = item_report.withColumn("__all", F.lit(0))
    item_sums = {n: c for n, c in MARGIN_SUMS.items() if n not in PAYMENT_SUMS}
    body = df.groupBy(*g).agg(*[money_sum(c).alias(n) for n, c in item_sums.items()])
    per_shop = df.groupBy(*g, "shop_name").agg(
        *[F.max(MARGIN_SUMS[n]).alias(n) for n in PAYMENT_SUMS]
    )
    pays = per_shop.groupBy(*g).agg(*[money_sum(n).alias(n) for n in PAYMENT_SUMS])
    out = null_safe_join(body, pays, g, "left")
    return _margin_ratios(out).select(*keys, *MARGIN_REPORT_COLUMNS)


def group_total(item_report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with its group's total order value.  The small group
    table joins back (AQE broadcasts it when small; skew-split otherwise)."""
    totals = item_report.groupBy(*keys).agg(money_sum("total_order_value").alias("total_value"))
    return null_safe_join(item_report, totals, list(keys), "left")
