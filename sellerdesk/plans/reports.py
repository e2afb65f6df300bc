"""The reports of the reference job as lazy Spark plans.

``Reporting`` holds the shared intermediate frames of one input set; each
report is a property so a query builds only what it needs, and frames used
twice in one plan are the same DataFrame object (Spark then reuses the
exchange instead of recomputing it).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerdesk.functions.dates import month_of, week_of
from sellerdesk.functions.nulls import (
    NO_KEY,
    matches,
    null_safe_join,
    ratio,
    salted_join,
    with_keys,
    without_keys,
)
from sellerdesk.operators import campaigns, facts, grains, measures, pricing, rollups, status
from sellerdesk.plans.inputs import Inputs, paid_lines
from sellerdesk.session import compiled_methods, drop_used_shuffles, hash_joins, stage

SHOP = ["shop_name"]
SHOP_ITEM = ["shop_name", "order_item"]

SHOP_INVOICE_COLUMNS = [
    "category",
    "cat_head",
    "bdm",
    "kam",
    "mother_company",
    "shop_name",
    "campaign_date",
    "month",
    "total_invoice",
    "processing_invoice",
    "picked_invoice",
    "delivered_and_shipped_inv",
    "refunded_invoice",
    "undelivered_invoice",
    "refund_ratio",
    "corporate_submitted",
    "corporate_approved",
    "corporate_paid",
    "corporate_due",
]

# What reports read of the invoice-first lines.
FIRST_LINE_COLUMNS = ["shop_name", "order_item", "order_status", "note", "order_date"]
QUANTITY_COLUMNS = list(status.QUANTITY_NAMES.values())
INVOICE_COLUMNS = list(status.INVOICE_NAMES.values())
SELLER_PRICE_COLUMNS = [
    "total_seller_price",
    "processing_seller_price",
    "picked_seller_price",
    "delivered_and_shipped_seller_price",
    "undelivered_seller_price",
]
VALUE_COLUMNS = [
    "total_order_value",
    "processing_value",
    "picked_value",
    "delivered_and_shipped_value",
    "undelivered_value",
    "refund_value",
]
HIERARCHY_COLUMNS = ["mother_company", "kam", "bdm", "category", "cat_head"]

ITEM_BASIC_COLUMNS = [
    *HIERARCHY_COLUMNS,
    "shop_name",
    "campaign_date",
    "month",
    "order_item",
    "unit_order_price",
    "unit_seller_price",
    "unit_mrp",
    *QUANTITY_COLUMNS,
    *SELLER_PRICE_COLUMNS,
    *VALUE_COLUMNS,
    "commission",
    "cost",
    "cost_ratio",
    "avg_deli_time",
    "count",
]

ITEM_MARGIN_COLUMNS = [
    *HIERARCHY_COLUMNS,
    "shop_name",
    "campaign_date",
    "month",
    "week",
    "order_item",
    "unit_order_price",
    "unit_seller_price",
    "unit_mrp",
    *INVOICE_COLUMNS,
    "refund_ratio",
    *QUANTITY_COLUMNS,
    "total_market_value",
    *SELLER_PRICE_COLUMNS,
    *VALUE_COLUMNS,
    "commission_rate",
    "burn_rate",
    "discount_rate",
    "commission_value",
    "discount_value",
    "burn_value",
    "nagad_discount_value",
    "cost",
    "cost_ratio",
    "avg_deli_time",
    "shop_item_deli_time",
    "count",
    "corporate_submitted",
    "corporate_approved",
    "corporate_paid",
    "corporate_due",
]


@dataclass
class Reporting:
    inp: Inputs
    week_rule: str = "yday_div7"
    # Optional case-insensitive pattern the directory's shop names must
    # match (the commented-out shop filter of the reference, F8).
    shop_pattern: str | None = None
    # Whether the invoice-first lines have several readers in the plan.
    stage_first: bool = True

    def __post_init__(self) -> None:
        hash_joins(self.spark)
        drop_used_shuffles(self.spark)
        compiled_methods(self.spark)

    @property
    def spark(self) -> SparkSession:
        return self.inp.spark

    @cached_property
    def commercial(self) -> DataFrame:
        if self.shop_pattern is None:
            return self.inp.commercial
        return self.inp.commercial.where(matches("shop_name", self.shop_pattern, ignore_case=True))

    # ---- grains ---------------------------------------------------------
    @cached_property
    def unq_sales(self) -> DataFrame:
        first = grains.first_line_per_invoice(self.inp.sales)
        if not self.stage_first:
            return first
        return with_keys(stage(first.select(*FIRST_LINE_COLUMNS), "invoice_first_lines"))

    @cached_property
    def unq_shop(self) -> DataFrame:
        return grains.campaign_dates(self.unq_sales)

    @cached_property
    def sales_with_campaign(self) -> DataFrame:
        """J1.  Where the lines lie by invoice as they are joined, they are written once with
        their place in it, and the dates are found among the first ones."""
        if self.inp.one_pass:
            lines = grains.place_in_invoice(with_keys(paid_lines(self.inp.all_sales)), "o_key")
            lines = with_keys(stage(lines, "order_lines"))
            dates = grains.campaign_dates(lines.where(F.col("place") == 1))
        else:
            lines, dates = self.inp.sales, self.unq_shop
        dates = with_keys(stage(dates, "campaign_dates"))
        return grains.sales_with_campaign(lines.drop("place"), dates)

    @cached_property
    def payments(self) -> DataFrame:
        return measures.payment_rollup(self.inp.bills)

    # ---- prices ---------------------------------------------------------
    @cached_property
    def catalog_basic(self) -> DataFrame:
        return pricing.catalog_margin_filter(self.inp.catalog)

    @cached_property
    def catalog_fallback(self) -> DataFrame:
        return pricing.catalog_fallback(self.inp.catalog, self.inp.sales_prod)

    @cached_property
    def price_table(self) -> DataFrame:
        return pricing.price_table(self.inp.sales, self.catalog_fallback, self.inp.override)

    # ---- measures -------------------------------------------------------
    # One pass over the line table per policy: bucket quantities, the
    # delivery-day sums and (basic, which keeps all lines) the first order price
    # share the shop-item aggregation.  Delivery lines are shipped or delivered,
    # never cancelled, so either policy's row filter leaves their sums unchanged.
    def line_facts(self, policy: str) -> DataFrame:
        cache = self.__dict__.setdefault("_line_facts", {})
        if policy not in cache:
            extra = measures.delivery_aggs()
            if policy == "basic":
                extra.append(grains.first_price())
            cache[policy] = status.quantity_status(self.inp.sales, SHOP_ITEM, policy, extra=extra)
        return cache[policy]

    def quantities(self, policy: str) -> DataFrame:
        return self.line_facts(policy).select(*SHOP_ITEM, *QUANTITY_COLUMNS)

    def delivery_days_for(self, policy: str) -> DataFrame:
        return measures.delivery_days_from(self.line_facts(policy), self.unq_shop)

    @cached_property
    def delivery_days(self) -> DataFrame:
        return self.delivery_days_for("basic")

    @cached_property
    def avg_delivery_time(self) -> DataFrame:
        delivered = status.delivered_invoices(self.unq_sales, SHOP_ITEM)
        return measures.avg_delivery_time(delivered, self.delivery_days)

    @cached_property
    def line_states(self) -> DataFrame:
        """The margin report's one aggregation of the lines, which four readers finish."""
        lines = grains.place_in_invoice(self.inp.order_lines, "o_key")
        return with_keys(stage(facts.line_states(lines), "shop_item_lines"))

    @cached_property
    def basic_states(self) -> DataFrame:
        """The basic reports' one aggregation of the lines, by shop-item."""
        lines = grains.place_in_invoice(self.inp.order_lines, "o_key")
        return with_keys(stage(facts.basic_states(lines), "shop_item_lines"))

    def report_prices(self, one_pass: bool) -> DataFrame:
        """The price table for the margin report, which reads it twice."""
        if not one_pass:
            return with_keys(stage(self.price_table, "price_table"))
        first = facts.first_prices(self.line_states)
        prices = pricing.price_table(None, self.catalog_fallback, self.inp.override, first_prices=first)
        return with_keys(stage(prices, "price_table"))

    @cached_property
    def rebate(self) -> DataFrame:
        return measures.capped_rebate(self.inp.sales, self.price_table)

    # ---- shop invoice report -------------------------------
    @cached_property
    def shop_invoice_status(self) -> DataFrame:
        return status.invoice_status(self.unq_sales, SHOP, "basic")

    @cached_property
    def shop_invoice_report(self) -> DataFrame:
        # unq_shop and the status table cover the same shops (both come from
        # the invoice-first rows), so one aggregation gives both.
        if self.inp.one_pass:
            j = facts.shop_invoices(self.basic_states)
        else:
            date = grains.first_order_date().alias("campaign_date")
            j = status.invoice_status(self.unq_sales, SHOP, "basic", extra=[date])
        j = null_safe_join(j, self.commercial, SHOP, "left")
        j = null_safe_join(j, self.payments, SHOP, "left")
        j = j.withColumn("month", month_of("campaign_date"))
        return without_keys(j.where(F.col("shop_name") != NO_KEY).select(*SHOP_INVOICE_COLUMNS))

    # ---- basic shop-item report ----------------------------
    @cached_property
    def item_report_basic(self) -> DataFrame:
        # Every shop of unq_shop has lines, so 'unq_shop full-join status'
        # is 'status left-join unq_shop'.
        # The rows that the catalog makes of a shop-item stay where its keys put them:
        # the join, the cost window and the join with the shops all go by shop and
        # item.  What moves is the catalog's two prices and, at shop-item grain, the
        # shops' columns, dealt by a salt first as a shop may have any number of items.
        # The campaign date turns the delivery sums into days.
        if self.inp.one_pass:
            items, unq_shop = facts.basic_facts(self.basic_states), facts.campaign_dates(self.basic_states)
        else:
            delivered = status.delivered_invoices(self.unq_sales, SHOP_ITEM)
            items = null_safe_join(self.line_facts("basic"), delivered, SHOP_ITEM, "left")
            items, unq_shop = with_keys(stage(items, "shop_item_facts")), self.unq_shop
        j = null_safe_join(items, self.catalog_basic.drop("part_key"), SHOP_ITEM, "left")
        j = measures.item_values(j, margin=False)
        j = measures.item_cost(j)
        shops = null_safe_join(unq_shop, self.commercial, SHOP, "full")
        heads = salted_join(items.select(*SHOP_ITEM), shops, "shop_name", "order_item", "left")
        j = null_safe_join(j, heads, SHOP_ITEM, "left")
        j = j.withColumns(
            {
                "month": month_of("campaign_date"),
                "cost_ratio": ratio("cost", "total_order_value"),
                "avg_deli_time": ratio(measures.delivery_time(), "delivered_and_shipped_inv"),
            }
        )
        return without_keys(j.select(*ITEM_BASIC_COLUMNS))

    # ---- margin shop-item report ---------------------------
    @cached_property
    def item_invoice_status(self) -> DataFrame:
        return status.invoice_status(self.unq_sales, SHOP_ITEM, "strict")

    @cached_property
    def item_quantity_strict(self) -> DataFrame:
        return self.quantities("strict")

    @cached_property
    def item_report_margin(self) -> DataFrame:
        return self._margin_report(self.inp.one_pass)

    @cached_property
    def line_report_margin(self) -> DataFrame:
        """The margin report over staged lines, for a row filter that is to thin the lines."""
        return self._margin_report(one_pass=False)

    def _margin_report(self, one_pass: bool) -> DataFrame:
        # Shop-item tables first (they share the shop-item partitioning, as does
        # the cost window), then the shop-grain tables.
        prices = self.report_prices(one_pass)
        if one_pass:
            rebate = measures.rebate_of(facts.rebate_lines(self.line_states), prices)
            items, unq_shop = facts.strict_facts(self.line_states), facts.campaign_dates(self.line_states)
        else:
            rebate = measures.capped_rebate(self.inp.sales, prices)
            items = null_safe_join(self.line_facts("strict"), self.item_invoice_status, SHOP_ITEM, "inner")
            unq_shop = self.unq_shop
        j = null_safe_join(items, prices, SHOP_ITEM, "inner")
        j = null_safe_join(j, rebate, SHOP_ITEM, "left")
        # The values behind the cost are made again below: the next join then moves
        # a third of the columns less.
        j = measures.item_cost(measures.item_values(j, margin=True)).select(*j.columns, "cost")
        shops = null_safe_join(unq_shop, self.payments, SHOP, "left")
        shops = null_safe_join(shops, self.commercial, SHOP, "left")
        j = salted_join(j, shops, "shop_name", "order_item", "inner")
        j = measures.item_values(j, margin=True)
        j = j.withColumns(
            {
                "month": month_of("campaign_date"),
                "week": week_of("campaign_date", self.week_rule),
                "shop_item_deli_time": measures.delivery_time(),
            }
        )
        j = measures.margin_rates(j)
        j = j.where(
            (F.col("shop_name") != NO_KEY)
            & F.col("total_quantity").isNotNull()
            & F.col("total_invoice").isNotNull()
        )
        return without_keys(j.select(*ITEM_MARGIN_COLUMNS))

    # ---- management levels ---------------------------------
    def level_report(self, level: str) -> DataFrame:
        return rollups.level_report(self.shop_invoice_report, self.item_report_basic, level)

    @cached_property
    def level_reports(self) -> DataFrame:
        return rollups.level_reports(self.shop_invoice_report, self.item_report_basic)

    # ---- campaign comparison -------------------------------
    @cached_property
    def tagged_margin(self) -> DataFrame:
        return campaigns.tag_campaigns(self.item_report_margin)

    def margin_grouping(self, name: str, row_pattern: str | None = None) -> DataFrame:
        """One of ``MARGIN_GROUPINGS``; ``row_pattern``: of the rows whose shop name it finds (F8)."""
        keys = campaigns.MARGIN_GROUPINGS[name]
        src = self.item_report_margin if row_pattern is None else self.line_report_margin
        if "campaign_name" in keys:
            src = campaigns.tag_campaigns(src)
        return campaigns.margin_report(src, keys, row_pattern)

