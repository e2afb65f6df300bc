"""Cleaned, typed inputs of the reporting pipeline.

Every source is normalised at ingest: shop and item names become join keys
(squished, lower case; order items cut at the first line break), numbers
are parsed with ``try_cast`` and bill amounts lose their thousands commas.
Normalising *before* any grouping fixes reference defects D1 and D15, and
the price override file is keyed the same way as every other source.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerdesk.functions.dates import month_of
from sellerdesk.functions.nulls import with_keys
from sellerdesk.functions.text import item_key, normalize_key, parse_amount, parse_number
from sellerdesk.session import stage
from sellerdesk.sources.fixtures import ORDER_KEY, RawInputs

SALES_COLUMNS = (
    "invoice",
    "order_date",
    "shop_name",
    "order_status",
    "order_item",
    "order_quantity",
    "unit_order_price",
    "payment_method",
    "note",
    "last_update_date",
    "payment_status",
    "month",
)


def clean_sales(raw: DataFrame) -> DataFrame:
    """Order lines, typed and keyed, all payment statuses."""
    return raw.select(
        "invoice",
        "order_date",
        normalize_key("shop_name").alias("shop_name"),
        "order_status",
        item_key("order_item").alias("order_item"),
        parse_number("order_quantity").alias("order_quantity"),
        F.col("unit_order_price").cast("double").alias("unit_order_price"),
        "payment_method",
        "note",
        "last_update_date",
        "payment_status",
        month_of("order_date").alias("month"),
        *[c for c in ORDER_KEY if c != "order_date"],
    )


def paid_lines(sales: DataFrame) -> DataFrame:
    """keep lines whose payment status is exactly 'paid'."""
    return sales.where(F.col("payment_status") == "paid")


def clean_commercial(raw: DataFrame) -> DataFrame:
    return raw.select(
        normalize_key("shop_name").alias("shop_name"),
        "mother_company",
        "kam",
        "bdm",
        "cat_head",
        "category",
    )


def clean_catalog(raw: DataFrame) -> DataFrame:
    """Catalog rows keyed like the order lines (squish + lower)."""
    return raw.select(
        normalize_key("shop_name").alias("shop_name"),
        normalize_key("order_item").alias("order_item"),
        "brand",
        "part_key",
        F.col("unit_seller_price").cast("double").alias("unit_seller_price"),
        F.col("unit_mrp").cast("double").alias("unit_mrp"),
    )


def clean_sales_prod(raw: DataFrame) -> DataFrame:
    """Prices taken from order exports that carry product columns."""
    return raw.select(
        normalize_key("shop_name").alias("shop_name"),
        item_key("order_item").alias("order_item"),
        "part_key",
        parse_number(F.col("unit_mrp").cast("string")).alias("unit_mrp"),
        parse_number(F.col("unit_seller_price").cast("string")).alias("unit_seller_price"),
    )


def clean_override(raw: DataFrame) -> DataFrame:
    return raw.select(
        normalize_key("shop_name").alias("shop_name"),
        normalize_key("order_item").alias("order_item"),
        F.col("unit_order_price").cast("double").alias("unit_order_price"),
        F.col("unit_seller_price").cast("double").alias("unit_seller_price"),
        F.col("unit_mrp").cast("double").alias("unit_mrp"),
    )


def clean_bills(raw: DataFrame) -> DataFrame:
    """Bill tracker rows: a bill without a submitted amount is skipped."""
    return raw.where(F.col("submitted").isNotNull()).select(
        F.col("serial").cast("string").alias("serial"),
        normalize_key("shop_name").alias("shop_name"),
        parse_amount("submitted").alias("submitted"),
        parse_amount("approved").alias("approved"),
        parse_amount("paid").alias("paid"),
        parse_amount("due").alias("due"),
    )


@dataclass
class Inputs:
    """Cleaned inputs; DataFrames built once per object.

    Shop and item keys are never null here (``with_keys``); reports turn
    ``NO_KEY`` back into missing at their end.

    With ``staged`` (the default) the cleaned paid order lines, the one
    line-grain table that item reports read several times, are written once to
    the shared folder (``sellerdesk.session.stage``) instead of being
    re-derived in each branch of a plan.  Plans that read the lines once are
    built without.
    """

    raw: RawInputs
    staged: bool = True

    @property
    def spark(self) -> SparkSession:
        return self.raw.spark

    @cached_property
    def all_sales(self) -> DataFrame:
        return clean_sales(self.raw.sales)

    @cached_property
    def sales(self) -> DataFrame:
        lines = paid_lines(self.all_sales)
        if self.staged:
            lines = stage(lines.drop("payment_status", "month"), "paid_lines")
        return with_keys(lines)

    @cached_property
    def order_lines(self) -> DataFrame:
        """The paid lines, not staged, for a plan that reads them once."""
        return with_keys(paid_lines(self.all_sales).drop("payment_status", "month"))

    @property
    def one_pass(self) -> bool:
        """Whether the margin report reads the lines once: where an invoice is an order, they
        lie by invoice as the orders are joined, and what is staged is their aggregation."""
        return self.staged and getattr(self.raw, "invoice_is_order", False)

    @cached_property
    def commercial(self) -> DataFrame:
        return with_keys(clean_commercial(self.raw.commercial))

    @cached_property
    def catalog(self) -> DataFrame:
        return with_keys(clean_catalog(self.raw.product))

    @cached_property
    def sales_prod(self) -> DataFrame:
        return with_keys(clean_sales_prod(self.raw.sales_prod))

    @cached_property
    def override(self) -> DataFrame:
        return with_keys(clean_override(self.raw.override))

    @cached_property
    def bills(self) -> DataFrame:
        return with_keys(clean_bills(self.raw.bills))


def inputs(spark: SparkSession, sf_dir: str, staged: bool = True) -> Inputs:
    return Inputs(RawInputs(spark, sf_dir, staged), staged)
