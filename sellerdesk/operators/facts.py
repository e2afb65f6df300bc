"""What the item reports read of the order lines, in one aggregation by shop-item.

``line_states`` holds partial results per shop-item, and for the margin report of lines that
may earn a rebate per quantity too, as the cap of the rebate applies per line: numbers only,
so that the lines are aggregated by hash, with map-side partial aggregation, and sorted for
no key.  The rest here finishes them: the quantities of either policy (A3), invoice counts
(A2, A4, A5), the delivery sums (A6), the first order price (W3), the campaign date (W2) and
the number of lines per rebate quantity (A8).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerdesk.functions.nulls import matches, ratio
from sellerdesk.operators.measures import DELIVERY_SUMS, REBATE_METHOD, delivery_aggs
from sellerdesk.operators.status import BASIC, BUCKETS, INVOICE_NAMES, QUANTITY_NAMES, STRICT, Policy

SHOP_ITEM = ["shop_name", "order_item"]
COUNTS = ["__kept", "__invoices", *[f"__{x}_{b}" for b in BUCKETS for x in ("lines", "invoices")]]
SUMS = ["__quantity", *[f"__quantity_{b}" for b in BUCKETS]]
LEAST_DAY, PLACES = -(1 << 31), 10**9


def file_place(place: Column | str = "place") -> Column:
    """A line's place in file order as one number: date (missing first), order, place in it."""
    day = F.coalesce(F.unix_date("order_date"), F.lit(LEAST_DAY)).cast("decimal(10,0)")
    order = F.coalesce(F.col("o_key"), F.lit(-(1 << 63)))
    place = F.col(place) if isinstance(place, str) else place
    # Order and place make a long together, but for keys of ten digits and more.
    small = F.when(order.between(-(10**9) * 9, 10**9 * 9), order * F.lit(PLACES) + place)
    large = order.cast("decimal(19,0)") * F.lit(str(PLACES)).cast("decimal(10,0)") + place.cast("decimal(10,0)")
    low = F.when(small.isNotNull(), small.cast("decimal(19,0)")).otherwise(large)
    return (day * F.lit(str(PLACES << 64)).cast("decimal(29,0)") + low).cast("decimal(38,0)")


def _bucket_aggs(policy: Policy, first: Column) -> list[Column]:
    """Quantities, lines and invoices of the buckets, over the lines that the policy keeps."""
    kept = F.lit(True) if policy.keep is None else F.coalesce(policy.keep(), F.lit(False))
    aggs = [F.sum(F.when(kept, F.col("order_quantity"))).alias("__quantity")]
    for b in BUCKETS:
        hit = kept & F.coalesce(policy.buckets[b](), F.lit(False))
        aggs.append(F.count_if(hit).alias(f"__lines_{b}"))
        aggs.append(F.count_if(hit & first).alias(f"__invoices_{b}"))
        aggs.append(F.sum(F.when(hit, F.col("order_quantity"))).alias(f"__quantity_{b}"))
    if policy.keep is not None:
        aggs += [F.count_if(kept).alias("__kept"), F.count_if(kept & first).alias("__invoices")]
    return aggs


def _first_aggs(first: Column) -> list[Column]:
    """The first line's price, and number and dates of the invoice-first lines."""
    return [
        F.min_by("unit_order_price", "__at").alias("unit_order_price"),
        F.count_if(first).alias("__firsts"),
        F.count_if(first & F.col("order_date").isNull()).alias("__undated"),
        F.min(F.when(first, F.col("order_date"))).alias("__date"),
    ]


def basic_states(lines: DataFrame) -> DataFrame:
    """``line_states`` for the basic reports, which keep all lines and know no rebate: a row
    per shop-item."""
    first = F.col("place") == 1
    rows = lines.withColumn("__at", file_place())
    return rows.groupBy(*SHOP_ITEM).agg(*_bucket_aggs(BASIC, first), *delivery_aggs(), *_first_aggs(first))


def line_states(lines: DataFrame, method: str = REBATE_METHOD) -> DataFrame:
    """Partial results of ``lines``, which have their ``place`` in the order."""
    first = F.col("place") == 1
    aggs = [F.count(F.lit(1)).alias("__all"), *_bucket_aggs(STRICT, first), *delivery_aggs()]
    aggs += [F.min("__at").alias("__first"), *_first_aggs(first)]
    rebated = matches("payment_method", method, ignore_case=True)
    rows = lines.withColumns({"__at": file_place(), "__rebated": rebated})
    quantity = F.when(F.col("__rebated"), F.col("order_quantity")).alias("rebate_quantity")
    return rows.groupBy(*SHOP_ITEM, "__rebated", quantity).agg(*aggs)


def strict_facts(states: DataFrame) -> DataFrame:
    """Strict quantities, invoice counts and delivery sums of the shop-items that have both
    a line and an invoice-first line that count."""
    sums = [F.sum(c).alias(c) for c in (*COUNTS, *SUMS, *DELIVERY_SUMS)]
    g = states.groupBy(*SHOP_ITEM).agg(*sums).where((F.col("__kept") > 0) & (F.col("__invoices") > 0))
    cols = [*_quantities(), F.col("__invoices").cast("double").alias(INVOICE_NAMES["total"])]
    out = g.select(*SHOP_ITEM, *DELIVERY_SUMS, *cols, *_invoices(*BUCKETS))
    return out.withColumn("refund_ratio", ratio("refunded_invoice", "total_invoice"))


def _quantities() -> list[Column]:
    cols = [F.coalesce("__quantity", F.lit(0.0)).alias(QUANTITY_NAMES["total"])]
    for b in BUCKETS:
        some = F.coalesce(f"__quantity_{b}", F.lit(0.0))
        cols.append(F.when(F.col(f"__lines_{b}") > 0, some).alias(QUANTITY_NAMES[b]))
    return cols


def _invoices(*buckets: str) -> list[Column]:
    counts = {INVOICE_NAMES[b]: F.col(f"__invoices_{b}") for b in buckets}
    return [F.when(n > 0, n.cast("double")).alias(name) for name, n in counts.items()]


def basic_facts(states: DataFrame) -> DataFrame:
    """Of ``basic_states``: quantities, delivery sums, first price and delivered invoices."""
    delivered = _invoices("delivered_and_shipped")
    return states.select(*SHOP_ITEM, *_quantities(), *DELIVERY_SUMS, "unit_order_price", *delivered)


def shop_invoices(states: DataFrame) -> DataFrame:
    """Of ``basic_states``: invoice counts (A2) and campaign date of each shop with invoices."""
    sums = [F.sum(f"__invoices_{b}").alias(f"__invoices_{b}") for b in BUCKETS]
    total = F.sum("__firsts").cast("double").alias(INVOICE_NAMES["total"])
    g = states.where(F.col("__firsts") > 0).groupBy("shop_name").agg(total, *sums, _campaign_date())
    g = g.select("shop_name", INVOICE_NAMES["total"], *_invoices(*BUCKETS), "campaign_date")
    return g.withColumn("refund_ratio", ratio("refunded_invoice", "total_invoice"))


def first_prices(states: DataFrame) -> DataFrame:
    """Order price of the first line of each shop-item."""
    return states.groupBy(*SHOP_ITEM).agg(F.min_by("unit_order_price", "__first").alias("unit_order_price"))


def campaign_dates(states: DataFrame) -> DataFrame:
    """Each shop's campaign date, missing if that of any invoice-first line is."""
    return states.where(F.col("__firsts") > 0).groupBy("shop_name").agg(_campaign_date())


def _campaign_date() -> Column:
    return F.when(F.sum("__undated") == 0, F.min("__date")).alias("campaign_date")


def rebate_lines(states: DataFrame) -> DataFrame:
    """Number of lines per shop-item and quantity that may earn a rebate."""
    rows = states.where(F.col("__rebated"))
    return rows.select(*SHOP_ITEM, F.col("rebate_quantity").alias("order_quantity"), F.col("__all").alias("__n"))
