"""Status buckets: invoice counts and quantities per key.

The reference computes six filtered aggregates and merges them with five
full outer joins.  Here a bucket policy is data (name -> predicate), and one
``groupBy`` with conditional aggregates does all buckets in one pass: one
exchange instead of six, with map-side partial aggregation so a hot shop
costs one row per map task in the shuffle.  ``bucket_sum`` / ``bucket_count``
keep the outer-join null semantics (N6).

Policies (decision D11):

* ``basic`` (first script): every line counts in the total, cancelled
  included; 'refunded' is a refund note on any status.
* ``strict`` (second script): cancelled lines are out of every bucket;
  'refunded' needs a refund note and a shipped or delivered status.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerdesk.functions.nulls import bucket_count, bucket_sum, matches, na_sum, ratio

# Order statuses, the refund note pattern and the payment
# method that earns a rebate, as spelled in the source systems.
PROCESSING = "processing"
PICKED = "picked"
SHIPPED = "shipped"
DELIVERED = "delivered"
CANCEL = "cancel"
REFUND_PATTERN = "refund"

BUCKETS = ("processing", "picked", "delivered_and_shipped", "refunded", "undelivered")


def refund_flag(note: Column | str = "note") -> Column:
    """Note mentions a refund, case-insensitive; a missing note is False."""
    return matches(note, REFUND_PATTERN, ignore_case=True)


def _status(*values: str) -> Column:
    return F.col("order_status").isin(*values)


@dataclass(frozen=True)
class Policy:
    name: str
    # Row filter applied before all buckets (None = keep every row).
    keep: Callable[[], Column] | None
    buckets: dict[str, Callable[[], Column]]


def _common() -> dict[str, Callable[[], Column]]:
    return {
        "processing": lambda: _status(PROCESSING),
        "picked": lambda: _status(PICKED),
        "delivered_and_shipped": lambda: ~refund_flag() & _status(SHIPPED, DELIVERED),
        "undelivered": lambda: _status(PICKED, PROCESSING),
    }


BASIC = Policy("basic", None, {**_common(), "refunded": lambda: refund_flag()})
STRICT = Policy(
    "strict",
    lambda: F.col("order_status") != CANCEL,
    {**_common(), "refunded": lambda: refund_flag() & _status(SHIPPED, DELIVERED)},
)
POLICIES = {p.name: p for p in (BASIC, STRICT)}

INVOICE_NAMES = {
    "total": "total_invoice",
    "processing": "processing_invoice",
    "picked": "picked_invoice",
    "delivered_and_shipped": "delivered_and_shipped_inv",
    "refunded": "refunded_invoice",
    "undelivered": "undelivered_invoice",
}
QUANTITY_NAMES = {
    "total": "total_quantity",
    "processing": "processing_quantity",
    "picked": "picked_quantity",
    "delivered_and_shipped": "delivered_and_shipped_quantity",
    "refunded": "refunded_quantity",
    "undelivered": "undelivered_quantity",
}


def _policy(policy: str | Policy) -> Policy:
    return POLICIES[policy] if isinstance(policy, str) else policy


def invoice_status(
    unq_sales: DataFrame,
    keys: Sequence[str],
    policy: str | Policy = "basic",
    buckets: Sequence[str] = BUCKETS,
    with_ratio: bool = True,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Invoice counts per bucket over invoice-first rows (A2, A4, A5).

    ``extra`` aggregates over the same rows join the same pass."""
    p = _policy(policy)
    df = unq_sales if p.keep is None else unq_sales.where(p.keep())
    aggs = [F.count(F.lit(1)).cast("double").alias(INVOICE_NAMES["total"])]
    aggs += [bucket_count(p.buckets[b]()).alias(INVOICE_NAMES[b]) for b in buckets]
    out = df.groupBy(*keys).agg(*aggs, *extra)
    if with_ratio:
        out = out.withColumn(
            "refund_ratio", ratio(F.col("refunded_invoice"), F.col("total_invoice"))
        )
    return out


def delivered_invoices(unq_sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A5: delivered-or-shipped, non-refund invoices per key (groups with any)."""
    cond = BASIC.buckets["delivered_and_shipped"]()
    return (
        unq_sales.where(cond)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).cast("double").alias("delivered_and_shipped_inv"))
    )


def quantity_status(
    sales: DataFrame,
    keys: Sequence[str],
    policy: str | Policy = "basic",
    quantity: str = "order_quantity",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Quantities per bucket over all lines (A3a basic, A3b strict).

    ``extra`` aggregates over the same rows join the same pass."""
    p = _policy(policy)
    df = sales if p.keep is None else sales.where(p.keep())
    aggs = [na_sum(quantity).alias(QUANTITY_NAMES["total"])]
    aggs += [bucket_sum(p.buckets[b](), quantity).alias(QUANTITY_NAMES[b]) for b in BUCKETS]
    return df.groupBy(*keys).agg(*aggs, *extra)
