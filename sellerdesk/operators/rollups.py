"""Roll-ups over the sales hierarchy.

Hierarchy: category head > BDM > KAM > mother company > shop, each level
reported per campaign month.  Weighted averages use the factored form
``sum(x * w) / sum(w)`` (``weighted_share``), so no group total is merged
back onto the rows.  All four levels come from one aggregation of the report to
exact states of the finest level, over which GROUPING SETS run; levels are told
apart by ``grouping_id``, never by a key being null (N4).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerdesk.functions.nulls import (
    exact_state,
    live_terms,
    merged_state,
    null_safe_join,
    ratio,
    share_of,
    state_total,
)

LEVELS: dict[str, list[str]] = {
    "mc": ["cat_head", "bdm", "kam", "mother_company", "month"],
    "kam": ["cat_head", "bdm", "kam", "month"],
    "bdm": ["cat_head", "bdm", "month"],
    "cathead": ["cat_head", "month"],
}
ALL_LEVEL_KEYS = LEVELS["mc"]

INVOICE_MEASURES = [
    "total_invoice",
    "processing_invoice",
    "picked_invoice",
    "delivered_and_shipped_invoice",
    "refunded_invoice",
    "submitted",
    "approved",
    "paid",
    "due",
]
ITEM_MEASURES = [
    "revenue",
    "delivered_and_shipped_value",
    "undelivered_value",
    "delivered_and_shipped_seller_price",
    "undelivered_seller_price",
    "cost",
    "avg_commission",
    "avg_cost_ratio",
    "avg_deli_time",
]
LEVEL_REPORT_COLUMNS = [
    "total_invoice",
    "processing_invoice",
    "picked_invoice",
    "delivered_and_shipped_invoice",
    "refunded_invoice",
    "revenue",
    "delivered_and_shipped_value",
    "undelivered_value",
    "delivered_and_shipped_seller_price",
    "undelivered_seller_price",
    "cost",
    "avg_commission",
    "avg_cost_ratio",
    "avg_refund_ratio",
    "avg_deli_time",
    "submitted",
    "approved",
    "paid",
    "due",
]


# Sums of the shop invoice report (A11) and of the item report (A12): name, source column.
INVOICE_SUMS = {
    "total_invoice": "total_invoice",
    "processing_invoice": "processing_invoice",
    "picked_invoice": "picked_invoice",
    "delivered_and_shipped_invoice": "delivered_and_shipped_inv",
    "refunded_invoice": "refunded_invoice",
    "submitted": "corporate_submitted",
    "approved": "corporate_approved",
    "paid": "corporate_paid",
    "due": "corporate_due",
}
ITEM_SUMS = {
    "revenue": "total_order_value",
    "delivered_and_shipped_value": "delivered_and_shipped_value",
    "undelivered_value": "undelivered_value",
    "delivered_and_shipped_seller_price": "delivered_and_shipped_seller_price",
    "undelivered_seller_price": "undelivered_seller_price",
    "cost": "cost",
}
# Rates weighted by order value (A13, A14): name, source column, the sum that divides.
ITEM_RATES = {
    "avg_commission": ("commission", "revenue"),
    "avg_cost_ratio": ("cost_ratio", "revenue"),
    "avg_deli_time": ("avg_deli_time", "delivered_and_shipped_value"),
}


@dataclass(frozen=True)
class Measures:
    """Sums and weighted rates with states that merge: a report is aggregated once, to the
    finest level, and coarser levels add up its exact states."""

    sums: dict[str, str]
    rates: dict[str, tuple[str, str]]

    def states(self) -> list[Column]:
        """Aggregates over report rows."""
        weight = F.col("total_order_value")
        aggs = [s for n, c in self.sums.items() for s in exact_state(c, n)]
        for n, (x, _) in self.rates.items():
            aggs += exact_state(F.col(x) * weight, n)
            aggs.append(live_terms(F.col(x), weight).alias(f"{n}__n"))
        return aggs

    def merged(self) -> list[Column]:
        """Aggregates over states."""
        aggs = [s for n in (*self.sums, *self.rates) for s in merged_state(n)]
        return aggs + [F.sum(f"{n}__n").alias(f"{n}__n") for n in self.rates]

    def values(self) -> list[Column]:
        rates = [
            share_of(F.col(f"{n}__n"), state_total(n), state_total(den)).alias(n)
            for n, (_, den) in self.rates.items()
        ]
        return [state_total(n).alias(n) for n in self.sums] + rates


INVOICE = Measures(INVOICE_SUMS, {})
ITEM = Measures(ITEM_SUMS, ITEM_RATES)


def _with_refund_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_refund_ratio", ratio("refunded_invoice", "total_invoice"))


def _rollup(report: DataFrame, measures: Measures, keys: Sequence[str]) -> DataFrame:
    return report.groupBy(*keys).agg(*measures.states()).select(*keys, *measures.values())


def invoice_rollup(shop_report: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _with_refund_ratio(_rollup(shop_report, INVOICE, keys))


def item_rollup(item_report: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _rollup(item_report, ITEM, keys)


def level_report(shop_report: DataFrame, item_report: DataFrame, level: str) -> DataFrame:
    """One management level: invoice roll-up full-outer-joined to the item
    roll-up on the level keys, nulls matching (J20)."""
    keys = LEVELS[level]
    inv = invoice_rollup(shop_report, keys)
    item = item_rollup(item_report, keys)
    return null_safe_join(inv, item, keys, "full").select(*keys, *LEVEL_REPORT_COLUMNS)


def _level_name(gid: Column) -> Column:
    """grouping_id over ALL_LEVEL_KEYS -> level name (bit set = key rolled up)."""
    n = len(ALL_LEVEL_KEYS)
    expr = None
    for name, keys in LEVELS.items():
        bits = sum(1 << (n - 1 - i) for i, k in enumerate(ALL_LEVEL_KEYS) if k not in keys)
        expr = (F.when(gid == bits, F.lit(name)) if expr is None
                else expr.when(gid == bits, F.lit(name)))
    return expr


def rollup_sets(df: DataFrame, measures: Measures) -> DataFrame:
    """All four levels, tagged by level.

    Report rows are aggregated once, to exact states of the finest level; the
    grouping sets run over those states (one row per mother company and month).
    """
    finest = df.groupBy(*ALL_LEVEL_KEYS).agg(*measures.states())
    sets = [[F.col(k) for k in keys] for keys in LEVELS.values()]
    out = finest.groupingSets(sets, *[F.col(k) for k in ALL_LEVEL_KEYS]).agg(
        *measures.merged(), F.grouping_id().alias("__gid")
    )
    level = _level_name(F.col("__gid")).alias("level")
    return out.select(level, *ALL_LEVEL_KEYS, *measures.values())


def invoice_rollup_sets(shop_report: DataFrame) -> DataFrame:
    return _with_refund_ratio(rollup_sets(shop_report, INVOICE)).select(
        "level", *ALL_LEVEL_KEYS, *INVOICE_MEASURES, "avg_refund_ratio"
    )


def item_rollup_sets(item_report: DataFrame) -> DataFrame:
    return rollup_sets(item_report, ITEM).select("level", *ALL_LEVEL_KEYS, *ITEM_MEASURES)


def level_reports(shop_report: DataFrame, item_report: DataFrame) -> DataFrame:
    """All four management levels in one plan (column ``level``): each report is
    read and aggregated once, and the two meet on level and keys (J20)."""
    keys = ["level", *ALL_LEVEL_KEYS]
    both = null_safe_join(invoice_rollup_sets(shop_report), item_rollup_sets(item_report), keys, "full")
    return both.select(*keys, *LEVEL_REPORT_COLUMNS)


def weighted_rates(item_report: DataFrame, level: str = "mc") -> DataFrame:
    """A13/A14 alone: value-weighted commission, cost ratio and delivery time."""
    keys = LEVELS[level]
    return item_rollup(item_report, keys).select(
        *keys, "avg_commission", "avg_cost_ratio", "avg_deli_time"
    )


def level_totals(item_report: DataFrame) -> DataFrame:
    """A10: order value and delivered value totals of every level, at mother-company grain.

    The finest level is aggregated from the rows once; coarser levels are
    rolled up from that small result, and the four are joined to one table.
    """
    sums = {"total_value": "total_order_value", "delivered_value": "delivered_and_shipped_value"}
    states = [s for n, c in sums.items() for s in exact_state(c, n)]
    finer = item_report.groupBy(*LEVELS["mc"]).agg(*states)
    totals = None
    for level, keys in LEVELS.items():
        if level != "mc":
            finer = finer.groupBy(*keys).agg(*[s for n in sums for s in merged_state(n)])
        up = finer.select(*keys, *[state_total(n).alias(f"{level}_{n}") for n in sums])
        totals = up if totals is None else null_safe_join(totals, up, keys, "left")
    return totals


def with_totals(item_report: DataFrame, totals: DataFrame) -> DataFrame:
    """A10: ``level_totals`` on each row, by a single null-safe left join on the five keys.

    Of written totals Spark knows the size beforehand and broadcasts them if they are
    small; the report rows are then not shuffled at all.
    """
    return null_safe_join(item_report, totals, LEVELS["mc"], "left")
