"""Named queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Each query reads the driver tables under ``sf_dir`` (through the stand-in
views of ``sellerdesk.sources.fixtures``) and returns a DataFrame.  Tables that
a plan reads several times are written while it is built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerdesk.functions.dates import month_of, parse_dmy, parse_mdy, week_of
from sellerdesk.functions.nulls import null_safe_join, without_keys
from sellerdesk.functions.text import (
    date_part_of_update,
    item_key,
    normalize_key,
    parse_amount,
    parse_number,
    truncate_at_newline,
)
from sellerdesk.operators import campaigns, grains, measures, pricing, rollups, status
from sellerdesk.plans.from_files import ORDER_KEY_TYPES, Folders, file_inputs
from sellerdesk.plans.inputs import clean_sales, inputs
from sellerdesk.plans.reports import ITEM_MARGIN_COLUMNS, SHOP_ITEM, Reporting
from sellerdesk.session import scratch_path, stage
from sellerdesk.sources import files, landing, sinks
from sellerdesk.streaming import ingest
from sellerdesk.sources.fixtures import ORDER_KEY

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(name: str, staged: bool = True, **options):
    """Register ``fn(Reporting) -> DataFrame`` under ``name``.

    ``staged``: the plan reads the order lines (or the shop-part pairs) more than
    once, so they are written once; ``stage_first``: likewise the invoice-first
    lines.
    """

    def register(fn: Callable[[Reporting], DataFrame]) -> Callable[[Reporting], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return without_keys(fn(Reporting(inputs(spark, sf_dir, staged), **options)))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn

    return register


@query("shop_invoice_status", staged=False, stage_first=False)
def _shop_invoice_status(r: Reporting) -> DataFrame:
    """A2: invoice counts per shop, basic policy, with refund ratio."""
    return r.shop_invoice_status


@query("shop_invoice_report", staged=False, stage_first=False)
def _shop_invoice_report(r: Reporting) -> DataFrame:
    return r.shop_invoice_report


@query("item_report_basic")
def _item_report_basic(r: Reporting) -> DataFrame:
    return r.item_report_basic


@query("item_report_margin")
def _item_report_margin(r: Reporting) -> DataFrame:
    return r.item_report_margin



# ---- scalar functions over whole tables --------------------------------------
@query("normalize_key")
def _normalize_key(r: Reporting) -> DataFrame:
    """Join keys of every order line (all payment statuses)."""
    raw = r.inp.raw.sales
    return raw.select(
        *ORDER_KEY,
        normalize_key("shop_name").alias("shop_key"),
        item_key("order_item").alias("item_key"),
    )


@query("truncate_at_newline")
def _truncate_at_newline(r: Reporting) -> DataFrame:
    """P8 over whole document texts: the text before the first line break."""
    docs = r.inp.raw.table("documents")
    return docs.select("doc_id", truncate_at_newline("text").alias("first_line"))


def _two(c) -> F.Column:
    return F.lpad(c.cast("string"), 2, "0")


@query("date_part_of_update")
def _date_part_of_update(r: Reporting) -> DataFrame:
    """P9 + P17: day-first 'last update' stamps cut at the comma and parsed."""
    li = r.inp.raw.table("lineitem")
    d = F.col("l_shipdate")
    stamp = F.concat(
        _two(F.dayofmonth(d)), F.lit("-"), _two(F.month(d)), F.lit("-"),
        F.year(d).cast("string"), F.lit(", "), _two(F.col("l_linenumber") + 3),
        F.lit(":"), _two(F.col("l_orderkey") % 60), F.lit(" PM"),
    )
    out = li.select("l_orderkey", "l_linenumber", stamp.alias("last_update"))
    out = out.withColumn("update_text", date_part_of_update("last_update"))
    return out.withColumn("update_date", parse_dmy("update_text"))


@query("parse_dates")
def _parse_dates(r: Reporting) -> DataFrame:
    """Month-first and day-first date text in several spellings."""
    o = r.inp.raw.table("orders")
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 3
    mdy = (
        F.when(k == 0, F.concat(_two(F.month(d)), F.lit("-"), _two(F.dayofmonth(d)), F.lit("-"),
                                F.year(d).cast("string")))
        .when(k == 1, F.concat(F.month(d).cast("string"), F.lit("/"), F.dayofmonth(d).cast("string"),
                               F.lit("/"), F.year(d).cast("string")))
        .otherwise(F.concat(F.date_format(d, "MMMM"), F.lit(" "), F.dayofmonth(d).cast("string"),
                            F.lit(", "), F.year(d).cast("string")))
    )
    dmy = F.concat(F.dayofmonth(d).cast("string"), F.lit("."), F.month(d).cast("string"),
                   F.lit("."), F.year(d).cast("string"))
    out = o.select("o_orderkey", mdy.alias("mdy_text"), dmy.alias("dmy_text"))
    return out.withColumns({"mdy_date": parse_mdy("mdy_text"), "dmy_date": parse_dmy("dmy_text")})


@query("calendar_parts")
def _calendar_parts(r: Reporting) -> DataFrame:
    """Month and week number (day-of-year div 7 + 1) of order dates."""
    o = r.inp.raw.table("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return o.select(
        "o_orderkey",
        month_of("d").alias("month"),
        week_of("d", "yday_div7").alias("week"),
        week_of("d", "yday_minus1_div7").alias("week_from_day1"),
    )


@query("refund_flag")
def _refund_flag(r: Reporting) -> DataFrame:
    """Refund note test, a missing note counts as no refund."""
    return r.inp.raw.sales.select(*ORDER_KEY, "note", status.refund_flag("note").alias("refund"))


@query("parse_amount")
def _parse_amount(r: Reporting) -> DataFrame:
    """P10: bill amounts with thousands separators to numbers."""
    b = r.inp.raw.bills
    return b.select(
        "serial",
        *[parse_amount(c).alias(f"{c}_amount") for c in ("submitted", "approved", "paid", "due")],
    )


@query("parse_number")
def _parse_number(r: Reporting) -> DataFrame:
    """Quantity text to number; 'n/a' becomes null."""
    return r.inp.raw.sales.select(
        *ORDER_KEY,
        F.col("order_quantity").alias("quantity_text"),
        parse_number("order_quantity").alias("quantity"),
    )


# ---- filters -------------------------------------------------------------------
@query("paid_lines", staged=False)
def _paid_lines(r: Reporting) -> DataFrame:
    """F1 + cleaning: typed, keyed paid order lines."""
    return r.inp.sales


@query("catalog_margin_filter", staged=False)
def _catalog_margin_filter(r: Reporting) -> DataFrame:
    """catalog rows with positive prices and mrp above seller price."""
    return r.catalog_basic


@query("shop_pattern_report", staged=False, shop_pattern="T10|Priority")
def _shop_pattern_report(r: Reporting) -> DataFrame:
    """F8: shop invoice report with the directory limited to matching shops."""
    return r.shop_invoice_report


# ---- grains --------------------------------------------------------------------
@query("first_line_per_invoice", staged=False, stage_first=False)
def _first_line_per_invoice(r: Reporting) -> DataFrame:
    """W1."""
    return r.unq_sales


@query("campaign_date", staged=False, stage_first=False)
def _campaign_date(r: Reporting) -> DataFrame:
    """W2."""
    return r.unq_shop


@query("sales_with_campaign")
def _sales_with_campaign(r: Reporting) -> DataFrame:
    """J1."""
    return r.sales_with_campaign


@query("e_price", staged=False)
def _e_price(r: Reporting) -> DataFrame:
    """W3."""
    return grains.e_price(r.inp.sales)


@query("catalog_dedup")
def _catalog_dedup(r: Reporting) -> DataFrame:
    """W4 on the order-derived prices alone (, keyed first, D15)."""
    return grains.keep_first(r.inp.sales_prod, SHOP_ITEM, ["part_key"]).select(
        *SHOP_ITEM, "unit_mrp", "unit_seller_price"
    )


@query("catalog_fallback")
def _catalog_fallback(r: Reporting) -> DataFrame:
    """Catalog first, order-derived prices fill the gaps."""
    return r.catalog_fallback


@query("price_table")
def _price_table(r: Reporting) -> DataFrame:
    return r.price_table


@query("key_uniqueness_check")
def _key_uniqueness_check(r: Reporting) -> DataFrame:
    """Keys that occur more than once in a source meant to be keyed."""

    def dup(df: DataFrame, source: str, keys: list[str]) -> DataFrame:
        g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
        if "order_item" not in keys:
            g = g.withColumn("order_item", F.lit(None).cast("string"))
        return g.select(F.lit(source).alias("source"), "shop_name", "order_item", "n_rows")

    parts = [
        dup(r.inp.commercial, "directory", ["shop_name"]),
        dup(r.inp.catalog, "catalog", SHOP_ITEM),
        dup(r.inp.override, "override", SHOP_ITEM),
        dup(r.price_table, "price_table", SHOP_ITEM),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- measures ------------------------------------------------------------------
@query("payment_rollup", staged=False)
def _payment_rollup(r: Reporting) -> DataFrame:
    return r.payments


@query("item_quantity_status_basic", staged=False)
def _item_quantity_status_basic(r: Reporting) -> DataFrame:
    return status.quantity_status(r.inp.sales, SHOP_ITEM, "basic")


@query("item_quantity_status_strict", staged=False)
def _item_quantity_status_strict(r: Reporting) -> DataFrame:
    return r.item_quantity_strict


@query("item_invoice_status", staged=False, stage_first=False)
def _item_invoice_status(r: Reporting) -> DataFrame:
    return r.item_invoice_status


@query("delivery_days")
def _delivery_days(r: Reporting) -> DataFrame:
    return r.delivery_days


@query("avg_delivery_time")
def _avg_delivery_time(r: Reporting) -> DataFrame:
    return r.avg_delivery_time


@query("capped_rebate")
def _capped_rebate(r: Reporting) -> DataFrame:
    return r.rebate


@query("item_values")
def _item_values(r: Reporting) -> DataFrame:
    """Value columns of strict quantities priced from the price table."""
    j = measures.item_values(
        null_safe_join(r.item_quantity_strict, r.price_table, SHOP_ITEM, "inner"), margin=True
    )
    cols = [c for c in j.columns if c not in r.item_quantity_strict.columns or c in SHOP_ITEM]
    return j.select(*cols)


@query("margin_rates")
def _margin_rates(r: Reporting) -> DataFrame:
    return r.item_report_margin.select(
        *SHOP_ITEM, "commission_rate", "burn_rate", "discount_rate", "cost_ratio", "avg_deli_time"
    )


@query("item_cost_window")
def _item_cost_window(r: Reporting) -> DataFrame:
    """Cost per shop-item written onto every basic report row."""
    return r.item_report_basic.select(
        *SHOP_ITEM,
        "delivered_and_shipped_seller_price",
        "undelivered_seller_price",
        "refund_value",
        "cost",
    )


# ---- roll-ups ------------------------------------------------------------------
@query("hierarchy_totals")
def _hierarchy_totals(r: Reporting) -> DataFrame:
    """A10.  The report is written once, as the totals and the rows both read it."""
    report = stage(r.item_report_basic, "item_report")
    return rollups.with_totals(report, stage(rollups.level_totals(report), "level_totals"))


@query("invoice_rollup_sets", staged=False, stage_first=False)
def _invoice_rollup_sets(r: Reporting) -> DataFrame:
    return rollups.invoice_rollup_sets(r.shop_invoice_report)


@query("item_rollup_sets")
def _item_rollup_sets(r: Reporting) -> DataFrame:
    return rollups.item_rollup_sets(r.item_report_basic)


@query("weighted_rates")
def _weighted_rates(r: Reporting) -> DataFrame:
    return rollups.weighted_rates(r.item_report_basic, "mc")


for _level in rollups.LEVELS:
    query(f"{_level}_report")(lambda r, _l=_level: r.level_report(_l))


# ---- campaigns and margin groupings -------------------------------------------
@query("campaign_tag")
def _campaign_tag(r: Reporting) -> DataFrame:
    """Margin report rows tagged with every campaign they belong to."""
    return r.tagged_margin.select("campaign_name", *ITEM_MARGIN_COLUMNS)


@query("group_total")
def _group_total(r: Reporting) -> DataFrame:
    """Each campaign-tagged row with its campaign's total order value.

    The report is written once, as the totals and the rows both read it."""
    tagged = r.tagged_margin.select("campaign_name", *ITEM_MARGIN_COLUMNS)
    return campaigns.group_total(stage(tagged, "tagged_margin"), ["campaign_name"])


@query("campaign_report_shop_grain")
def _campaign_report_shop_grain(r: Reporting) -> DataFrame:
    """D5 variant: each shop's payments once per campaign (two readers, as above)."""
    tagged = r.tagged_margin.select("campaign_name", *ITEM_MARGIN_COLUMNS)
    return campaigns.margin_report_shop_grain(stage(tagged, "tagged_margin"), ["campaign_name"])


for _name in campaigns.MARGIN_GROUPINGS:
    query(_name)(lambda r, _n=_name: r.margin_grouping(_n))

# A priority filter as in the original: rows of one kind of shop, before the grouping (F8).
ROW_PATTERN = "for t10 july (16|30)"


@query("margin_by_mc_rows")
def _margin_by_mc_rows(r: Reporting) -> DataFrame:
    """F8: the mother-company margins of the shops whose name the pattern finds."""
    return r.margin_grouping("margin_by_mc", ROW_PATTERN)


@query("campaign_report_rows")
def _campaign_report_rows(r: Reporting) -> DataFrame:
    """F8 on the campaign comparison: the pattern thins the tagged rows."""
    return r.margin_grouping("campaign_report", ROW_PATTERN)



# ---- sources and sinks ---------------------------------------------------------
# Each query lands the stand-in input as the files a source system delivers
# (a fresh folder under the session's checkpoint folder), scans it back and
# returns the typed rows: the round trip must give the stand-in table.


def source_query(name: str):
    def register(fn: Callable[[Reporting, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            r = Reporting(inputs(spark, sf_dir))
            return without_keys(fn(r, scratch_path(spark, name)))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn

    return register


ORDER_EXTRA = {c: c for c in ORDER_KEY if c != "order_date"}


@source_query("scan_orders")
def _scan_orders(r: Reporting, folder: str) -> DataFrame:
    """O1/O3/O4 + P9/P16/P17: order exports (two header layouts, quoted line
    breaks, date text) scanned back and cleaned to typed, keyed order lines."""
    landing.land_orders(r.inp.raw, folder)
    rows = files.scan_orders(r.spark, folder, ORDER_EXTRA)
    rows = rows.withColumns({c: F.col(c).cast(t) for c, t in ORDER_KEY_TYPES.items()})
    return clean_sales(rows)


@source_query("scan_orders_incremental")
def _scan_orders_incremental(r: Reporting, folder: str) -> DataFrame:
    """O1/O3 as an incremental file stream: two export drops land one after
    the other; each availableNow run appends only the files it has not
    seen, and the table then holds every line exactly once."""
    exports, table = f"{folder}/exports", f"{folder}/order_lines"
    checkpoint = f"{folder}/checkpoint"
    # Each drop arrives as its own files; the stream picks up new ones only.
    for _ in landing.drop_orders(r.inp.raw, exports, layouts=1):
        ingest.ingest_order_exports(r.spark, exports, table, checkpoint).awaitTermination()
    return r.spark.read.parquet(table)


def _typed_catalog(df: DataFrame) -> DataFrame:
    return df.select(
        "shop_name",
        "order_item",
        "brand",
        F.col("part_key").cast("bigint").alias("part_key"),
        parse_number("unit_mrp").alias("unit_mrp"),
        parse_number("unit_seller_price").alias("unit_seller_price"),
    )


@source_query("scan_tsv")
def _scan_tsv(r: Reporting, folder: str) -> DataFrame:
    """O2: catalog as tab-separated '.csv' files with a declared header."""
    landing.land_catalog(r.inp.raw, folder, layouts=1)
    export_cols = landing.catalog_export(r.inp.raw).columns
    df = files.scan_tsv(r.spark, f"{folder}/layout_a", files.string_schema(export_cols))
    renamed = df.select(*[F.col(f"`{h}`").alias(n) for h, n in files.CATALOG_HEADERS.items()])
    return _typed_catalog(renamed)


@source_query("scan_union_by_name")
def _scan_union_by_name(r: Reporting, folder: str) -> DataFrame:
    """Catalog folder with two header layouts bound by name."""
    landing.land_catalog(r.inp.raw, folder, layouts=2)
    df = files.scan_union_by_name(r.spark, folder, files.CATALOG_HEADERS, sep="\t")
    return _typed_catalog(df)


@source_query("scan_csv")
def _scan_csv(r: Reporting, folder: str) -> DataFrame:
    """The price override file, header checked against the schema."""
    landing.land_override(r.inp.raw, folder)
    return files.scan_override(r.spark, folder)


@source_query("scan_sales_prod")
def _scan_sales_prod(r: Reporting, folder: str) -> DataFrame:
    """Price exports whose 25th header is blank."""
    return files.scan_sales_prod(r.spark, landing.land_sales_prod(r.inp.raw, folder))


def _from_files(r: Reporting, folder: str) -> Reporting:
    """Land every source as its exports and report from the files alone."""
    raw = r.inp.raw
    trackers, bills = landing.land_bills(raw, f"{folder}/bills")
    folders = Folders(
        orders=landing.land_orders(raw, f"{folder}/orders"),
        catalog=landing.land_catalog(raw, f"{folder}/catalog"),
        price_orders=landing.land_sales_prod(raw, f"{folder}/price_orders"),
        override=landing.land_override(raw, f"{folder}/override"),
        directory=landing.land_directory(raw, f"{folder}/directory"),
        trackers=trackers,
        bills=bills,
    )
    return Reporting(file_inputs(r.spark, folders))


@source_query("item_report_margin_from_files")
def _item_report_margin_from_files(r: Reporting, folder: str) -> DataFrame:
    """The margin report from scanned exports; equal to the table-fed one."""
    return _from_files(r, folder).item_report_margin


@source_query("shop_invoice_report_from_files")
def _shop_invoice_report_from_files(r: Reporting, folder: str) -> DataFrame:
    """The shop report from scanned exports; equal to the table-fed one."""
    return _from_files(r, folder).shop_invoice_report


@source_query("scan_seller_directory")
def _scan_seller_directory(r: Reporting, folder: str) -> DataFrame:
    """Directory export with extra columns; blank cells are null."""
    landing.land_directory(r.inp.raw, folder)
    return files.scan_seller_directory(r.spark, folder)


@source_query("scan_bills")
def _scan_bills(r: Reporting, folder: str) -> DataFrame:
    """O7 + P10: bill trackers named by a tracker list; bills without a
    submitted amount are skipped; amounts lose their thousands commas."""
    tracker_list, trackers = landing.land_bills(r.inp.raw, folder)
    bills = files.scan_bills(r.spark, tracker_list, trackers)
    return bills.withColumns({c: parse_amount(c) for c in ("submitted", "approved", "paid", "due")})


@source_query("sink_report")
def _sink_report(r: Reporting, folder: str) -> DataFrame:
    """The basic item report written as CSV ('NA' for missing) and
    read back with its own schema."""
    report = r.item_report_basic
    sinks.publish(report, folder, lambda df, path: sinks.write_report(df, path, compression="gzip"))
    current = sinks.current_version(r.spark, folder)
    return files.scan_csv(r.spark, current, report.schema, null_value=sinks.REPORT_NULL)


def _bdm_targets(r: Reporting) -> DataFrame:
    """The BDM target list: every BDM of the nation table with its extract name."""
    n = r.inp.raw.table("nation")
    return n.select(F.col("n_name").alias("bdm"), F.concat(F.lit("extract_"), "n_name").alias("target"))


def _bdm_extract(r: Reporting, report: DataFrame, folder: str) -> DataFrame:
    """The extracts read back: rows, the target that names their folder, and whether
    they carry today's update date (P21)."""
    sinks.write_bdm_extracts(report, _bdm_targets(r), folder)
    added = [T.StructField("update_date", T.DateType()), T.StructField("target", T.StringType())]
    schema = T.StructType([*report.schema.fields, *added])
    back = r.spark.read.schema(schema).parquet(folder)
    updated = (F.col("update_date") == F.current_date()).alias("updated_today")
    return back.select(*report.columns, "target", updated)


@source_query("bdm_extract_invoice")
def _bdm_extract_invoice(r: Reporting, folder: str) -> DataFrame:
    """Shop invoice report, one extract folder per listed BDM."""
    return _bdm_extract(r, r.shop_invoice_report, folder)


@source_query("bdm_extract_item")
def _bdm_extract_item(r: Reporting, folder: str) -> DataFrame:
    """Basic item report, one extract folder per listed BDM."""
    return _bdm_extract(r, r.item_report_basic, folder)


@source_query("level_reports_sink")
def _level_reports_sink(r: Reporting, folder: str) -> DataFrame:
    """The reports of all four levels, computed in one plan, written in a folder
    per level and read back."""
    report = r.level_reports
    sinks.publish(report, folder, lambda df, path: sinks.write_partitioned(df, "level", path))
    current = sinks.current_version(r.spark, folder)
    return r.spark.read.schema(report.schema).parquet(current).select(*report.columns)


@source_query("campaign_report_sink")
def _campaign_report_sink(r: Reporting, folder: str) -> DataFrame:
    """The campaign report written as CSV and read back."""
    report = r.margin_grouping("campaign_report")
    sinks.publish(report, folder)
    current = sinks.current_version(r.spark, folder)
    return files.scan_csv(r.spark, current, report.schema, null_value=sinks.REPORT_NULL)


__all__ = ["QUERIES", "SHOP_ITEM"]
