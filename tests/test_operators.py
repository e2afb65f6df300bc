"""Layer 1: grains, buckets, prices, roll-ups and campaigns on literal frames."""

import datetime as dt

from pyspark.sql import functions as F

from sellerdesk.operators import campaigns, grains, measures, pricing, rollups, status

D = dt.date
SALES_SCHEMA = (
    "invoice string, order_date date, shop_name string, order_status string, order_item string, "
    "order_quantity double, unit_order_price double, payment_method string, note string, "
    "last_update_date date, payment_status string, month int, o_key bigint, line_no int, "
    "part_key bigint, supp_key bigint, qty_raw double, ext_price double"
)


def line(inv, day, shop, status_, item, q=1.0, price=10.0, method="Cash", note="ok", lu=None, ln=1):
    o = int(inv)
    return (inv, D(2021, 7, day), shop, status_, item, q, price, method, note,
            lu or D(2021, 7, day + 3), "paid", 7, o, ln, 1, 1, q or 0.0, 1.0)


def test_first_line_per_invoice_and_invoice_spanning_two_shops(spark):
    rows = [
        line("1", 2, "a", "delivered", "x", ln=1),
        line("1", 2, "b", "delivered", "y", ln=2),   # same invoice, other shop
        line("2", 5, "a", "shipped", "x", ln=1),
    ]
    sales = spark.createDataFrame(rows, SALES_SCHEMA)
    unq = grains.first_line_per_invoice(sales)
    assert sorted((r.invoice, r.shop_name) for r in unq.collect()) == [("1", "a"), ("2", "a")]
    camp = {r.shop_name: r.campaign_date for r in grains.campaign_dates(unq).collect()}
    # shop b never owns an invoice's first line: no campaign date
    assert camp == {"a": D(2021, 7, 2)}


def test_status_policies(spark):
    rows = [
        line("1", 2, "a", "delivered", "x", q=2.0),
        line("2", 2, "a", "cancel", "x", q=5.0, note="Refund issued"),
        line("3", 2, "a", "picked", "x", q=None),
        line("4", 2, "a", "shipped", "x", q=1.0, note=None),   # null note still delivered
    ]
    sales = spark.createDataFrame(rows, SALES_SCHEMA)
    basic = status.quantity_status(sales, ["shop_name", "order_item"], "basic").first()
    assert basic.total_quantity == 8.0
    assert basic.refunded_quantity == 5.0          # refund on any status
    assert basic.picked_quantity == 0.0            # rows, all quantities null (N6)
    assert basic.processing_quantity is None       # no rows (N6)
    assert basic.delivered_and_shipped_quantity == 3.0
    strict = status.quantity_status(sales, ["shop_name", "order_item"], "strict").first()
    assert strict.total_quantity == 3.0            # cancel excluded
    assert strict.refunded_quantity is None        # refund needs shipped/delivered
    inv = status.invoice_status(sales, ["shop_name"], "basic").first()
    assert inv.total_invoice == 4.0 and inv.refunded_invoice == 1.0 and inv.refund_ratio == 0.25


def test_delivery_days_pre_aggregated_equals_line_sum(spark):
    rows = [
        line("1", 2, "a", "delivered", "x", lu=D(2021, 7, 10)),
        line("2", 4, "a", "shipped", "x", lu=D(2021, 7, 1)),     # negative days are kept
        line("3", 5, "a", "delivered", "x", note="Refund issued"),
    ]
    sales = spark.createDataFrame(rows, SALES_SCHEMA)
    unq_shop = spark.createDataFrame([("a", D(2021, 7, 2))], "shop_name string, campaign_date date")
    r = measures.delivery_days(sales, unq_shop).first()
    assert r.shop_item_deli_time == (8 + -1)
    none = spark.createDataFrame([], "shop_name string, campaign_date date")
    assert measures.delivery_days(sales, none).first().shop_item_deli_time == 0.0


def test_capped_rebate_caps_per_line_and_skips_null(spark):
    rows = [
        line("1", 2, "a", "cancel", "x", q=5000.0, method="NAGAD"),   # any status (D9)
        line("2", 2, "a", "delivered", "x", q=None, method="nagad"),
        line("3", 2, "a", "delivered", "x", q=3.0, method="Cash"),
        line("4", 2, "a", "delivered", "x", q=2.0, method="Nagad"),
    ]
    sales = spark.createDataFrame(rows, SALES_SCHEMA)
    prices = spark.createDataFrame(
        [("a", "x", 10.0, 8.0, 12.0)],
        "shop_name string, order_item string, unit_order_price double, unit_seller_price double, unit_mrp double",
    )
    r = measures.capped_rebate(sales, prices).first()
    assert r.nagad_discount_value == 2000.0 + 2.0


def test_catalog_fallback_prefers_catalog_then_lowest_part(spark):
    cat = spark.createDataFrame(
        [("s", "i", "B", 9, 8.0, 10.0), ("s", "i", "B", 3, 7.0, 10.0)],
        "shop_name string, order_item string, brand string, part_key bigint, "
        "unit_seller_price double, unit_mrp double",
    )
    prod = spark.createDataFrame(
        [("s", "i", 1, 99.0, 99.0), ("s", "j", 2, 5.0, 6.0)],
        "shop_name string, order_item string, part_key bigint, unit_mrp double, unit_seller_price double",
    )
    got = {(r.order_item, r.unit_seller_price) for r in pricing.catalog_fallback(cat, prod).collect()}
    assert got == {("i", 7.0), ("j", 6.0)}


def test_catalog_margin_filter(spark):
    cat = spark.createDataFrame(
        [(1, 10.0, 8.0), (2, 10.0, 10.0), (3, 0.0, 1.0), (4, None, 1.0)],
        "part_key int, unit_mrp double, unit_seller_price double",
    )
    assert [r.part_key for r in pricing.catalog_margin_filter(cat).collect()] == [1]


def test_item_cost_window_sums_catalog_copies(spark):
    df = spark.createDataFrame(
        [("s", "i", 1.0, 2.0, None), ("s", "i", 1.0, None, None), ("s", "j", None, None, None)],
        "shop_name string, order_item string, delivered_and_shipped_seller_price double, "
        "undelivered_seller_price double, refund_value double",
    )
    got = {(r.order_item, r.cost) for r in measures.item_cost(df).collect()}
    assert got == {("i", 4.0), ("j", 0.0)}


def test_campaign_tags_follow_rules(spark):
    shops = ["x for t10 july 2", "x for t10 july 23", "x for t10 july 25", "x for t10 july 9 2021", "plain", None]
    df = spark.createDataFrame([(s,) for s in shops], "shop_name string")
    got = sorted((r.shop_name, r.campaign_name) for r in campaigns.tag_campaigns(df).collect())
    assert got == [
        ("x for t10 july 2", "T10 July 2"),
        ("x for t10 july 23", "T10 July 23"),
        ("x for t10 july 25", "T10 July 2"),        # D18, kept on purpose
        ("x for t10 july 9 2021", "T10 July 9"),
    ]


def test_rollup_sets_level_names_and_null_keys(spark):
    rows = [
        ("c1", "b1", "k1", "m1", 7, 10.0, 5.0, 0.1, 0.2, 3.0, 1.0),
        ("c1", None, None, None, 7, 20.0, 0.0, 0.3, None, None, 2.0),   # null keys stay apart from levels
    ]
    df = spark.createDataFrame(
        rows,
        "cat_head string, bdm string, kam string, mother_company string, month int, total_order_value double, "
        "delivered_and_shipped_value double, commission double, cost_ratio double, avg_deli_time double, cost double",
    ).withColumns({c: F.lit(0.0) for c in ("undelivered_value", "delivered_and_shipped_seller_price",
                                            "undelivered_seller_price")})
    sets = rollups.item_rollup_sets(df)
    counts = {r.level: r["count"] for r in sets.groupBy("level").count().collect()}
    assert counts == {"mc": 2, "kam": 2, "bdm": 2, "cathead": 1}
    top = sets.where("level = 'cathead'").first()
    assert top.revenue == 30.0
    assert abs(top.avg_commission - (0.1 * 10 + 0.3 * 20) / 30) < 1e-12


def test_margin_report_shop_grain_counts_payments_once(spark):
    df = spark.createDataFrame(
        [("T", "s1", 100.0), ("T", "s1", 100.0), ("T", "s2", 50.0)],
        "campaign_name string, shop_name string, corporate_paid double",
    )
    for c in campaigns.MARGIN_SUMS.values():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(1.0))
    naive = campaigns.margin_report(df, ["campaign_name"]).first()
    grain = campaigns.margin_report_shop_grain(df, ["campaign_name"]).first()
    assert naive.paid == 250.0 and grain.paid == 150.0   # D5


def test_first_price_rides_on_the_line_facts(spark):
    """The aggregate picks what the window picks: missing dates first, a missing price stays."""
    rows = [
        ("s", "a", None, 9, 2, 5.0),
        ("s", "a", "2021-07-01", 1, 1, 7.0),
        ("s", "b", "2021-07-02", 2, 1, 8.0),
        ("s", "b", "2021-07-01", 3, 2, None),
        ("t", "a", "2021-07-01", 4, 1, 2.0),
        ("t", "a", "2021-07-01", 4, 0, 3.0),
    ]
    sales = spark.createDataFrame(
        rows, "shop_name string, order_item string, d string, o_key long, line_no int, unit_order_price double"
    ).selectExpr(
        "*", "cast(d as date) order_date", "1L part_key", "1L supp_key", "1e0 qty_raw", "1e0 ext_price"
    )
    keys = ["shop_name", "order_item"]
    riding = sales.groupBy(*keys).agg(grains.first_price()).collect()
    assert {tuple(r) for r in riding} == {tuple(r) for r in grains.e_price(sales).collect()}
    assert {tuple(r) for r in riding} == {("s", "a", 5.0), ("s", "b", None), ("t", "a", 3.0)}
