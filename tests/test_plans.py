"""Plans: where filters stand, what is not written or expanded, how a hot shop is dealt."""

import os
import re

import pytest

from sellerdesk import session
from sellerdesk.functions.nulls import SALTS, salted_join
from sellerdesk.operators import rollups
from sellerdesk.plans.inputs import inputs
from sellerdesk.plans.reports import Reporting

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def report(spark):
    return Reporting(inputs(spark, SF))


def test_row_pattern_reaches_the_scans(report):
    plan = optimized(report.margin_grouping("margin_by_mc", "for priority"))
    assert "for priority" not in plan[: plan.index("Aggregate", plan.index("Aggregate") + 1)]
    # below the shop-item aggregation: next to the relation of the order lines
    below = [x for x in plan.split("Aggregate") if "for priority" in x and "Relation" in x]
    assert below and "order_quantity" in below[0]
    lines = plan.splitlines()
    places = [i for i, x in enumerate(lines) if "for priority" in x]
    for i in places:
        depth = re.search(r"[A-Z]", lines[i]).start()
        under = [x for x in lines[i + 1 :] if re.search(r"[A-Z]", x)]
        stop = next((j for j, x in enumerate(under) if re.search(r"[A-Z]", x).start() <= depth), len(under))
        assert not any("Join " in x for x in under[:stop])


def test_levels_expand_no_report_rows(report):
    lines = optimized(rollups.item_rollup_sets(report.item_report_basic)).splitlines()
    expand = next(i for i, x in enumerate(lines) if "Expand" in x)
    assert "Aggregate" in lines[expand + 1]  # the states, not the rows


def test_shop_report_stages_nothing(spark, monkeypatch):
    def refused(df, name):
        raise AssertionError(f"staged {name}")

    from sellerdesk.plans import inputs as plan_inputs
    from sellerdesk.plans import reports

    monkeypatch.setattr(session, "stage", refused)
    monkeypatch.setattr(reports, "stage", refused)
    monkeypatch.setattr(plan_inputs, "stage", refused)
    r = Reporting(inputs(spark, SF, staged=False), stage_first=False)
    assert r.shop_invoice_report.count() > 0


def test_a_hot_shop_is_dealt_to_several_tasks(spark):
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shop = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 50))
        items = spark.range(30_000).select(shop.alias("shop_name"), F.col("id").cast("string").alias("order_item"))
        shops = items.groupBy("shop_name").agg(F.count("*").alias("n"))
        joined = salted_join(items, shops, "shop_name", "order_item", "left")
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        plain = items.join(shops, "shop_name", "left")
        assert joined.exceptAll(plain).isEmpty() and plain.count() == joined.count()
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        tasks = joined.where("shop_name = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 3 and max(t["count"] for t in tasks) < 10_000 * 0.6 and SALTS >= 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
