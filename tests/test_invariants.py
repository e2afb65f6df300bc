"""Layer 3: invariants that hold whatever the data."""

from pyspark.sql import functions as F

from sellerdesk.operators import rollups
from sellerdesk.plans.inputs import inputs
from sellerdesk.plans.reports import Reporting

SF = "/root/testdata/sf0.001"


def test_buckets_never_exceed_total(spark):
    r = Reporting(inputs(spark, SF))
    q = r.item_quantity_strict.fillna(0.0)
    bad = q.where(
        (F.col("processing_quantity") + F.col("picked_quantity") > F.col("total_quantity") + 1e-9)
        | (F.abs(F.col("undelivered_quantity") - F.col("processing_quantity") - F.col("picked_quantity")) > 1e-9)
    )
    assert bad.count() == 0


def test_levels_resum_to_parent(spark):
    r = Reporting(inputs(spark, SF))
    sets = rollups.item_rollup_sets(r.item_report_basic)
    by = sets.groupBy("level", "cat_head", "month").agg(F.sum("revenue").alias("rev"))
    piv = {(x.level, x.cat_head, x.month): x.rev for x in by.collect()}
    for (level, ch, m), v in piv.items():
        if level != "cathead":
            assert abs(v - piv[("cathead", ch, m)]) < 1e-6 * max(1.0, abs(v))


def test_cost_constant_per_shop_item(spark):
    r = Reporting(inputs(spark, SF))
    n = r.item_report_basic.groupBy("shop_name", "order_item").agg(
        F.countDistinct("cost").alias("n")
    ).where("n > 1")
    assert n.count() == 0


def test_result_independent_of_partitioning(spark):

    def run(parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            df = Reporting(inputs(spark, SF)).level_report("bdm")
            return sorted(map(tuple, df.collect()), key=str)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")

    assert run(3) == run(13)
