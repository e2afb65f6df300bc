"""Stand-ins for the reporting inputs, derived from the driver tables.

The reporting job reads an order-line export, a seller directory, a price
catalog, order-derived prices, a price override file and bill trackers.
None of those ship with the tests, so each is a view over the TPC-H-like
driver tables (``FIXTURES.md`` section 2).  The views are raw on purpose:
mixed case, extra spaces, text after a line break, commas in amounts,
null notes, unpaid lines, missing and duplicate catalog rows.

Each view is one ``spark.sql`` statement over DataFrame parameters, so the
planner sees the scans directly (column pruning, filter pushdown) and no
session-global temp view is created.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP = 128 << 20  # bytes of a Parquet row group, by the writers' default


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` to as many partitions as there are cores, if its files hold
    fewer row groups.

    A row group is one task's scan, so a table of one would be parsed and
    aggregated by one core.  How many tasks get rows is counted from the files' footers
    (no column is read): a table that fills the cores is not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= cores * ROW_GROUP or df.select(F.spark_partition_id()).distinct().count() >= cores:
        return df
    return df.repartition(cores, key)


# Columns that give the order-line export a total row order ("file order"
# of the reference).  Unique on every row of the driver data.
ORDER_KEY = ("order_date", "o_key", "line_no", "part_key", "supp_key", "qty_raw", "ext_price")

SHOP_SQL = """
SELECT s_suppkey, s_nationkey,
  s_name || CASE s_suppkey % 6
    WHEN 0 THEN '  For  T10 July 2' WHEN 1 THEN ' for T10 July 9 2021'
    WHEN 2 THEN ' For T10 july 16' WHEN 3 THEN ' for t10 July  23'
    WHEN 4 THEN ' For T10 July 30 ' ELSE '' END AS shop_name
FROM {supplier}
"""

# The orders come last: lines then lie by order where they are staged, and the first line
# of an invoice is found among few candidates before any of them is shuffled.
SALES_SQL = """
SELECT cast(l_orderkey AS string) AS invoice, cast(o_orderdate AS date) AS order_date,
  shop_name,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O'
         THEN CASE WHEN o_orderstatus = 'P' THEN 'cancel' ELSE 'processing' END
       WHEN l_returnflag = 'N' THEN 'picked'
       WHEN l_linestatus = 'O' THEN 'shipped' ELSE 'delivered' END AS order_status,
  upper(p_name) || chr(10) || 'size ' || cast(p_size AS string) AS order_item,
  CASE WHEN l_linenumber = 6 AND l_quantity < 5 THEN 'n/a'
       ELSE cast(cast(l_quantity AS int) AS string) END AS order_quantity,
  cast(floor(cast(round(p_retailprice * 100) AS bigint)
       * (100 - cast(round(l_discount * 100) AS bigint)) / 1e2) AS double) / 1e2 AS unit_order_price,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Nagad'
       WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'Cash' END AS payment_method,
  CASE WHEN l_linenumber = 7 THEN NULL
       WHEN l_returnflag = 'R' THEN 'Refund issued' ELSE 'ok' END AS note,
  cast(l_shipdate AS date) AS last_update_date,
  CASE WHEN l_orderkey % 10 = 0 THEN 'unpaid' ELSE 'paid' END AS payment_status,
  l_orderkey AS o_key, l_linenumber AS line_no, l_partkey AS part_key,
  l_suppkey AS supp_key, l_quantity AS qty_raw, l_extendedprice AS ext_price
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {shop} ON l_suppkey = s_suppkey
JOIN {orders} ON l_orderkey = o_orderkey
"""

COMMERCIAL_SQL = """
SELECT upper(shop_name) AS shop_name,
  n_name || '-K' || cast(s_suppkey % 2 AS string) || '-M' || cast(s_suppkey % 4 AS string) AS mother_company,
  n_name || '-K' || cast(s_suppkey % 2 AS string) AS kam, n_name AS bdm, r_name AS cat_head,
  CASE s_suppkey % 3 WHEN 0 THEN 'Electronics' WHEN 1 THEN 'Grocery' ELSE 'Fashion' END AS category
FROM {shop} JOIN {nation} ON s_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
WHERE s_suppkey % 17 <> 0
"""

# Each table's rows are made distinct before they meet, so only the two keys of a line are
# shuffled, once, by the part for both; a row of the join holds every column of its three,
# so it is distinct too.
PAIRS_SQL = """
SELECT shop_name, s_suppkey, p_partkey, p_name, p_brand, p_size, mrp_cents
FROM (SELECT DISTINCT l_suppkey, l_partkey
      FROM (SELECT /*+ REPARTITION(l_partkey) */ l_suppkey, l_partkey FROM {lineitem}))
JOIN (SELECT DISTINCT s_suppkey, shop_name FROM {shop}) ON l_suppkey = s_suppkey
JOIN (SELECT DISTINCT p_partkey, p_name, p_brand, p_size,
        cast(round(p_retailprice * 100) AS bigint) AS mrp_cents FROM {part}) ON l_partkey = p_partkey
"""

PRODUCT_SQL = """
SELECT shop_name, p_name AS order_item, p_brand AS brand, p_partkey AS part_key,
  CASE WHEN p_partkey % 13 = 0 THEN 0e0 ELSE cast(mrp_cents AS double) / 1e2 END AS unit_mrp,
  cast(floor(mrp_cents * (CASE p_size % 5 WHEN 0 THEN 100 WHEN 1 THEN 95 ELSE 80 END) / 1e2) AS double) / 1e2
    AS unit_seller_price
FROM {pairs} WHERE p_partkey % 7 <> 0
"""

SALES_PROD_SQL = """
SELECT shop_name, upper(p_name) AS order_item, p_partkey AS part_key,
  cast(mrp_cents AS double) / 1e2 AS unit_mrp,
  cast(floor(mrp_cents * 90 / 1e2) AS double) / 1e2 AS unit_seller_price
FROM {pairs} WHERE p_partkey % 7 = 0
"""

OVERRIDE_SQL = """
SELECT shop_name, p_name AS order_item,
  cast(floor(min(mrp_cents) * 85 / 1e2) AS double) / 1e2 AS unit_order_price,
  cast(floor(min(mrp_cents) * 75 / 1e2) AS double) / 1e2 AS unit_seller_price,
  cast(min(mrp_cents) AS double) / 1e2 AS unit_mrp
FROM {pairs} WHERE s_suppkey % 6 IN (3, 4) GROUP BY shop_name, p_name
"""

BILLS_SQL = """
SELECT cast(l_orderkey AS string) AS serial,
  CASE WHEN l_orderkey % 2 = 0 THEN upper(shop_name) ELSE shop_name END AS shop_name,
  CASE WHEN l_partkey % 11 = 0 THEN NULL
       WHEN k = 0 THEN cast(r AS string)
       ELSE cast(k AS string) || ',' || lpad(cast(r AS string), 3, '0') END AS submitted,
  CASE WHEN k = 0 THEN '0' ELSE cast(k AS string) || ',000' END AS approved,
  CASE WHEN l_linestatus <> 'F' THEN NULL WHEN k = 0 THEN '0' ELSE cast(k AS string) || ',000' END AS paid,
  CASE WHEN l_linestatus = 'F' OR k = 0 THEN '0' ELSE cast(k AS string) || ',000' END AS due
FROM (SELECT *, cast(floor(l_extendedprice / 1e3) AS bigint) AS k,
             cast(floor(l_extendedprice) AS bigint) % 1000 AS r
      FROM {lineitem}) x
JOIN {shop} ON l_suppkey = s_suppkey
"""

DRIVER_TABLES = ("region", "nation", "supplier", "part", "orders", "lineitem")


@dataclass
class RawInputs:
    """Raw stand-in inputs for one scale-factor directory.

    Properties are lazy DataFrames, but for ``pairs`` of staged inputs, which is
    written when first used.
    """

    spark: SparkSession
    sf_dir: str
    staged: bool = False
    # ``SALES_SQL`` makes an invoice of each order: lines grouped by o_key are grouped by invoice.
    invoice_is_order: ClassVar[bool] = True

    def table(self, name: str) -> DataFrame:
        """One DataFrame per table and input set: a Parquet read lists files
        and reads footers, so repeated reads of the same table cost planning
        time on the driver for nothing."""
        cache = self.__dict__.setdefault("_tables", {})
        if name not in cache:
            path = f"{self.sf_dir.rstrip('/')}/{name}.parquet"
            cache[name] = self.spark.read.parquet(path)
        return cache[name]

    @cached_property
    def lines(self) -> DataFrame:
        """The line table, dealt over the cores where its files are too small to fill them."""
        return spread(self.table("lineitem"), "l_orderkey")

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)

    @cached_property
    def shop(self) -> DataFrame:
        return self._sql(SHOP_SQL, supplier=self.table("supplier"))

    @cached_property
    def sales(self) -> DataFrame:
        return self._sql(
            SALES_SQL,
            lineitem=self.lines,
            orders=self.table("orders"),
            shop=self.shop,
            part=self.table("part"),
        )

    @cached_property
    def commercial(self) -> DataFrame:
        return self._sql(
            COMMERCIAL_SQL,
            shop=self.shop,
            nation=self.table("nation"),
            region=self.table("region"),
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """Shop-part pairs that sold; source of the three price tables.  With
        ``staged`` it is written once to the shared folder (three readers)."""
        df = self._sql(
            PAIRS_SQL, lineitem=self.lines, shop=self.shop, part=self.table("part")
        )
        if not self.staged:
            return df
        from sellerdesk.session import stage

        return stage(df, "shop_part_pairs")

    @cached_property
    def product(self) -> DataFrame:
        return self._sql(PRODUCT_SQL, pairs=self.pairs)

    @cached_property
    def sales_prod(self) -> DataFrame:
        return self._sql(SALES_PROD_SQL, pairs=self.pairs)

    @cached_property
    def override(self) -> DataFrame:
        return self._sql(OVERRIDE_SQL, pairs=self.pairs)

    @cached_property
    def bills(self) -> DataFrame:
        return self._sql(BILLS_SQL, lineitem=self.lines, shop=self.shop)

