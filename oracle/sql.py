"""DuckDB SQL for the oracle check (see ``oracle/__init__.py``)."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Expression helpers (DuckDB dialect)
# ---------------------------------------------------------------------------

# Unicode White_Space, the class the reference's squish uses.
WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ORD = "order_date, o_key, line_no, part_key, supp_key, qty_raw, ext_price"


def norm(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '{WS}+', ' ', 'g')))"


def trunc(x: str) -> str:
    return f"regexp_replace({x}, '(?s)\\r|\\n.*', '', 'g')"


def grepl(x: str, pattern: str, ignore_case: bool = False) -> str:
    p = ("(?i)" if ignore_case else "") + pattern
    return f"coalesce(regexp_matches({x}, '{p}'), false)"


def div(a: str, b: str) -> str:
    return f"(({a}) / NULLIF({b}, 0))"


def msum(x: str) -> str:
    """Money sum without order effects, 0 over no values; NaN is skipped.

    Whole numbers of 2^-64 in 128 bits, left through text, which rounds once."""
    value = f"CASE WHEN NOT isnan(CAST({x} AS DOUBLE)) THEN CAST(CAST({x} AS DOUBLE) * 18446744073709551616.0 AS HUGEINT) END"
    return f"(CAST(CAST(coalesce(sum({value}), 0) AS VARCHAR) AS DOUBLE) / 18446744073709551616.0)"


def on(a: str, b: str, keys: list[str]) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


REFUND = grepl("note", "refund", True)
SHIPPED_OR_DELIVERED = "(order_status = 'shipped' OR order_status = 'delivered')"
PICKED_OR_PROCESSING = "(order_status = 'picked' OR order_status = 'processing')"

# ---------------------------------------------------------------------------
# Input stand-ins (FIXTURES.md section 2) and cleaned inputs
# ---------------------------------------------------------------------------

FIXTURE_CTES = r"""
t_shop AS (
SELECT s_suppkey, s_nationkey,
  s_name || CASE s_suppkey % 6
    WHEN 0 THEN '  For  T10 July 2' WHEN 1 THEN ' for T10 July 9 2021'
    WHEN 2 THEN ' For T10 july 16' WHEN 3 THEN ' for t10 July  23'
    WHEN 4 THEN ' For T10 July 30 ' ELSE '' END AS shop_name
FROM supplier),
t_sales AS (
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
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN t_shop ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
t_commercial AS (
SELECT upper(shop_name) AS shop_name,
  n_name || '-K' || cast(s_suppkey % 2 AS string) || '-M' || cast(s_suppkey % 4 AS string) AS mother_company,
  n_name || '-K' || cast(s_suppkey % 2 AS string) AS kam, n_name AS bdm, r_name AS cat_head,
  CASE s_suppkey % 3 WHEN 0 THEN 'Electronics' WHEN 1 THEN 'Grocery' ELSE 'Fashion' END AS category
FROM t_shop JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
WHERE s_suppkey % 17 <> 0),
t_pairs AS (
SELECT DISTINCT shop_name, s_suppkey, p_partkey, p_name, p_brand, p_size,
  cast(round(p_retailprice * 100) AS bigint) AS mrp_cents
FROM lineitem JOIN t_shop ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
t_product AS (
SELECT shop_name, p_name AS order_item, p_brand AS brand, p_partkey AS part_key,
  CASE WHEN p_partkey % 13 = 0 THEN 0e0 ELSE cast(mrp_cents AS double) / 1e2 END AS unit_mrp,
  cast(floor(mrp_cents * (CASE p_size % 5 WHEN 0 THEN 100 WHEN 1 THEN 95 ELSE 80 END) / 1e2) AS double) / 1e2
    AS unit_seller_price
FROM t_pairs WHERE p_partkey % 7 <> 0),
t_sales_prod AS (
SELECT shop_name, upper(p_name) AS order_item, p_partkey AS part_key,
  cast(mrp_cents AS double) / 1e2 AS unit_mrp,
  cast(floor(mrp_cents * 90 / 1e2) AS double) / 1e2 AS unit_seller_price
FROM t_pairs WHERE p_partkey % 7 = 0),
t_override AS (
SELECT shop_name, p_name AS order_item,
  cast(floor(min(mrp_cents) * 85 / 1e2) AS double) / 1e2 AS unit_order_price,
  cast(floor(min(mrp_cents) * 75 / 1e2) AS double) / 1e2 AS unit_seller_price,
  cast(min(mrp_cents) AS double) / 1e2 AS unit_mrp
FROM t_pairs WHERE s_suppkey % 6 IN (3, 4) GROUP BY shop_name, p_name),
t_bills AS (
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
      FROM lineitem) x
JOIN t_shop ON l_suppkey = s_suppkey)"""

CLEAN_CTES = f"""
sales_all AS (
SELECT invoice, order_date, {norm('shop_name')} AS shop_name, order_status,
  {norm(trunc('order_item'))} AS order_item,
  TRY_CAST(order_quantity AS DOUBLE) AS order_quantity,
  CAST(unit_order_price AS DOUBLE) AS unit_order_price,
  payment_method, note, last_update_date, payment_status,
  CAST(month(order_date) AS INTEGER) AS month,
  o_key, line_no, part_key, supp_key, qty_raw, ext_price
FROM t_sales),
sales AS (SELECT * FROM sales_all WHERE payment_status = 'paid'),
unq_sales AS (
SELECT *, CAST(1 AS DOUBLE) AS count FROM sales
QUALIFY row_number() OVER (PARTITION BY invoice ORDER BY {ORD}) = 1),
unq_shop AS (
SELECT shop_name, order_date AS campaign_date FROM unq_sales
QUALIFY row_number() OVER (PARTITION BY shop_name ORDER BY {ORD}) = 1),
commercial AS (
SELECT {norm('shop_name')} AS shop_name, mother_company, kam, bdm, cat_head, category
FROM t_commercial),
product AS (
SELECT {norm('shop_name')} AS shop_name, {norm('order_item')} AS order_item, brand, part_key,
  CAST(unit_seller_price AS DOUBLE) AS unit_seller_price, CAST(unit_mrp AS DOUBLE) AS unit_mrp
FROM t_product),
sales_prod AS (
SELECT {norm('shop_name')} AS shop_name, {norm(trunc('order_item'))} AS order_item, part_key,
  TRY_CAST(CAST(unit_mrp AS VARCHAR) AS DOUBLE) AS unit_mrp,
  TRY_CAST(CAST(unit_seller_price AS VARCHAR) AS DOUBLE) AS unit_seller_price
FROM t_sales_prod),
override_prices AS (
SELECT {norm('shop_name')} AS shop_name, {norm('order_item')} AS order_item,
  CAST(unit_order_price AS DOUBLE) AS unit_order_price,
  CAST(unit_seller_price AS DOUBLE) AS unit_seller_price, CAST(unit_mrp AS DOUBLE) AS unit_mrp
FROM t_override),
bills AS (
SELECT CAST(serial AS VARCHAR) AS serial, {norm('shop_name')} AS shop_name,
  TRY_CAST(replace(submitted, ',', '') AS DOUBLE) AS submitted,
  TRY_CAST(replace(approved, ',', '') AS DOUBLE) AS approved,
  TRY_CAST(replace(paid, ',', '') AS DOUBLE) AS paid,
  TRY_CAST(replace(due, ',', '') AS DOUBLE) AS due
FROM t_bills WHERE submitted IS NOT NULL),
payments AS (
SELECT shop_name,
  {msum('submitted')} AS corporate_submitted, {msum('approved')} AS corporate_approved,
  {msum('paid')} AS corporate_paid, {msum('due')} AS corporate_due
FROM bills GROUP BY shop_name)"""


def with_ctes(*ctes: str) -> str:
    parts = [FIXTURE_CTES, CLEAN_CTES, *ctes]
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts if p.strip())


# ---------------------------------------------------------------------------
# Reference-shaped building blocks
# ---------------------------------------------------------------------------

INVOICE_NAMES = {
    "total": "total_invoice",
    "processing": "processing_invoice",
    "picked": "picked_invoice",
    "delivered": "delivered_and_shipped_inv",
    "refunded": "refunded_invoice",
    "undelivered": "undelivered_invoice",
}
QUANTITY_NAMES = {
    "total": "total_quantity",
    "processing": "processing_quantity",
    "picked": "picked_quantity",
    "delivered": "delivered_and_shipped_quantity",
    "refunded": "refunded_quantity",
    "undelivered": "undelivered_quantity",
}


def bucket_filters(policy: str) -> dict[str, str]:
    return {
        "total": "TRUE" if policy == "basic" else "order_status != 'cancel'",
        "processing": "order_status = 'processing'",
        "picked": "order_status = 'picked'",
        "delivered": f"NOT {REFUND} AND {SHIPPED_OR_DELIVERED}",
        "refunded": REFUND if policy == "basic" else f"{REFUND} AND {SHIPPED_OR_DELIVERED}",
        "undelivered": PICKED_OR_PROCESSING,
    }


def merge_chain(prefix: str, tables: list[tuple[str, list[str]]], keys: list[str]) -> str:
    """Nested full outer joins on null-safe keys, like R's merge(all = TRUE)."""
    sql = f"SELECT * FROM {tables[0][0]}"
    acc = list(tables[0][1])
    for i, (name, cols) in enumerate(tables[1:]):
        a, b = f"{prefix}a{i}", f"{prefix}b{i}"
        keysel = ", ".join(f"coalesce({a}.{k}, {b}.{k}) AS {k}" for k in keys)
        sel = ", ".join([f"{a}.{c}" for c in acc] + [f"{b}.{c}" for c in cols])
        sql = f"SELECT {keysel}, {sel} FROM ({sql}) {a} FULL JOIN {name} {b} ON {on(a, b, keys)}"
        acc += cols
    return sql


def status_ctes(name: str, src: str, keys: list[str], policy: str, measure: str | None) -> str:
    """Six filtered aggregates and five full outer merges ( etc.)."""
    names = INVOICE_NAMES if measure is None else QUANTITY_NAMES
    agg = (
        "CAST(count(*) AS DOUBLE)"
        if measure is None
        else f"coalesce(sum({measure}), 0)"
    )
    k = ", ".join(keys)
    ctes = []
    order = ["total", "processing", "picked", "delivered", "refunded", "undelivered"]
    for b in order:
        ctes.append(
            f"{name}_{b} AS (SELECT {k}, {agg} AS {names[b]} FROM {src} "
            f"WHERE {bucket_filters(policy)[b]} GROUP BY {k})"
        )
    merged = merge_chain(name, [(f"{name}_{b}", [names[b]]) for b in order], keys)
    ctes.append(f"{name} AS ({merged})")
    return ",\n".join(ctes)


def one_query(*ctes: str, select: str) -> str:
    return with_ctes(*ctes) + "\n" + select


# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------

ORACLE_SQL: dict[str, str] = {}

SHOP_INVOICE_STATUS_CTE = status_ctes("shop_inv", "unq_sales", ["shop_name"], "basic", None)

ORACLE_SQL["shop_invoice_status"] = one_query(
    SHOP_INVOICE_STATUS_CTE,
    select="SELECT *, "
    + div("refunded_invoice", "total_invoice")
    + " AS refund_ratio FROM shop_inv",
)

def shop_invoice_report_cte(directory: str = "commercial") -> str:
    return (
        SHOP_INVOICE_STATUS_CTE
        + f""",
shop_invoice_report AS (
SELECT c.category, c.cat_head, c.bdm, c.kam, c.mother_company, x.shop_name, x.campaign_date,
  CAST(month(x.campaign_date) AS INTEGER) AS month,
  x.total_invoice, x.processing_invoice, x.picked_invoice, x.delivered_and_shipped_inv,
  x.refunded_invoice, x.undelivered_invoice, {div('x.refunded_invoice', 'x.total_invoice')} AS refund_ratio,
  p.corporate_submitted, p.corporate_approved, p.corporate_paid, p.corporate_due
FROM (SELECT coalesce(u.shop_name, s.shop_name) AS shop_name, u.campaign_date,
        s.total_invoice, s.processing_invoice, s.picked_invoice, s.delivered_and_shipped_inv,
        s.refunded_invoice, s.undelivered_invoice
      FROM unq_shop u FULL JOIN shop_inv s ON {on('u', 's', ['shop_name'])}) x
LEFT JOIN {directory} c ON {on('x', 'c', ['shop_name'])}
LEFT JOIN payments p ON {on('x', 'p', ['shop_name'])}
WHERE x.shop_name IS NOT NULL)"""
    )


SHOP_INVOICE_REPORT_CTE = shop_invoice_report_cte()

ORACLE_SQL["shop_invoice_report"] = one_query(
    SHOP_INVOICE_REPORT_CTE, select="SELECT * FROM shop_invoice_report"
)

SI = ["shop_name", "order_item"]

# Delivery days at line grain after the campaign-date merge.
DELIVERY_CTE = f"""
sales_campaign AS (
SELECT s.*, u.campaign_date FROM sales s LEFT JOIN unq_shop u ON {on('s', 'u', ['shop_name'])}),
shop_deli_time AS (
SELECT shop_name, order_item,
  coalesce(sum(CAST(date_diff('day', campaign_date, last_update_date) AS DOUBLE)), 0) AS shop_item_deli_time
FROM sales_campaign
WHERE {SHIPPED_OR_DELIVERED} AND NOT {REFUND}
GROUP BY shop_name, order_item)"""

E_PRICE_CTE = f"""
e_price AS (
SELECT shop_name, order_item, unit_order_price FROM sales
QUALIFY row_number() OVER (PARTITION BY shop_name, order_item ORDER BY {ORD}) = 1)"""

AVG_DELIVERY_CTE = (
    DELIVERY_CTE
    + f""",
delivered_inv_si AS (
SELECT shop_name, order_item, CAST(count(*) AS DOUBLE) AS delivered_and_shipped_inv
FROM unq_sales WHERE NOT {REFUND} AND {SHIPPED_OR_DELIVERED}
GROUP BY shop_name, order_item),
shop_delivery AS (
SELECT coalesce(a.shop_name, b.shop_name) AS shop_name, coalesce(a.order_item, b.order_item) AS order_item,
  {div('b.shop_item_deli_time', 'a.delivered_and_shipped_inv')} AS avg_deli_time
FROM delivered_inv_si a FULL JOIN shop_deli_time b ON {on('a', 'b', SI)})"""
)

def values_sql(alias: str, margin: bool) -> str:
    a = alias
    cols = [
        f"{a}.total_quantity * {a}.unit_seller_price AS total_seller_price",
        f"{a}.processing_quantity * {a}.unit_seller_price AS processing_seller_price",
        f"{a}.picked_quantity * {a}.unit_seller_price AS picked_seller_price",
        f"{a}.delivered_and_shipped_quantity * {a}.unit_seller_price AS delivered_and_shipped_seller_price",
        f"{a}.undelivered_quantity * {a}.unit_seller_price AS undelivered_seller_price",
        f"{a}.total_quantity * {a}.unit_order_price AS total_order_value",
        f"{a}.processing_quantity * {a}.unit_order_price AS processing_value",
        f"{a}.picked_quantity * {a}.unit_order_price AS picked_value",
        f"{a}.delivered_and_shipped_quantity * {a}.unit_order_price AS delivered_and_shipped_value",
        f"{a}.undelivered_quantity * {a}.unit_order_price AS undelivered_value",
        f"{a}.refunded_quantity * {a}.unit_seller_price AS refund_value",
    ]
    if margin:
        cols += [
            f"{a}.total_quantity * {a}.unit_mrp AS total_market_value",
            f"({a}.unit_mrp - {a}.unit_seller_price) * {a}.total_quantity AS commission_value",
            f"({a}.unit_mrp - {a}.unit_order_price) * {a}.total_quantity AS discount_value",
            f"({a}.unit_seller_price - {a}.unit_order_price) * {a}.total_quantity AS burn_value",
        ]
    else:
        cols.append(f"{div(f'{a}.unit_mrp - {a}.unit_seller_price', f'{a}.unit_mrp')} AS commission")
    cols.append("CAST(1 AS DOUBLE) AS count")
    return ",\n  ".join(cols)


COST_SUM = (
    f"{msum('delivered_and_shipped_seller_price')} + {msum('undelivered_seller_price')}"
    f" + {msum('refund_value')}"
)

HIER = "mother_company, kam, bdm, category, cat_head"
QTY_COLS = ", ".join(QUANTITY_NAMES.values())
INV_COLS = ", ".join(INVOICE_NAMES.values())
SP_COLS = ("total_seller_price, processing_seller_price, picked_seller_price, "
           "delivered_and_shipped_seller_price, undelivered_seller_price")
VAL_COLS = ("total_order_value, processing_value, picked_value, delivered_and_shipped_value, "
            "undelivered_value, refund_value")

ITEM_BASIC_CTE = (
    status_ctes("item_qty", "sales", SI, "basic", "order_quantity")
    + ",\n"
    + AVG_DELIVERY_CTE.strip()
    + ",\n"
    + E_PRICE_CTE.strip()
    + f""",
product_basic AS (
SELECT * FROM product WHERE unit_mrp > 0 AND unit_seller_price > 0 AND unit_mrp > unit_seller_price),
item_joined AS (
SELECT x.*, p.brand, p.unit_seller_price, p.unit_mrp, e.unit_order_price,
  c.mother_company, c.kam, c.bdm, c.cat_head, c.category, d.avg_deli_time
FROM (SELECT coalesce(u.shop_name, q.shop_name) AS shop_name, u.campaign_date, q.order_item,
        q.total_quantity, q.processing_quantity, q.picked_quantity, q.delivered_and_shipped_quantity,
        q.refunded_quantity, q.undelivered_quantity
      FROM unq_shop u FULL JOIN item_qty q ON {on('u', 'q', ['shop_name'])}) x
LEFT JOIN product_basic p ON {on('x', 'p', SI)}
LEFT JOIN e_price e ON {on('x', 'e', SI)}
LEFT JOIN commercial c ON {on('x', 'c', ['shop_name'])}
LEFT JOIN shop_delivery d ON {on('x', 'd', SI)}),
item_valued AS (
SELECT *, {values_sql('item_joined', False)} FROM item_joined),
item_cost AS (
SELECT shop_name, order_item, {COST_SUM} AS cost FROM item_valued GROUP BY shop_name, order_item),
item_report_basic AS (
SELECT v.mother_company, v.kam, v.bdm, v.category, v.cat_head, v.shop_name, v.campaign_date,
  CAST(month(v.campaign_date) AS INTEGER) AS month, v.order_item,
  v.unit_order_price, v.unit_seller_price, v.unit_mrp,
  v.total_quantity, v.processing_quantity, v.picked_quantity, v.delivered_and_shipped_quantity,
  v.refunded_quantity, v.undelivered_quantity,
  v.total_seller_price, v.processing_seller_price, v.picked_seller_price,
  v.delivered_and_shipped_seller_price, v.undelivered_seller_price,
  v.total_order_value, v.processing_value, v.picked_value, v.delivered_and_shipped_value,
  v.undelivered_value, v.refund_value, v.commission, k.cost,
  {div('k.cost', 'v.total_order_value')} AS cost_ratio, v.avg_deli_time, v.count
FROM item_valued v JOIN item_cost k ON {on('v', 'k', SI)})"""
)

ORACLE_SQL["item_report_basic"] = one_query(ITEM_BASIC_CTE, select="SELECT * FROM item_report_basic")

# Price table of the second script, in its own order: join all
# lines to the catalog, then keep the first line per shop-item.
PRICE_TABLE_CTE = f"""
catalog_all AS (
SELECT shop_name, order_item, unit_seller_price, unit_mrp, part_key, 0 AS source_rank FROM product
UNION ALL
SELECT shop_name, order_item, unit_seller_price, unit_mrp, part_key, 1 AS source_rank FROM sales_prod),
catalog_fallback AS (
SELECT shop_name, order_item, unit_seller_price, unit_mrp FROM catalog_all
QUALIFY row_number() OVER (PARTITION BY shop_name, order_item ORDER BY source_rank, part_key) = 1),
e_price2 AS (
SELECT shop_name, order_item, unit_order_price, unit_seller_price, unit_mrp FROM (
  SELECT s.shop_name, s.order_item, s.unit_order_price, c.unit_seller_price, c.unit_mrp,
    row_number() OVER (PARTITION BY s.shop_name, s.order_item
                       ORDER BY s.order_date, s.o_key, s.line_no, s.part_key, s.supp_key, s.qty_raw, s.ext_price) AS rn
  FROM sales s LEFT JOIN catalog_fallback c ON {on('s', 'c', SI)}) z
WHERE rn = 1),
price_table AS (
SELECT * FROM (
  SELECT * FROM e_price2
  WHERE NOT {grepl('shop_name', 'for t10 july 30')} AND NOT {grepl('shop_name', 'for t10 july 23')}
  UNION ALL
  SELECT shop_name, order_item, unit_order_price, unit_seller_price, unit_mrp FROM override_prices) y
WHERE unit_mrp > 0 AND unit_seller_price > 0 AND unit_order_price > 0 AND unit_mrp >= unit_seller_price)"""

NAGAD_CTE = f"""
nagad AS (
SELECT s.shop_name, s.order_item,
  {msum("""CASE WHEN s.order_quantity * e.unit_order_price * 0.1 > 2000 THEN 2000
                    ELSE s.order_quantity * e.unit_order_price * 0.1 END""")} AS nagad_discount_value
FROM sales s JOIN price_table e ON {on('s', 'e', SI)}
WHERE {grepl('s.payment_method', 'nagad', True)}
GROUP BY s.shop_name, s.order_item)"""

ITEM_MARGIN_CTE = (
    status_ctes("inv_si", "unq_sales", SI, "strict", None)
    + ",\n"
    + status_ctes("qty_si", "sales", SI, "strict", "order_quantity")
    + ",\n"
    + DELIVERY_CTE.strip()
    + ",\n"
    + PRICE_TABLE_CTE.strip()
    + ",\n"
    + NAGAD_CTE.strip()
    + f""",
margin_joined AS (
SELECT u.shop_name, u.campaign_date, p.corporate_submitted, p.corporate_approved, p.corporate_paid,
  p.corporate_due, q.order_item, q.total_quantity, q.processing_quantity, q.picked_quantity,
  q.delivered_and_shipped_quantity, q.refunded_quantity, q.undelivered_quantity,
  e.unit_order_price, e.unit_seller_price, e.unit_mrp,
  c.mother_company, c.kam, c.bdm, c.cat_head, c.category, d.shop_item_deli_time,
  i.total_invoice, i.processing_invoice, i.picked_invoice, i.delivered_and_shipped_inv,
  i.refunded_invoice, i.undelivered_invoice,
  {div('i.refunded_invoice', 'i.total_invoice')} AS refund_ratio,
  n.nagad_discount_value
FROM unq_shop u
LEFT JOIN payments p ON {on('u', 'p', ['shop_name'])}
JOIN qty_si q ON {on('u', 'q', ['shop_name'])}
JOIN price_table e ON {on('q', 'e', SI)}
LEFT JOIN commercial c ON {on('u', 'c', ['shop_name'])}
LEFT JOIN shop_deli_time d ON {on('q', 'd', SI)}
JOIN inv_si i ON {on('q', 'i', SI)}
LEFT JOIN nagad n ON {on('q', 'n', SI)}),
margin_valued AS (
SELECT *, {values_sql('margin_joined', True)} FROM margin_joined),
margin_cost AS (
SELECT shop_name, order_item, {COST_SUM} AS cost FROM margin_valued GROUP BY shop_name, order_item),
item_report_margin AS (
SELECT v.mother_company, v.kam, v.bdm, v.category, v.cat_head, v.shop_name, v.campaign_date,
  CAST(month(v.campaign_date) AS INTEGER) AS month,
  CAST(dayofyear(v.campaign_date) // 7 + 1 AS INTEGER) AS week,
  v.order_item, v.unit_order_price, v.unit_seller_price, v.unit_mrp,
  v.total_invoice, v.processing_invoice, v.picked_invoice, v.delivered_and_shipped_inv,
  v.refunded_invoice, v.undelivered_invoice, v.refund_ratio,
  v.total_quantity, v.processing_quantity, v.picked_quantity, v.delivered_and_shipped_quantity,
  v.refunded_quantity, v.undelivered_quantity, v.total_market_value,
  v.total_seller_price, v.processing_seller_price, v.picked_seller_price,
  v.delivered_and_shipped_seller_price, v.undelivered_seller_price,
  v.total_order_value, v.processing_value, v.picked_value, v.delivered_and_shipped_value,
  v.undelivered_value, v.refund_value,
  {div('v.total_market_value - v.total_seller_price', 'v.total_market_value')} AS commission_rate,
  {div('v.total_seller_price - (v.total_order_value - v.nagad_discount_value)', 'v.total_market_value')} AS burn_rate,
  {div('v.total_market_value - (v.total_order_value - v.nagad_discount_value)', 'v.total_market_value')} AS discount_rate,
  v.commission_value, v.discount_value, v.burn_value, v.nagad_discount_value, k.cost,
  {div('k.cost', 'v.total_order_value')} AS cost_ratio,
  {div('v.shop_item_deli_time', 'v.delivered_and_shipped_inv')} AS avg_deli_time,
  v.shop_item_deli_time, v.count,
  v.corporate_submitted, v.corporate_approved, v.corporate_paid, v.corporate_due
FROM margin_valued v JOIN margin_cost k ON {on('v', 'k', SI)}
WHERE v.shop_name IS NOT NULL AND v.total_quantity IS NOT NULL AND v.total_invoice IS NOT NULL)"""
)

ORACLE_SQL["item_report_margin"] = one_query(ITEM_MARGIN_CTE, select="SELECT * FROM item_report_margin")

# ---------------------------------------------------------------------------
# Scalar functions over whole tables
# ---------------------------------------------------------------------------


def two(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR), 2, '0')"


def txt(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


ORACLE_SQL["normalize_key"] = one_query(
    select=f"SELECT {ORD}, {norm('shop_name')} AS shop_key, {norm(trunc('order_item'))} AS item_key "
    "FROM t_sales"
)
ORACLE_SQL["truncate_at_newline"] = f"SELECT doc_id, {trunc('text')} AS first_line FROM documents"
ORACLE_SQL["date_part_of_update"] = f"""
SELECT l_orderkey, l_linenumber, last_update, update_text,
  CAST(try_strptime(update_text, '%d-%m-%Y') AS DATE) AS update_date
FROM (SELECT *, regexp_replace(last_update, '(?s),.*', '', 'g') AS update_text
      FROM (SELECT l_orderkey, l_linenumber,
              {two('day(l_shipdate)')} || '-' || {two('month(l_shipdate)')} || '-' || {txt('year(l_shipdate)')}
              || ', ' || {two('l_linenumber + 3')} || ':' || {two('l_orderkey % 60')} || ' PM' AS last_update
            FROM lineitem) a) b"""
ORACLE_SQL["parse_dates"] = f"""
SELECT o_orderkey, mdy_text, dmy_text,
  CAST(coalesce(try_strptime(mdy_text, '%m-%d-%Y'), try_strptime(mdy_text, '%m/%d/%Y'),
                try_strptime(mdy_text, '%B %d, %Y')) AS DATE) AS mdy_date,
  CAST(try_strptime(dmy_text, '%d.%m.%Y') AS DATE) AS dmy_date
FROM (SELECT o_orderkey,
        CASE o_orderkey % 3
          WHEN 0 THEN {two('month(o_orderdate)')} || '-' || {two('day(o_orderdate)')} || '-' || {txt('year(o_orderdate)')}
          WHEN 1 THEN {txt('month(o_orderdate)')} || '/' || {txt('day(o_orderdate)')} || '/' || {txt('year(o_orderdate)')}
          ELSE monthname(o_orderdate) || ' ' || {txt('day(o_orderdate)')} || ', ' || {txt('year(o_orderdate)')}
        END AS mdy_text,
        {txt('day(o_orderdate)')} || '.' || {txt('month(o_orderdate)')} || '.' || {txt('year(o_orderdate)')} AS dmy_text
      FROM orders) a"""
ORACLE_SQL["calendar_parts"] = """
SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month,
  CAST(dayofyear(o_orderdate) // 7 + 1 AS INTEGER) AS week,
  CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS INTEGER) AS week_from_day1
FROM orders"""
ORACLE_SQL["refund_flag"] = one_query(select=f"SELECT {ORD}, note, {REFUND} AS refund FROM t_sales")
ORACLE_SQL["parse_amount"] = one_query(
    select="SELECT serial, "
    + ", ".join(f"TRY_CAST(replace({c}, ',', '') AS DOUBLE) AS {c}_amount"
                for c in ("submitted", "approved", "paid", "due"))
    + " FROM t_bills"
)
ORACLE_SQL["parse_number"] = one_query(
    select=f"SELECT {ORD}, order_quantity AS quantity_text, TRY_CAST(order_quantity AS DOUBLE) AS quantity "
    "FROM t_sales"
)

# ---------------------------------------------------------------------------
# Filters, grains, measures
# ---------------------------------------------------------------------------

ORACLE_SQL["paid_lines"] = one_query(select="SELECT * FROM sales")
ORACLE_SQL["catalog_margin_filter"] = one_query(
    select="SELECT * FROM product WHERE unit_mrp > 0 AND unit_seller_price > 0 AND unit_mrp > unit_seller_price"
)
ORACLE_SQL["shop_pattern_report"] = one_query(
    f"directory_t10 AS (SELECT * FROM commercial WHERE {grepl('shop_name', 'T10|Priority', True)})",
    shop_invoice_report_cte("directory_t10"),
    select="SELECT * FROM shop_invoice_report",
)
ORACLE_SQL["first_line_per_invoice"] = one_query(select="SELECT * FROM unq_sales")
ORACLE_SQL["campaign_date"] = one_query(select="SELECT * FROM unq_shop")
ORACLE_SQL["sales_with_campaign"] = one_query(
    select=f"SELECT s.* EXCLUDE (shop_name), coalesce(s.shop_name, u.shop_name) AS shop_name, u.campaign_date "
    f"FROM sales s FULL JOIN unq_shop u ON {on('s', 'u', ['shop_name'])}"
)
ORACLE_SQL["e_price"] = one_query(E_PRICE_CTE, select="SELECT * FROM e_price")
ORACLE_SQL["catalog_dedup"] = one_query(
    select="SELECT shop_name, order_item, unit_mrp, unit_seller_price FROM sales_prod "
    "QUALIFY row_number() OVER (PARTITION BY shop_name, order_item ORDER BY part_key) = 1"
)
ORACLE_SQL["catalog_fallback"] = one_query(PRICE_TABLE_CTE, select="SELECT * FROM catalog_fallback")
ORACLE_SQL["price_table"] = one_query(PRICE_TABLE_CTE, select="SELECT * FROM price_table")
ORACLE_SQL["key_uniqueness_check"] = one_query(
    PRICE_TABLE_CTE,
    select="""
SELECT 'directory' AS source, shop_name, CAST(NULL AS VARCHAR) AS order_item, count(*) AS n_rows
FROM commercial GROUP BY shop_name HAVING count(*) > 1
UNION ALL
SELECT 'catalog', shop_name, order_item, count(*) FROM product GROUP BY shop_name, order_item HAVING count(*) > 1
UNION ALL
SELECT 'override', shop_name, order_item, count(*) FROM override_prices GROUP BY shop_name, order_item
HAVING count(*) > 1
UNION ALL
SELECT 'price_table', shop_name, order_item, count(*) FROM price_table GROUP BY shop_name, order_item
HAVING count(*) > 1""",
)
ORACLE_SQL["payment_rollup"] = one_query(select="SELECT * FROM payments")
ORACLE_SQL["item_quantity_status_basic"] = one_query(
    status_ctes("iqb", "sales", SI, "basic", "order_quantity"), select="SELECT * FROM iqb"
)
ORACLE_SQL["item_quantity_status_strict"] = one_query(
    status_ctes("iqs", "sales", SI, "strict", "order_quantity"), select="SELECT * FROM iqs"
)
ORACLE_SQL["item_invoice_status"] = one_query(
    status_ctes("iis", "unq_sales", SI, "strict", None),
    select=f"SELECT *, {div('refunded_invoice', 'total_invoice')} AS refund_ratio FROM iis",
)
ORACLE_SQL["delivery_days"] = one_query(DELIVERY_CTE, select="SELECT * FROM shop_deli_time")
ORACLE_SQL["avg_delivery_time"] = one_query(AVG_DELIVERY_CTE, select="SELECT * FROM shop_delivery")
ORACLE_SQL["capped_rebate"] = one_query(PRICE_TABLE_CTE, NAGAD_CTE, select="SELECT * FROM nagad")
ORACLE_SQL["item_values"] = one_query(
    status_ctes("qty_si", "sales", SI, "strict", "order_quantity"),
    PRICE_TABLE_CTE,
    select=f"""
SELECT shop_name, order_item, unit_order_price, unit_seller_price, unit_mrp, {values_sql('z', True)}
FROM (SELECT q.*, e.unit_order_price, e.unit_seller_price, e.unit_mrp
      FROM qty_si q JOIN price_table e ON {on('q', 'e', SI)}) z""",
)
ORACLE_SQL["margin_rates"] = one_query(
    ITEM_MARGIN_CTE,
    select="SELECT shop_name, order_item, commission_rate, burn_rate, discount_rate, cost_ratio, avg_deli_time "
    "FROM item_report_margin",
)
ORACLE_SQL["item_cost_window"] = one_query(
    ITEM_BASIC_CTE,
    select="SELECT shop_name, order_item, delivered_and_shipped_seller_price, undelivered_seller_price, "
    "refund_value, cost FROM item_report_basic",
)

# ---------------------------------------------------------------------------
# Management levels: totals merged back, then per-level sums
# ---------------------------------------------------------------------------

LEVELS = {
    "mc": ["cat_head", "bdm", "kam", "mother_company", "month"],
    "kam": ["cat_head", "bdm", "kam", "month"],
    "bdm": ["cat_head", "bdm", "month"],
    "cathead": ["cat_head", "month"],
}
ALL_KEYS = LEVELS["mc"]


def _totals_ctes() -> str:
    ctes = []
    for lvl, keys in LEVELS.items():
        k = ", ".join(keys)
        ctes.append(
            f"{lvl}_tv AS (SELECT {k}, {msum('total_order_value')} AS {lvl}_total_value "
            f"FROM item_report_basic GROUP BY {k})"
        )
        ctes.append(
            f"{lvl}_dv AS (SELECT {k}, {msum('delivered_and_shipped_value')} AS {lvl}_delivered_value "
            f"FROM item_report_basic GROUP BY {k})"
        )
    joins = []
    sel = []
    for lvl, keys in LEVELS.items():
        for kind, col in (("tv", f"{lvl}_total_value"), ("dv", f"{lvl}_delivered_value")):
            joins.append(f"LEFT JOIN {lvl}_{kind} ON {on('b', f'{lvl}_{kind}', keys)}")
            sel.append(f"{lvl}_{kind}.{col}")
    ctes.append(
        "item_totals AS (SELECT b.*, " + ", ".join(sel) + " FROM item_report_basic b " + " ".join(joins) + ")"
    )
    return ",\n".join(ctes)


TOTALS_CTE = _totals_ctes()


def weighted(x: str, w: str, t: str) -> str:
    """sum(x * (w / t), na.rm = TRUE); Inf (non-zero term over a zero total) -> NULL."""
    return (
        f"CASE WHEN bool_or({x} IS NOT NULL AND {w} IS NOT NULL AND {w} <> 0 AND {x} <> 0 AND {t} = 0) "
        f"THEN NULL WHEN {msum(f'({x} * {w})')} = 0 THEN 0 "
        f"ELSE {msum(f'({x} * {w})')} / NULLIF(max({t}), 0) END"
    )


INVOICE_SUMS = [
    ("total_invoice", "total_invoice"),
    ("processing_invoice", "processing_invoice"),
    ("picked_invoice", "picked_invoice"),
    ("delivered_and_shipped_invoice", "delivered_and_shipped_inv"),
    ("refunded_invoice", "refunded_invoice"),
    ("submitted", "corporate_submitted"),
    ("approved", "corporate_approved"),
    ("paid", "corporate_paid"),
    ("due", "corporate_due"),
]
ITEM_SUMS = [
    ("revenue", "total_order_value"),
    ("delivered_and_shipped_value", "delivered_and_shipped_value"),
    ("undelivered_value", "undelivered_value"),
    ("delivered_and_shipped_seller_price", "delivered_and_shipped_seller_price"),
    ("undelivered_seller_price", "undelivered_seller_price"),
    ("cost", "cost"),
]
LEVEL_REPORT_COLUMNS = [
    "total_invoice", "processing_invoice", "picked_invoice", "delivered_and_shipped_invoice",
    "refunded_invoice", "revenue", "delivered_and_shipped_value", "undelivered_value",
    "delivered_and_shipped_seller_price", "undelivered_seller_price", "cost", "avg_commission",
    "avg_cost_ratio", "avg_refund_ratio", "avg_deli_time", "submitted", "approved", "paid", "due",
]


def invoice_level_select(lvl: str) -> str:
    keys = LEVELS[lvl]
    sums = ", ".join(f"{msum(c)} AS {n}" for n, c in INVOICE_SUMS)
    return (
        f"SELECT {', '.join(keys)}, {sums} FROM shop_invoice_report GROUP BY {', '.join(keys)}"
    )


def item_level_select(lvl: str) -> str:
    keys = LEVELS[lvl]
    sums = ", ".join(f"{msum(c)} AS {n}" for n, c in ITEM_SUMS)
    w = (
        f"{weighted('commission', 'total_order_value', f'{lvl}_total_value')} AS avg_commission, "
        f"{weighted('cost_ratio', 'total_order_value', f'{lvl}_total_value')} AS avg_cost_ratio, "
        f"{weighted('avg_deli_time', 'total_order_value', f'{lvl}_delivered_value')} AS avg_deli_time"
    )
    return f"SELECT {', '.join(keys)}, {sums}, {w} FROM item_totals GROUP BY {', '.join(keys)}"


LEVEL_BASE = [SHOP_INVOICE_REPORT_CTE, ITEM_BASIC_CTE, TOTALS_CTE]

for _lvl, _keys in LEVELS.items():
    _inv = f"{_lvl}_inv AS ({invoice_level_select(_lvl)})"
    _item = f"{_lvl}_item AS ({item_level_select(_lvl)})"
    _keysel = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in _keys)
    _cols = []
    for c in LEVEL_REPORT_COLUMNS:
        if c == "avg_refund_ratio":
            _cols.append(f"{div('a.refunded_invoice', 'a.total_invoice')} AS avg_refund_ratio")
        elif c in dict(INVOICE_SUMS):
            _cols.append(f"a.{c}")
        else:
            _cols.append(f"b.{c}")
    ORACLE_SQL[f"{_lvl}_report"] = one_query(
        *LEVEL_BASE,
        _inv,
        _item,
        select=f"SELECT {_keysel}, {', '.join(_cols)} FROM {_lvl}_inv a FULL JOIN {_lvl}_item b "
        f"ON {on('a', 'b', _keys)}",
    )

ORACLE_SQL["hierarchy_totals"] = one_query(
    ITEM_BASIC_CTE, TOTALS_CTE, select="SELECT * FROM item_totals"
)
ORACLE_SQL["weighted_rates"] = one_query(
    ITEM_BASIC_CTE,
    TOTALS_CTE,
    f"mc_item AS ({item_level_select('mc')})",
    select="SELECT cat_head, bdm, kam, mother_company, month, avg_commission, avg_cost_ratio, avg_deli_time "
    "FROM mc_item",
)


def _sets(select_for_level, measures: list[str]) -> str:
    parts = []
    for lvl, keys in LEVELS.items():
        inner = select_for_level(lvl)
        cols = []
        for k in ALL_KEYS:
            if k in keys:
                cols.append(k)
            else:
                cols.append(f"CAST(NULL AS {'INTEGER' if k == 'month' else 'VARCHAR'}) AS {k}")
        parts.append(f"SELECT '{lvl}' AS level, {', '.join(cols)}, {', '.join(measures)} FROM ({inner}) s_{lvl}")
    return "\nUNION ALL\n".join(parts)


ORACLE_SQL["invoice_rollup_sets"] = one_query(
    SHOP_INVOICE_REPORT_CTE,
    f"sets AS ({_sets(invoice_level_select, [n for n, _ in INVOICE_SUMS])})",
    select=f"SELECT *, {div('refunded_invoice', 'total_invoice')} AS avg_refund_ratio FROM sets",
)
ORACLE_SQL["item_rollup_sets"] = one_query(
    ITEM_BASIC_CTE,
    TOTALS_CTE,
    select=_sets(item_level_select, [n for n, _ in ITEM_SUMS] + ["avg_commission", "avg_cost_ratio",
                                                                "avg_deli_time"]),
)

# ---------------------------------------------------------------------------
# Campaign comparison and margin groupings
# ---------------------------------------------------------------------------

CAMPAIGNS = [
    ("T10 July 2", "for t10 july 2", "for t10 july 23"),
    ("T10 July 9", "for t10 july 9 2021", None),
    ("T10 July 16", "for t10 july 16", None),
    ("T10 July 23", "for t10 july 23", None),
    ("T10 July 30", "for t10 july 30", None),
]


def _campaign_copy(name: str, include: str, exclude: str | None) -> str:
    cond = grepl("shop_name", include)
    if exclude:
        cond += f" AND NOT {grepl('shop_name', exclude)}"
    return f"SELECT '{name}' AS campaign_name, * FROM item_report_margin WHERE {cond}"


CAMPAIGN_CTE = (
    ITEM_MARGIN_CTE
    + ",\ncampaigns AS ("
    + "\nUNION ALL\n".join(_campaign_copy(*c) for c in CAMPAIGNS)
    + ")"
)

MARGIN_SUMS = [
    ("total_invoice", "total_invoice"),
    ("processing_invoice", "processing_invoice"),
    ("picked_invoice", "picked_invoice"),
    ("delivered_and_shipped_invoice", "delivered_and_shipped_inv"),
    ("refunded_invoice", "refunded_invoice"),
    ("submitted", "corporate_submitted"),
    ("approved", "corporate_approved"),
    ("paid", "corporate_paid"),
    ("due", "corporate_due"),
    ("revenue", "total_order_value"),
    ("cost", "cost"),
    ("delivered_and_shipped_value", "delivered_and_shipped_value"),
    ("undelivered_value", "undelivered_value"),
    ("delivered_and_shipped_seller_price", "delivered_and_shipped_seller_price"),
    ("undelivered_seller_price", "undelivered_seller_price"),
    ("shop_item_deli_time", "shop_item_deli_time"),
    ("total_market_value", "total_market_value"),
    ("total_seller_price", "total_seller_price"),
    ("nagad_discount_value", "nagad_discount_value"),
]
MARGIN_OUT = [
    "total_invoice", "processing_invoice", "picked_invoice", "delivered_and_shipped_invoice",
    "refunded_invoice", "revenue", "delivered_and_shipped_value", "undelivered_value", "cost",
    "delivered_and_shipped_seller_price", "undelivered_seller_price", "total_market_value",
    "total_seller_price", "nagad_discount_value",
]
MARGIN_RATIOS = [
    f"{div('total_market_value - total_seller_price', 'total_market_value')} AS avg_commission_rate",
    f"{div('total_seller_price - (revenue - nagad_discount_value)', 'total_market_value')} AS avg_burn_rate",
    f"{div('total_market_value - (revenue - nagad_discount_value)', 'total_market_value')} AS avg_discount_rate",
    f"{div('delivered_and_shipped_seller_price', 'paid')} AS credit_performance",
    f"{div('refunded_invoice', 'total_invoice')} AS avg_refund_ratio",
    f"{div('shop_item_deli_time', 'delivered_and_shipped_invoice')} AS avg_deli_time",
    f"{div('cost', 'revenue')} AS avg_cost_ratio",
    "submitted", "approved", "paid", "due",
]

MARGIN_GROUPINGS = {
    "campaign_report": ["campaign_name"],
    "margin_by_mc": ["category", "bdm", "kam", "mother_company"],
    "margin_by_mc_month": ["category", "bdm", "kam", "mother_company", "month"],
    "margin_by_mc_week": ["category", "bdm", "kam", "mother_company", "week"],
    "margin_by_mc_campaign": ["category", "bdm", "kam", "mother_company", "campaign_name"],
    "margin_by_kam_month": ["category", "bdm", "kam", "month"],
    "margin_by_bdm_month": ["category", "bdm", "month"],
    "margin_by_category": ["category"],
    "margin_by_category_month": ["category", "month"],
    "margin_by_category_week": ["category", "week"],
    "margin_by_month": ["month"],
    "margin_overall": [],
}


def margin_sql(keys: list[str], src: str) -> str:
    k = ", ".join(keys)
    sums = ", ".join(f"{msum(c)} AS {n}" for n, c in MARGIN_SUMS)
    group = f" GROUP BY {k}" if keys else ""
    lead = f"{k}, " if keys else ""
    return (
        f"SELECT {lead}{', '.join(MARGIN_OUT)}, {', '.join(MARGIN_RATIOS)} "
        f"FROM (SELECT {lead}{sums} FROM {src}{group}) g"
    )


for _name, _keys in MARGIN_GROUPINGS.items():
    _src = "campaigns" if "campaign_name" in _keys else "item_report_margin"
    ORACLE_SQL[_name] = one_query(CAMPAIGN_CTE, select=margin_sql(_keys, _src))

_ROWS = f"WHERE {grepl('shop_name', 'for t10 july (16|30)')}"
for _name, _grouping, _table in (
    ("margin_by_mc_rows", "margin_by_mc", "item_report_margin"),
    ("campaign_report_rows", "campaign_report", "campaigns"),
):
    ORACLE_SQL[_name] = one_query(
        CAMPAIGN_CTE,
        f"found AS (SELECT * FROM {_table} {_ROWS})",
        select=margin_sql(MARGIN_GROUPINGS[_grouping], "found"),
    )

ORACLE_SQL["campaign_tag"] = one_query(CAMPAIGN_CTE, select="SELECT * FROM campaigns")
ORACLE_SQL["group_total"] = one_query(
    CAMPAIGN_CTE,
    f"total_value AS (SELECT campaign_name, {msum('total_order_value')} AS total_value "
    "FROM campaigns GROUP BY campaign_name)",
    select=f"SELECT c.*, t.total_value FROM campaigns c LEFT JOIN total_value t ON {on('c', 't', ['campaign_name'])}",
)
_PAY = ("submitted", "approved", "paid", "due")
ORACLE_SQL["campaign_report_shop_grain"] = one_query(
    CAMPAIGN_CTE,
    "body AS (SELECT campaign_name, "
    + ", ".join(f"{msum(c)} AS {n}" for n, c in MARGIN_SUMS if n not in _PAY)
    + " FROM campaigns GROUP BY campaign_name)",
    "pays AS (SELECT campaign_name, "
    + ", ".join(f"{msum('corporate_' + n)} AS {n}" for n in _PAY)
    + " FROM (SELECT DISTINCT campaign_name, shop_name, corporate_submitted, corporate_approved, "
    "corporate_paid, corporate_due FROM campaigns) d GROUP BY campaign_name)",
    "shop_grain AS (SELECT b.*, p.submitted, p.approved, p.paid, p.due FROM body b "
    f"LEFT JOIN pays p ON {on('b', 'p', ['campaign_name'])})",
    select=f"SELECT campaign_name, {', '.join(MARGIN_OUT)}, {', '.join(MARGIN_RATIOS)} FROM shop_grain",
)


# ---------------------------------------------------------------------------
# Sources and sinks: a landed-and-scanned input equals its stand-in
# ---------------------------------------------------------------------------

ORACLE_SQL["scan_orders"] = one_query(select="SELECT * FROM sales_all")
ORACLE_SQL["scan_orders_incremental"] = ORACLE_SQL["scan_orders"]
ORACLE_SQL["scan_tsv"] = one_query(
    select="SELECT shop_name, order_item, brand, part_key, unit_mrp, unit_seller_price FROM t_product"
)
ORACLE_SQL["scan_union_by_name"] = ORACLE_SQL["scan_tsv"]
ORACLE_SQL["scan_csv"] = one_query(select="SELECT * FROM t_override")
ORACLE_SQL["scan_sales_prod"] = one_query(select="SELECT * FROM t_sales_prod")
ORACLE_SQL["scan_seller_directory"] = one_query(select="SELECT * FROM t_commercial")
ORACLE_SQL["scan_bills"] = one_query(
    select="SELECT serial, shop_name, CAST(NULL AS VARCHAR) AS payment_date, "
    + ", ".join(f"TRY_CAST(replace({c}, ',', '') AS DOUBLE) AS {c}" for c in ("submitted", "approved", "paid", "due"))
    + " FROM t_bills WHERE submitted IS NOT NULL"
)
ORACLE_SQL["sink_report"] = ORACLE_SQL["item_report_basic"]
ORACLE_SQL["bdm_extract_invoice"] = one_query(
    SHOP_INVOICE_REPORT_CTE,
    select="SELECT * FROM shop_invoice_report WHERE bdm IN (SELECT n_name FROM nation)",
)
ORACLE_SQL["bdm_extract_item"] = one_query(
    ITEM_BASIC_CTE,
    select="SELECT * FROM item_report_basic WHERE bdm IN (SELECT n_name FROM nation)",
)

# The extracts carry their target's name and the date of the update (today).
for _extract in ("bdm_extract_invoice", "bdm_extract_item"):
    ORACLE_SQL[_extract] = (
        f"SELECT *, 'extract_' || bdm AS target, true AS updated_today FROM ({ORACLE_SQL[_extract]}) q"
    )

ORACLE_SQL["level_reports_sink"] = " UNION ALL BY NAME ".join(
    f"SELECT '{_lvl}' AS level, * FROM ({ORACLE_SQL[f'{_lvl}_report']}) q" for _lvl in LEVELS
)
ORACLE_SQL["campaign_report_sink"] = ORACLE_SQL["campaign_report"]
ORACLE_SQL["item_report_margin_from_files"] = ORACLE_SQL["item_report_margin"]
ORACLE_SQL["shop_invoice_report_from_files"] = ORACLE_SQL["shop_invoice_report"]
