"""What moves, what is sorted and what is written, on rows made here."""

import glob
import os
import re

from pyspark.sql import functions as F

from sellerdesk.functions.dates import parse_dmy, parse_mdy
from sellerdesk.functions.nulls import line_sum, money_sum
from sellerdesk.functions.text import WHITESPACE_CLASS, squish, truncate_at_newline
from sellerdesk.operators import facts, grains, pricing
from sellerdesk.plans import inputs as plan_inputs
from sellerdesk.plans import reports
from sellerdesk.plans.catalog import QUERIES
from sellerdesk.plans.inputs import Inputs, inputs
from sellerdesk.plans.reports import Reporting
from sellerdesk.sources import files, fixtures, landing, sinks
from sellerdesk.sources.fixtures import RawInputs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def above(lines, name):
    """The operators over the first ``name`` of a plan."""

    def depth(line):
        return re.search(r"[A-Za-z*]", line).start()

    at = next(i for i, x in enumerate(lines) if name in x)
    found, d = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < d:
            found.append(x)
            d = depth(x)
    return found


def test_names_are_cleaned_as_by_the_pattern_alone(spark):
    names = ["a b", "  a", "a  b ", "a\tb", "a b", " x", "é  b", "", " ", "a\x0bb\r", None, "x\ry\nz", "\n", "a\nb\rc"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    slow = F.trim(F.regexp_replace("v", WHITESPACE_CLASS + "+", " "))
    cut = F.regexp_replace("v", r"(?s)\r|\n.*", "")
    for r in df.select(squish("v").alias("a"), slow.alias("b"), truncate_at_newline("v").alias("c"), cut.alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d)
    plan = df.select(truncate_at_newline("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_a_table_that_fills_the_cores_is_not_dealt_again(spark, tmp_folder):
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).repartition(cores * 2).write.parquet(f"{tmp_folder}/many")
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_folder}/one")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "2m")  # a file a task
    try:
        many = fixtures.spread(spark.read.parquet(f"{tmp_folder}/many"), "id")
        assert not any("Exchange" in x for x in executed(many))
        one = fixtures.spread(spark.read.parquet(f"{tmp_folder}/one"), "id")
        assert any("Exchange" in x for x in executed(one)) and one.count() == 1000
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_pairs_move_two_keys_and_stay_distinct(spark):
    raw = RawInputs(spark, "unused")
    tables = {
        "supplier": spark.createDataFrame([(1, 0, "S")] * 2 + [(2, 0, "T"), (None, 0, "U")], "s_suppkey long, s_nationkey int, s_name string"),
        "part": spark.createDataFrame([(5, "p", "b", 1, 1.5)] * 2 + [(5, "q", "b", 1, 1.5)], "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double"),
        "lineitem": spark.createDataFrame([(1, 1, 5), (2, 1, 5), (3, 2, 5), (4, None, 5), (5, 2, 9)], "l_orderkey long, l_suppkey long, l_partkey long"),
    }
    raw._tables = tables
    raw.__dict__["lines"] = tables["lineitem"]
    rows = sorted((r.s_suppkey, r.p_name, r.mrp_cents) for r in raw.pairs.collect())
    assert rows == [(1, "p", 150), (1, "q", 150), (2, "p", 150), (2, "q", 150)]
    plan = RawInputs(spark, SF).pairs._jdf.queryExecution().optimizedPlan().toString()
    deduplicated = [re.search(r"Aggregate \[(.*?)\]", x)[1] for x in plan.splitlines() if "Aggregate [" in x]
    assert any(re.fullmatch(r"l_\w+#\w+, l_\w+#\w+", x) for x in deduplicated)
    assert not any("shop_name" in x and "p_brand" in x for x in deduplicated)


def test_campaign_dates_sort_nothing(spark):
    rows = [("a", "2021-07-03"), ("a", "2021-07-02"), ("b", None), ("b", "2021-07-01")]
    unq = spark.createDataFrame(rows, "shop_name string, d string").select("shop_name", F.col("d").cast("date").alias("order_date"))
    dates = grains.campaign_dates(unq)
    assert {r.shop_name: str(r.campaign_date) for r in dates.collect()} == {"a": "2021-07-02", "b": "None"}
    assert not any("Sort" in x or "Window" in x for x in executed(dates))


def test_basic_report_rows_are_not_moved(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        over = above(executed(Reporting(inputs(spark, SF)).item_report_basic), "Window")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert any("Join" in x for x in over) and not any("Exchange" in x for x in over)


def test_line_sum_is_money_sum(spark):
    values = [0.1, -0.1, 1e-9, 123456789.12, 5e9, -7e12, 2.0**52 + 1, 1e18, -1e18, float("nan"), None, 3e-20, -2.5]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values * 7)] + [(9, None)], "g int, v double")
    for r in df.groupBy("g").agg(line_sum("v").alias("a"), money_sum("v").alias("b")).collect():
        assert r.a == r.b


def test_payments_add_no_decimals_a_line(spark):
    r = Reporting(inputs(spark, SF, staged=False), stage_first=False)
    partial = next(x for x in reversed(executed(r.payments)) if "partial_sum" in x)
    assert "shiftright" in partial


def test_only_the_top_of_a_split_is_kept(spark, tmp_folder):
    for f in ("a", "b"):
        with open(f"{tmp_folder}/{f}.csv", "w") as out:
            out.writelines(f"{f}{i}\n" for i in range(500))
    lines = spark.read.text(tmp_folder).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("i"),
        "value",
    )
    heads = files.split_heads(lines)
    assert {r.value for r in heads.collect()} == {f"{f}{i}" for f in "ab" for i in range(files.TOP_ROWS)}
    assert not any("Sort" in x for x in executed(heads))


def test_order_exports_land_drop_by_drop_from_one_join(spark, tmp_folder, monkeypatch):
    staged = []
    real = landing.stage
    monkeypatch.setattr(landing, "stage", lambda df, name: staged.append(name) or real(df, name))
    raw = fixtures.RawInputs(spark, SF)
    drops = landing.drop_orders(raw, tmp_folder, layouts=1)
    assert next(drops).endswith("drop_1") and not os.path.exists(f"{tmp_folder}/drop_2")
    assert next(drops).endswith("drop_2") and staged == ["order_export"]
    assert glob.glob(f"{tmp_folder}/drop_*/*.csv.gz") and not glob.glob(f"{tmp_folder}/drop_*/*.csv")
    keys = {c: c for c in fixtures.ORDER_KEY if c != "order_date"}
    assert files.scan_orders(spark, tmp_folder, keys).count() == raw.sales.count()


def test_reports_may_be_written_compressed(spark, tmp_folder):
    df = spark.createDataFrame([("a", 1.5), (None, None)], "s string, x double")
    sinks.write_report(df, f"{tmp_folder}/r", compression="gzip")
    assert glob.glob(f"{tmp_folder}/r/*.csv.gz")
    back = files.scan_csv(spark, f"{tmp_folder}/r", df.schema, null_value=sinks.REPORT_NULL)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_runs_of_spaces_collapse_whatever_their_length(spark):
    names = [f"{' ' * i}a{' ' * i}b{' ' * j}c{' ' * j}" for i in range(1, 12) for j in (1, 2, 7)]
    names += [" " * i for i in range(12)] + ["a \x01 b", "a \x7f  b", "é   b", "a  \t  b", "a    　 b", None]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    slow = F.trim(F.regexp_replace("v", WHITESPACE_CLASS + "+", " "))
    for r in df.select(squish("v").alias("a"), slow.alias("b")).collect():
        assert r.a == r.b


def test_report_inputs_join_by_hash(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], "-1")
    spark.conf.set(keys[1], "0")
    try:
        lines = Reporting(inputs(spark, SF, staged=False)).inp.sales
        assert lines.collect()
        final = "\n".join(executed(lines)).split("== Initial Plan ==")[0]
        assert "ShuffledHashJoin" in final
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def test_fallback_prices_sort_nothing(spark):
    prices = "shop_name string, order_item string, part_key long, unit_seller_price double, unit_mrp double"
    catalog = [("a", "x", 7, 1.0, 2.0), ("a", "x", 3, None, 4.0), ("a", "y", 5, 5.0, 6.0), ("a", "y", None, 7.0, 8.0)]
    orders = [("a", "x", 1, 9.0, 9.0), ("b", "x", 2, 10.0, 11.0), ("b", "x", -4, 12.0, None), ("b", "y", None, 13.0, 14.0)]
    found = pricing.catalog_fallback(spark.createDataFrame(catalog, prices), spark.createDataFrame(orders, prices))
    assert {tuple(r) for r in found.collect()} == {
        ("a", "x", None, 4.0),
        ("a", "y", 7.0, 8.0),
        ("b", "x", 12.0, None),
        ("b", "y", 13.0, 14.0),
    }
    assert not any("Sort" in x or "Window" in x for x in executed(found))


def test_lines_are_staged_by_order_and_pairs_dealt_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = RawInputs(spark, SF)
        last = next(x for x in executed(raw.sales) if "Join" in x)
        pairs = executed(raw.pairs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "l_orderkey" in last and "o_orderkey" in last
    dealt = [re.search(r"hashpartitioning\((.*?)\)", x)[1] for x in pairs if "hashpartitioning" in x]
    assert any(re.match(r"l_partkey#\w+, \d+$", x) for x in dealt)
    assert not any("l_suppkey" in x and "l_partkey" in x for x in dealt)


def margin_tables(spark):
    """Lines that meet in few shop-items, with orders that repeat or lack a date."""
    orders = [(o, "POF"[o % 3], None if o == 11 else f"2021-07-{1 + o % 9:02d} 00:00:00", ("1-URGENT", "5-LOW", "3-MEDIUM")[o % 3]) for o in range(1, 40)]
    orders += [(7, "O", "2021-06-30 00:00:00", "1-URGENT"), (12, "F", None, "1-URGENT"), (None, "O", None, None)]
    rows = []
    for i in range(400):
        o, flag = 1 + i * 7 % 39, "NRA"[i % 3]
        rows.append((o, 1 + i * i % 12, 1 + i * 5 % 8, 1 + i % 7, float(i % 9), 900.5 + i, i % 4 / 100, flag, "OF"[i % 2], f"2021-07-{10 + i % 20} 00:00:00"))
    rows += rows[:20] + [(3, 2, 4, None, None, None, 0.0, None, None, None), (None, 1, 1, 1, 1.0, 1.0, 0.0, "N", "O", None)]
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate string"
    tables = {
        "lineitem": spark.createDataFrame(rows, line).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")),
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderdate string, o_orderpriority string").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")),
        "part": spark.createDataFrame([(p, f"Part  {p % 3}", "B", p, 10.0 + p) for p in range(1, 13)], "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double"),
        "supplier": spark.createDataFrame([(s, s % 2, f"S {s % 3}") for s in range(1, 9)], "s_suppkey long, s_nationkey int, s_name string"),
        "nation": spark.createDataFrame([(0, "N", 0), (1, "M", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string"),
    }
    raw = RawInputs(spark, "unused")
    raw._tables = tables
    raw.__dict__["lines"] = tables["lineitem"]
    return raw


def test_margin_report_aggregates_the_lines_once(spark, monkeypatch):
    names = []
    real = reports.stage
    monkeypatch.setattr(reports, "stage", lambda df, name: names.append((name, df)) or real(df, name))
    monkeypatch.setattr(plan_inputs, "stage", lambda df, name: names.append((name, df)) or real(df, name))
    raw = margin_tables(spark)
    now = Reporting(Inputs(raw, staged=True)).item_report_margin.collect()
    staged = dict(names)
    assert set(staged) == {"shop_item_lines", "price_table"}
    before = Reporting(Inputs(raw, staged=False), stage_first=False).item_report_margin.collect()
    assert len(now) > 5 and sorted(map(repr, now)) == sorted(map(repr, before))
    plan = executed(staged["shop_item_lines"])
    assert any("HashAggregate" in x for x in plan) and not any("SortAggregate" in x for x in plan)
    # Sorted by the order only, for the place in it; never by shop or item.
    assert not any("Sort" in x and "shop_name" in x for x in plan)


def test_lines_keep_the_partitioning_of_their_orders(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed(grains.place_in_invoice(inputs(spark, SF).order_lines, "o_key"))
        over = above([x for x in plan if re.match(r"[ :+-]*[A-Z]\w+", x)], "Join")  # patterns hold line breaks
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert any("Window" in x for x in over) and not any("Exchange" in x for x in over)


def test_places_are_in_file_order(spark):
    days = ("0001-01-01", "2021-07-01", "9999-12-31", None)
    keys = (1 - (1 << 63), -(10**12), -9 * 10**9 - 1, -9 * 10**9, -1, 0, 5, 9 * 10**9, 9 * 10**9 + 1, (1 << 63) - 1, None)
    rows = [(d, o, p) for d in days for o in keys for p in (1, 2, 10**6)]
    df = spark.createDataFrame(rows, "d string, o_key long, place int").withColumn("order_date", F.col("d").cast("date"))
    got = df.select("d", "o_key", "place", facts.file_place().alias("at")).collect()
    order = sorted(got, key=lambda r: (r.d or "", -(1 << 63) if r.o_key is None else r.o_key, r.place))
    assert [r.at for r in order] == sorted(r.at for r in got) and len({r.at for r in got}) == len(rows)


def test_plain_names_are_told_apart_without_a_pattern(spark):
    plan = spark.range(1).select(squish(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert "RLIKE" not in plan and "octet_length" in plan


def staged_names(monkeypatch):
    names = []
    real = reports.stage
    for module in (reports, plan_inputs):
        monkeypatch.setattr(module, "stage", lambda df, name: names.append(name) or real(df, name))
    return names


def test_campaign_dates_meet_lines_that_stay(spark, monkeypatch):
    raw = margin_tables(spark)
    want = Reporting(Inputs(raw, staged=False)).sales_with_campaign
    names = staged_names(monkeypatch)
    now = Reporting(Inputs(raw, staged=True)).sales_with_campaign
    assert names == ["order_lines", "campaign_dates"]  # joined once, places taken as they lie
    assert now.columns == want.columns
    rows = sorted(map(repr, now.collect()))
    assert len(rows) > 100 and rows == sorted(map(repr, want.collect()))
    assert not any("Exchange hashpartitioning" in x for x in executed(now))
    monkeypatch.setattr(grains, "BROADCAST_MB", 0)  # too many shops: neither they nor their copies
    dealt = Reporting(Inputs(raw, staged=True)).sales_with_campaign
    assert any("SortMergeJoin" in x for x in executed(dealt))
    assert not any("Broadcast" in x for x in executed(dealt)) and rows == sorted(map(repr, dealt.collect()))


def test_basic_reports_aggregate_the_lines_once(spark, monkeypatch):
    raw = margin_tables(spark)
    before = Reporting(Inputs(raw, staged=False), stage_first=False)
    want = [sorted(map(repr, df.collect())) for df in (before.item_report_basic, before.shop_invoice_report)]
    names = staged_names(monkeypatch)
    now = Reporting(Inputs(raw, staged=True))
    got = [sorted(map(repr, df.collect())) for df in (now.item_report_basic, now.shop_invoice_report)]
    assert names == ["shop_item_lines"]
    assert got == want and len(want[0]) > 5 and len(want[1]) > 1


def test_totals_join_report_rows_that_stay(spark):
    plan = executed(QUERIES["hierarchy_totals"](spark, SF))
    assert any("BroadcastHashJoin" in x for x in plan)
    assert not any("Exchange hashpartitioning" in x for x in plan)


def test_used_shuffles_of_reports_are_dropped(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(key, "false")
    Reporting(inputs(spark, SF, staged=False))
    assert spark.conf.get(key) == "true"


def test_dates_spell_their_patterns_out_once(spark):
    texts = ["07-09-2021", "13-01-2021", "02-30-2021", "00-00-0000", "07-09-0000", "07-09-21", "7-9-2021", "July 9, 2021", "9July2021", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(parse_mdy("t").cast("string").alias("m"), parse_dmy("t").cast("string").alias("d")).collect()
    other = df.select(  # with another separator no text is taken apart by place
        parse_mdy(F.replace("t", F.lit("-"), F.lit("/"))).cast("string").alias("m"),
        parse_dmy(F.replace("t", F.lit("-"), F.lit("/"))).cast("string").alias("d"),
    ).collect()
    assert got == other and (got[0].m, got[0].d, got[1].m, got[1].d) == ("2021-07-09", "2021-09-07", None, "2021-01-13")
    plan = df.select(parse_mdy("t").alias("d"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert len(re.findall(r"regexp_|rlike", plan)) <= 8  # 68 where each use spelt them out


def test_header_rows_are_told_by_one_field_first(spark):
    rows = [("Shop", "a"), (None, None), (" Shop ", "a"), ("\ufeffShop", "a"), ("Shop", "b"), ("x", "a")]
    df = spark.createDataFrame(rows, "c0 string, c1 string")
    kept = df.where(~files._is_row(["c0", "c1"], ["Shop", "a"])).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, None), ("Shop", "b"), ("x", "a")], key=str)
    blank = df.where(~files._is_row(["c0", "c1"], ["", ""])).count()
    assert blank == 5


def test_tops_of_small_files_are_found_in_one_look(spark, tmp_folder, monkeypatch):
    def look(n):
        for k in range(12):
            with open(f"{tmp_folder}/f{k:02d}.csv", "w") as out:
                out.write("title\n" * (k % 3 == 2) + ("b,a\n" if k % 2 else "a,b\n"))
                out.writelines(f"{i},{k}\n" for i in range(k * 20))
        found = files.file_layouts(spark, tmp_folder, ["a", "b"], ",", None)
        return sorted((x.header, x.above, len(f)) for x, f in found.items())

    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionNum", "2")  # files may share a task
    try:
        want = look(2)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionNum")

    def refused(lines):
        raise AssertionError("looked twice")

    monkeypatch.setattr(files, "split_heads", refused)
    assert look(1) == want == [(("a", "b"), 0, 4), (("a", "b"), 1, 2), (("b", "a"), 0, 4), (("b", "a"), 1, 2)]
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost


def test_reports_leave_no_method_to_the_interpreter(spark):
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    Reporting(inputs(spark, SF, staged=False))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
