"""Layer 1: scalar and null-rule operators on literal frames."""

import math
import datetime as dt

import pytest

from pyspark.sql import functions as F

from sellerdesk.functions import dates, nulls, text


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


def test_truncate_at_newline_drops_cr_and_everything_after_lf(spark):
    assert one(spark, text.truncate_at_newline("x"), "a\nb\rc") == "a"
    assert one(spark, text.truncate_at_newline("x"), "a\rb") == "ab"
    assert one(spark, text.truncate_at_newline("x"), None) is None


def test_squish_collapses_unicode_whitespace(spark):
    assert one(spark, text.squish("x"), "  a  b \t c  ") == "a b c"
    assert one(spark, text.normalize_key("x"), "  Shop NAME ") == "shop name"


def test_item_key_cuts_then_squishes(spark):
    assert one(spark, text.item_key("x"), "  BLUE  Gear\nsize 5") == "blue gear"


def test_date_part_and_amounts(spark):
    assert one(spark, text.date_part_of_update("x"), "02-07-2021, 10:15 PM") == "02-07-2021"
    assert one(spark, text.parse_amount("x"), "12,345") == 12345.0
    assert one(spark, text.parse_amount("x"), "n/a") is None
    assert one(spark, text.parse_number("x"), "n/a") is None
    assert one(spark, text.parse_number("x"), "7") == 7.0


def test_parse_dates_month_and_day_first(spark):
    d = dt.date(2021, 7, 2)
    for s in ("07-02-2021", "7/2/2021", "July 2, 2021"):
        assert one(spark, dates.parse_mdy("x"), s) == d
    for s in ("02-07-2021", "2.7.2021", "2 July 2021"):
        assert one(spark, dates.parse_dmy("x"), s) == d
    assert one(spark, dates.parse_mdy("x"), "13-40-2021") is None
    assert one(spark, dates.parse_mdy("x"), "garbage") is None


def test_week_rule_6_and_7_january(spark):
    schema = "x date"
    wk = dates.week_of("x")
    assert one(spark, wk, dt.date(2021, 1, 6), schema) == 1
    assert one(spark, wk, dt.date(2021, 1, 7), schema) == 2
    alt = dates.week_of("x", "yday_minus1_div7")
    assert one(spark, alt, dt.date(2021, 1, 7), schema) == 1
    assert one(spark, alt, dt.date(2021, 1, 8), schema) == 2


def test_matches_is_false_on_null_so_negation_keeps_row(spark):
    df = spark.createDataFrame([("Refund issued",), (None,), ("ok",)], "note string")
    kept = df.where(~nulls.matches("note", "refund", ignore_case=True)).count()
    assert kept == 2  # the null note counts as 'not a refund' (N2)


def test_capped_keeps_null(spark):
    df = spark.createDataFrame([(3000.0,), (None,), (10.0,)], "v double")
    got = [r.c for r in df.select(nulls.capped("v", 2000.0).alias("c")).collect()]
    assert got == [2000.0, None, 10.0]
    # least() would have turned the null into the cap
    assert df.select(F.least("v", F.lit(2000.0)).alias("c")).collect()[1].c == 2000.0


def test_ratio_zero_and_null_denominators(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (None, 2.0), (4.0, 2.0)], "a double, b double")
    got = [r.r for r in df.select(nulls.ratio("a", "b").alias("r")).collect()]
    assert got == [None, None, None, 2.0]


def test_bucket_sum_distinguishes_empty_bucket_from_null_values(spark):
    df = spark.createDataFrame(
        [("k1", "picked", None), ("k1", "picked", None), ("k1", "shipped", 3.0), ("k2", "shipped", 1.0)],
        "k string, s string, q double",
    )
    out = {
        r.k: r.picked
        for r in df.groupBy("k").agg(nulls.bucket_sum(F.col("s") == "picked", "q").alias("picked")).collect()
    }
    assert out == {"k1": 0.0, "k2": None}  # N6


def test_na_sum_and_money_sum_are_zero_over_nothing(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "k string, v double")
    r = df.groupBy("k").agg(nulls.na_sum("v").alias("s"), nulls.money_sum("v").alias("m")).first()
    assert r.s == 0.0 and r.m == 0.0


def test_money_sum_is_exact_in_any_order(spark):
    vals = [(0.1,), (0.2,), (0.3,)] * 1000
    a = spark.createDataFrame(vals, "v double").repartition(7)
    b = spark.createDataFrame(list(reversed(vals)), "v double").coalesce(1)
    sa = a.agg(nulls.money_sum("v").alias("s")).first().s
    sb = b.agg(nulls.money_sum("v").alias("s")).first().s
    assert sa == sb == 600.0


def test_weighted_share_rules(spark):
    rows = [
        ("g1", 0.5, 10.0), ("g1", 0.25, 30.0), ("g1", None, 5.0),   # plain
        ("g2", None, 1.0),                                          # no usable term -> 0
        ("g3", 0.5, 0.0),                                           # zero weight only -> 0
    ]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    out = {
        r.g: r.s
        for r in df.groupBy("g")
        .agg(nulls.weighted_share(F.col("x"), F.col("w"), F.sum("w")).alias("s"))
        .collect()
    }
    assert abs(out["g1"] - (0.5 * 10 + 0.25 * 30) / 45.0) < 1e-12
    assert out["g2"] == 0.0 and out["g3"] == 0.0
    # zero denominator with a non-zero term: Inf in the original, null here
    z = spark.createDataFrame([("g", 2.0, 5.0)], "g string, x double, w double")
    r = z.groupBy("g").agg(nulls.weighted_share(F.col("x"), F.col("w"), F.lit(0.0)).alias("s")).first()
    assert r.s is None


def test_null_safe_join_matches_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, b int")
    inner = nulls.null_safe_join(a, b, ["k"], "inner").collect()
    assert [(r.k, r.a, r.b) for r in inner] == [(None, 1, 10)]
    full = {(r.k, r.a, r.b) for r in nulls.null_safe_join(a, b, ["k"], "full").collect()}
    assert full == {(None, 1, 10), ("x", 2, None), ("y", None, 20)}


def test_dates_in_many_spellings(spark):
    from sellerdesk.functions.dates import parse_dmy, parse_mdy

    mdy = ["07-02-21", "7/2/2021", "Jul 2 2021", "July 2, 2021", "07022021", "070221", "7.2.21", "Jul-02-21"]
    dmy = ["02-07-21", "2/7/2021", "2-Jul-2021", "2 July, 2021", "02072021", "020721", "2.7.21", "2Jul21"]
    df = spark.createDataFrame(list(zip(mdy, dmy)), "m string, d string")
    rows = df.select(parse_mdy("m").alias("m"), parse_dmy("d").alias("d"), "m", "d").collect()
    assert [str(r[0]) for r in rows] == ["2021-07-02"] * 8
    assert [str(r[1]) for r in rows] == ["2021-07-02"] * 8
    odd = spark.createDataFrame([("31-12-69",), ("13-13-21",), ("soon",), ("",), (None,)], "d string")
    got = [r[0] and str(r[0]) for r in odd.select(parse_dmy("d")).collect()]
    assert got == ["1969-12-31", None, None, None, None]


def test_money_sum_keeps_small_fractions_and_raises_on_overflow(spark):
    small = spark.createDataFrame([(0.00004,)] * 3 + [(float("nan"),), (None,)], "v double")
    assert small.agg(nulls.money_sum("v")).first()[0] == math.fsum([0.00004] * 3)  # no decimal cut
    with pytest.raises(Exception):
        spark.createDataFrame([(1e35,), (5.0,)], "v double").agg(nulls.money_sum("v")).collect()


def test_money_sums_are_exact(spark):
    """The double next to the exact sum, for terms from 1e-12 to 1e14 and any partitioning."""
    import random
    from fractions import Fraction

    r = random.Random(1)
    rows = [(900, 1e12, 1), (900, 1e-12, 1), (900, -1e12, 1), (901, float("nan"), 1), (902, None, 1)]
    rows += [(903, 1e17, 3), (903, 0.1, 1), (904, 1e-12, 1), (904, 2e-12, 1), (905, 2.0**53, 1), (905, 1.0, 1)]
    for g in range(150):
        size = 10.0 ** r.choice([-5, -3, 0, 5, 9, 14])
        rows += [(g, r.choice([-1, 1, 1]) * (0.01 + r.random()) * size, r.randint(1, 5)) for _ in range(r.choice([1, 7, 90]))]
    sums = [nulls.money_sum("v").alias("a"), nulls.money_sum("v", times="n").alias("b")]
    found = []
    for n in (1, 7):
        df = spark.createDataFrame(rows, "g int, v double, n int").repartition(n)
        found.append({x.g: (x.a, x.b) for x in df.groupBy("g").agg(*sums).collect()})
    assert found[0] == found[1]
    for g, got in found[0].items():
        own = [(Fraction(v), n) for h, v, n in rows if h == g and v is not None and v == v]
        assert got == (float(sum(v for v, _ in own)), float(sum(v * n for v, n in own))), g
    assert found[0][900] == (1e-12, 1e-12) and found[0][901] == found[0][902] == (0.0, 0.0)


def test_states_merge_to_the_same_sum(spark):
    df = spark.range(5000).selectExpr("id % 40 as g", "id % 4 as h", "pow(10, id % 17 - 8) * (id - 2000) / 7 as v")
    states = df.groupBy("g", "h").agg(*nulls.exact_state("v", "s"))
    merged = states.groupBy("h").agg(*nulls.merged_state("s")).select("h", nulls.state_total("s").alias("s"))
    direct = df.groupBy("h").agg(nulls.money_sum("v").alias("s"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, direct.collect()))
