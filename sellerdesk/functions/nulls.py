"""Null rules of the reporting pipeline, as Column expressions.

Every helper returns a plain ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen and can be used in
``select``, ``agg`` or ``where`` alike.


* N1  a sum that skips missing values is 0 over no values     -> ``na_sum``
* N2  a regex test on a missing string is False                 -> ``matches``
* N3  join keys match missing to missing                        -> ``null_safe_join``
* N6  a bucket with no rows is missing, a bucket whose values
      are all missing is 0                                      -> ``bucket_sum``
* N7/N8 a ratio with a missing part is missing; a zero
      denominator gives missing (documented divergence D17)     -> ``ratio``
* N10 a cap keeps missing values missing                        -> ``capped``
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_sum(c: Column | str) -> Column:
    """Aggregate: sum skipping nulls, 0 when nothing is summed."""
    return F.coalesce(F.sum(_col(c)), F.lit(0.0))


# Money sums are exact and so do not depend on row order or partitioning.  A
# double splits without loss into a whole number of 2^-30 and a rest that is a
# whole number of 2^-92; both are summed as integers of 38 digits and rounded to
# a double once, at the end.  The rest of a number under 2^-40 (1e-12) may have
# bits below 2^-92 (2e-28), which are rounded; what does not fit raises.
COARSE, FINE = 30, 92
COARSE_PART, FINE_PART, TIMES = "decimal(28,0)", "decimal(19,0)", "decimal(10,0)"
WHOLE = "decimal(38,0)"


def _whole(power: int) -> Column:
    return F.lit(str(1 << power)).cast(WHOLE)


def _integer(whole: Column) -> Column:
    """A whole double as a decimal, through longs: a direct cast goes by its shortest text."""
    small = F.abs(whole) < F.lit(2.0**62)
    high = F.rint(whole * F.lit(2.0**-40))
    low = whole - high * F.lit(2.0**40)
    long = high.cast("bigint").cast("decimal(19,0)") * F.lit(str(1 << 40)).cast("decimal(13,0)")
    long = (long + low.cast("bigint").cast("decimal(19,0)")).cast(COARSE_PART)
    return F.when(small, whole.cast("bigint").cast(COARSE_PART)).otherwise(long)


def exact_parts(c: Column | str, times: Column | str | None = None) -> tuple[Column, Column]:
    """The two whole numbers of a double (``times`` that number); NaN is missing."""
    v = _col(c).cast("double")
    v = F.when(~F.isnan(v), v)
    coarse = F.rint(v * F.lit(float(1 << COARSE)))
    rest = v - coarse * F.lit(2.0**-COARSE)
    fine = F.rint(rest * F.lit(2.0**COARSE) * F.lit(2.0 ** (FINE - COARSE)))
    fine, coarse = fine.cast("bigint").cast(FINE_PART), _integer(coarse)
    if times is None:
        return coarse, fine
    n = _col(times).cast(TIMES)
    return coarse * n, fine * n


def exact_total(coarse: Column, fine: Column) -> Column:
    """The double next to ``coarse * 2^-30 + fine * 2^-92``; 0 over no values.

    A total that fits is one whole number of 2^-92.  A larger one is a whole number of
    2^-31 whose last bit says whether anything lies below, which is enough to round.
    """
    coarse = F.coalesce(coarse, F.lit(0)).cast(WHOLE)
    fine = F.coalesce(fine, F.lit(0)).cast(WHOLE)
    unit = _whole(FINE - COARSE)
    near = F.try_add(F.try_multiply(coarse, unit), fine).cast("double") * F.lit(2.0**-FINE)
    far = (coarse + _div(fine, unit)) * F.lit(2) + F.signum((fine % unit).cast("double")).cast("bigint")
    return F.coalesce(near, far.cast("double") * F.lit(2.0 ** -(COARSE + 1)))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def exact_state(c: Column | str, name: str, times: Column | str | None = None) -> list[Column]:
    """Aggregates: the partial sum of a column, as two columns that ``merged_state`` adds up."""
    coarse, fine = exact_parts(c, times)
    return [F.sum(coarse).alias(f"{name}__c"), F.sum(fine).alias(f"{name}__f")]


def merged_state(name: str) -> list[Column]:
    return [F.sum(f"{name}__{x}").cast(WHOLE).alias(f"{name}__{x}") for x in "cf"]


def state_total(name: str) -> Column:
    return exact_total(F.col(f"{name}__c"), F.col(f"{name}__f"))


def money_sum(c: Column | str, times: Column | str | None = None) -> Column:
    """Aggregate: exact sum of a money column, 0 over no values.

    ``times`` weights each row by a count of identical rows it stands for:
    ``n * v`` equals ``v`` summed n times exactly, so rows can be pre-aggregated
    before a join without changing the result.  NaN is skipped, as the
    reference's ``na.rm`` skips it; infinite values and overflow raise.
    """
    coarse, fine = exact_parts(c, times)
    return exact_total(F.sum(coarse), F.sum(fine))


LOW = 31  # bits of a long that are summed apart, so that 2^32 rows fit


def line_sum(c: Column | str) -> Column:
    """Aggregate: ``money_sum`` over many rows: the same parts, summed as halves of longs.

    Adding longs costs a fraction of adding decimals; only a number whose coarse part
    exceeds a long (2^32 and more) is summed as a decimal.
    """
    v = _col(c).cast("double")
    v = F.when(~F.isnan(v), v)
    coarse = F.rint(v * F.lit(float(1 << COARSE)))
    rest = v - coarse * F.lit(2.0**-COARSE)
    fine = F.rint(rest * F.lit(2.0**COARSE) * F.lit(2.0 ** (FINE - COARSE))).cast("bigint")
    small = F.abs(coarse) < F.lit(2.0**62)
    large = F.coalesce(F.sum(F.when(~small, _integer(coarse))), F.lit(0))
    return exact_total(_halves(F.when(small, coarse.cast("bigint"))) + large.cast(WHOLE), _halves(fine))


def _halves(whole: Column) -> Column:
    """Aggregate: sum of longs as a decimal; 0 over no values."""
    high, low = F.sum(F.shiftright(whole, LOW)), F.sum(whole.bitwiseAND(F.lit((1 << LOW) - 1)))
    high = F.coalesce(high, F.lit(0)).cast("decimal(19,0)") * F.lit(str(1 << LOW)).cast("decimal(10,0)")
    return (high + F.coalesce(low, F.lit(0)).cast("decimal(19,0)")).cast("decimal(37,0)")


def count_where(cond: Column) -> Column:
    """Aggregate: number of rows where ``cond`` is true, as double."""
    return F.count_if(F.coalesce(cond, F.lit(False))).cast("double")


def bucket_count(cond: Column) -> Column:
    """Aggregate: rows in the bucket, or null when the bucket is empty.

    The reference counts each bucket separately and outer-joins the
    results, so a key with no rows in a bucket gets a missing value (N6).
    """
    n = count_where(cond)
    return F.when(n > 0, n)


def bucket_sum(cond: Column, value: Column | str) -> Column:
    """Aggregate: ``sum(value)`` over the rows where ``cond`` holds.

    Missing when no row satisfies ``cond``; 0 when rows exist but every
    value is missing.  A plain conditional sum would give null for the
    second case.
    """
    hit = F.coalesce(cond, F.lit(False))
    return F.when(
        F.count_if(hit) > 0,
        F.coalesce(F.sum(F.when(hit, _col(value))), F.lit(0.0)),
    )


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den``; missing when either side is missing or ``den`` is 0.

    The reference yields Inf or NaN for a zero denominator; Spark under ANSI
    would raise.  ``try_divide`` gives null (decision D17).
    """
    return F.try_divide(_col(num), _col(den))


def matches(c: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    """Regex find, false for a missing string.

    ``rlike`` returns null on null input and ``~null`` drops the row in a
    filter, whereas the reference's negated match keeps it.
    """
    p = f"(?i){pattern}" if ignore_case else pattern
    return F.coalesce(_col(c).rlike(p), F.lit(False))


def capped(value: Column | str, cap: float) -> Column:
    """``min(value, cap)`` that keeps a missing value missing.

    ``least(null, cap)`` would return ``cap``.
    """
    v = _col(value)
    return F.when(v > F.lit(cap), F.lit(float(cap))).otherwise(v)


def weighted_share(x: Column, w: Column, den: Column) -> Column:
    """Aggregate: the reference's ``sum(x * (w / den), na.rm = TRUE)``.

    ``den`` is a group total, constant in the group, so it factors out of
    the sum: ``sum(x * w) / den``.  That removes the merge-back of the
    totals.  A group with no usable term gives 0 (N1).  A zero (or
    missing) denominator with a non-zero term gives Inf in the reference
    and null here (D17); a zero term over a zero denominator is NaN there
    and dropped, so only non-zero terms count.
    """
    return share_of(live_terms(x, w), money_sum(x * w), den)


def live_terms(x: Column, w: Column) -> Column:
    """Aggregate: the terms of a weighted share that are not zero."""
    return F.count_if((x * w).isNotNull() & (w != F.lit(0.0)) & (x != F.lit(0.0)))


def share_of(live: Column, total: Column, den: Column) -> Column:
    return F.when(live == 0, F.lit(0.0)).otherwise(F.try_divide(total, den))


# Stands for a missing shop or item inside a plan (keys never hold a NUL), so
# that aggregations, windows and joins on the keys share one partitioning: a
# null-safe join has to shuffle by its own form of the key.
NO_KEY = "\0"
KEYS = ("shop_name", "order_item")


def with_keys(df: DataFrame) -> DataFrame:
    """Missing shop and item keys as ``NO_KEY``; the columns are then not nullable."""
    found = [k for k in KEYS if k in df.columns]
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(NO_KEY)) for k in found})


def without_keys(df: DataFrame) -> DataFrame:
    """``NO_KEY`` back to missing."""
    found = [k for k in KEYS if k in df.columns]
    return df.withColumns({k: F.nullif(F.col(k), F.lit(NO_KEY)) for k in found})


def _never_null(df: DataFrame, keys: Sequence[str]) -> bool:
    return not any(df.schema[k].nullable for k in keys)


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on ``keys`` where null matches null.

    Output has one column per key, like ``join(on=keys)``.  Spark rewrites
    the null-safe equality into a hashable key pair, so the join still
    plans as a broadcast or sort-merge equi-join.  Where neither side's keys
    can be null (``with_keys``) it is a plain equi-join, which needs no shuffle
    on sides that are aggregated by the keys.
    """
    if _never_null(left, keys) and _never_null(right, keys):
        return left.join(right, list(keys), how)
    renamed = {k: f"__r_{k}" for k in keys}
    r = right.withColumnsRenamed(renamed)
    cond = [left[k].eqNullSafe(r[renamed[k]]) for k in keys]
    joined = left.join(r, on=cond, how=how)
    if how in ("left_semi", "leftsemi", "semi", "left_anti", "leftanti", "anti"):
        return joined
    # Resolve by name after the join: the right keys are renamed, so every
    # name is unique even when both sides come from the same table.
    if how in ("full", "full_outer", "outer", "fullouter"):
        key_cols = [F.coalesce(F.col(k), F.col(renamed[k])).alias(k) for k in keys]
    elif how in ("right", "right_outer", "rightouter"):
        key_cols = [F.col(renamed[k]).alias(k) for k in keys]
    else:
        key_cols = [F.col(k) for k in keys]
    rest = [F.col(c) for c in left.columns if c not in keys]
    rest += [F.col(c) for c in r.columns if c not in renamed.values()]
    return joined.select(*key_cols, *rest)


SALTS = 16


def salted_join(
    left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join rows of ``left`` with those of ``right`` by a key that may be hot on the left.

    The key gets a salt from the column ``spread``, and the right side, a row or
    few per key, is there once per salt, so a key's rows are dealt to ``salts`` tasks
    whatever their number.  Neither side's key may be missing (``with_keys``).
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    every = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    joined = left.withColumn("__salt", salt).join(right.withColumn("__salt", every), [key, "__salt"], how)
    return joined.drop("__salt")
