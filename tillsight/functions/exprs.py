"""Column-expression helpers.  All return JVM-side ``Column`` objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "clip", "round_half_up", "nan_to_null", "safe_div", "whole_days", "month_start", "is_numeric_type",
    "to_ntz", "to_number", "id_text", "finite_or_zero", "cols_exist",
]

MICROS_PER_DAY = 86_400_000_000


def clip(c: Column, lo=None, hi=None) -> Column:
    """numpy.clip for one column (null stays null); bounds may be numbers or Columns."""
    out = c
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    # greatest/least skip nulls, so restore a null input explicitly
    return F.when(c.isNotNull(), out)


def round_half_up(c: Column, digits: int = 6, significant: int = 12) -> Column:
    """Round on the binary value, floor(x * 10^d + 0.5) / 10^d, with d = ``digits``
    but at most ``significant`` digits overall (decided by exact comparisons).
    The SQL oracle applies the same formula, so equal inputs give equal outputs."""
    a = F.abs(c)
    out = c
    expr = None
    for d in range(digits, -1, -1):
        bound = float(10 ** (significant - d))
        scale = float(10 ** d)
        r = F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
        expr = F.when(a < F.lit(bound), r) if expr is None else expr.when(a < F.lit(bound), r)
    return expr.otherwise(out)


def nan_to_null(c: Column) -> Column:
    """pandas treats NaN as missing; Spark treats it as a value larger than all numbers."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def finite_or_zero(c: Column) -> Column:
    """Infinities, NaN and null to 0.0 (the reference's feature sanitising)."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(0.0)).otherwise(d)


def safe_div(a: Column, b: Column) -> Column:
    """Division that yields null on a zero divisor (ANSI mode would raise)."""
    return F.try_divide(a, b)


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two TIMESTAMP_NTZ values, floored like ``Timedelta.days``.

    NTZ subtraction gives a day-time interval computed without any time zone,
    so the result does not depend on the session zone.  The interval is cast
    to whole seconds (exact for these day/second intervals) before flooring.
    """
    secs = (later - earlier).cast("interval second").cast("long")
    return F.floor(secs / F.lit(86400)).cast("long")


def month_start(ts: Column) -> Column:
    """First day of the month as DATE."""
    return F.trunc(ts.cast("date"), "month")


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def to_ntz(c: Column, dtype: T.DataType) -> Column:
    """Parse anything date-like to TIMESTAMP_NTZ; unparseable values become null.

    Instants and texts with a zone become UTC wall-clock time, whatever the session zone.
    """
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.TimestampType):
        return _utc(c)
    text = F.trim(c.cast("string"))
    instant = F.try_to_timestamp(text)
    return F.when(text.rlike(_ZONED), _utc(instant)).otherwise(instant.cast("timestamp_ntz"))


_ZONED = r"\d:\d\d(:\d\d(\.\d+)?)? ?(Z|[A-Z]{3,4}|[A-Z][A-Za-z_]+/[A-Za-z_/]+|[+-]\d{1,2}(:?\d{2})?)$"


def _utc(instant: Column) -> Column:
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)


def to_number(c: Column, dtype: T.DataType) -> Column:
    """``pd.to_numeric(errors='coerce')``: integral types stay bigint, the rest double."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(dtype, T.NumericType):
        return nan_to_null(c.cast("double"))
    return nan_to_null(F.trim(c.cast("string")).try_cast("double"))


def id_text(c: Column, dtype: T.DataType) -> Column:
    """Identifier as trimmed text; integral doubles go through bigint ("13085", not "13085.0")."""
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = c.cast("double")
        return F.when(d == F.floor(d), d.cast("long").cast("string")).otherwise(d.cast("string"))
    return F.trim(c.cast("string"))


def cols_exist(df: DataFrame, cols) -> bool:
    return all(c in df.columns for c in cols)


def combine_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Add the columns of one-row aggregate frames to ``first`` without a join:
    each other frame becomes one struct-valued scalar subquery (referenced once
    per field, executed once)."""
    cols = [F.col(c) for c in first.columns]
    for o in others:
        s = o.select(F.struct(*[F.col(c) for c in o.columns]).alias("s")).scalar()
        cols += [s.getField(c).alias(c) for c in o.columns]
    return first.select(*cols)


def ntz_literal(dt) -> Column:
    """A TIMESTAMP_NTZ literal from a naive datetime, built from its text so
    neither the Python nor the session time zone shifts it."""
    return F.lit(dt.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
