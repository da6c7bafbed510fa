"""Data-quality profiles: overview, per-column profile, before/after
comparison and the cleaning audit.  Every figure is an aggregate; each profile
reads its input once (plus one distinct pass for duplicate counts)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.functions.exprs import combine_rows
from pyspark.sql import types as T

from tillsight.functions.exprs import to_ntz, to_number
from tillsight.plans.ranking import counted_quantiles
from tillsight.session import materialize

REQUIRED = ["invoice_id", "customer_id", "invoice_date", "quantity", "unit_price"]


def _missing_cells(df: DataFrame):
    return sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group: count - distinct count."""
    return combine_rows(df.agg(F.count(F.lit(1)).alias("n")),
                        df.distinct().agg(F.count(F.lit(1)).alias("d"))).select((F.col("n") - F.col("d")).alias("duplicates"))


def profile_overview(df: DataFrame) -> DataFrame:
    """``metric, value`` rows: rows, columns, duplicate rows, missing cells."""
    a = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(_missing_cells(df)).alias("missing"))
    j = combine_rows(a, duplicate_rows(df))
    return j.selectExpr(
        f"stack(4, 'Rows', CAST(rows AS DOUBLE), 'Columns', CAST({len(df.columns)} AS DOUBLE), "
        "'Duplicate rows', CAST(duplicates AS DOUBLE), 'Missing cells', CAST(coalesce(missing, 0) AS DOUBLE)) "
        "AS (metric, value)")


def _type_name(dt: T.DataType) -> str:
    return dt.simpleString()


def value_counts_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(__g, __s, __v, __w)``: each value of each column, as text and (numeric columns) as
    a double, with its rows; nulls left out.

    One scan and one shuffle for all columns.  A row is spread into one narrow row per
    column, which the tasks count before the shuffle, so a value that a third of the rows
    hold leaves a task as one row."""
    numeric = {c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)}

    def entry(c: str):
        x = F.col(f"`{c}`")
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            x = x + F.lit(0.0)  # -0.0 is 0.0
        return F.struct(F.lit(c).alias("__g"), x.cast("string").alias("__s"),
                        (x.cast("double") if c in numeric else F.lit(None).cast("double")).alias("__v"))
    long = df.select(F.explode(F.array(*[entry(c) for c in columns])).alias("e")).select("e.*")
    return long.where(F.col("__s").isNotNull()).groupBy("__g", "__s", "__v").agg(F.count(F.lit(1)).alias("__w"))


def column_profile(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Per column: type, missing count and %, distinct count, an example value
    (the smallest, for determinism, first 80 characters), and for numeric
    columns min, max and the IQR outlier count (linear quartiles).

    One plain aggregate gives counts and ranges; distinct counts, examples, quartiles and
    outliers all come from one table of counted values.  With ``approx_distinct`` only
    numeric columns are counted by value, and distinct counts are estimated."""
    cols = df.columns
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    counted = numeric if approx_distinct else cols
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        aggs.append(F.count_if(x.isNull()).alias(f"m{i}"))
        if approx_distinct:
            aggs += [F.approx_count_distinct(x).alias(f"u{i}"), F.substring(F.min(x.cast("string")), 1, 80).alias(f"e{i}")]
        if c in numeric:
            aggs += [F.min(x).cast("double").alias(f"lo{i}"), F.max(x).cast("double").alias(f"hi{i}")]
    stats = df.agg(*aggs)
    hist = materialize(value_counts_long(df, counted)) if counted else None
    if not approx_distinct:
        per = [(F.count_if(F.col("__g") == c).alias(f"u{i}"),
                F.substring(F.min(F.when(F.col("__g") == c, F.col("__s"))), 1, 80).alias(f"e{i}")) for i, c in enumerate(cols)]
        stats = combine_rows(stats, hist.agg(*[a for pair in per for a in pair]))
    if numeric:
        values = hist.where(F.col("__v").isNotNull() & ~F.isnan("__v")).select("__g", "__v", "__w")
        q = counted_quantiles(values, {f"q1_{cols.index(c)}": (c, 0.25) for c in numeric}
                              | {f"q3_{cols.index(c)}": (c, 0.75) for c in numeric}).first()
        out_aggs = []
        for c in numeric:
            i = cols.index(c)
            q1, q3 = q[f"q1_{i}"], q[f"q3_{i}"]
            if q1 is None:
                out_aggs.append(F.lit(0).cast("long").alias(f"o{i}"))
                continue
            lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            beyond = (F.col("__g") == c) & ((F.col("__v") < F.lit(lo)) | (F.col("__v") > F.lit(hi)))
            out_aggs.append(F.coalesce(F.sum(F.when(beyond, F.col("__w"))), F.lit(0)).alias(f"o{i}"))
        stats = combine_rows(stats, hist.agg(*out_aggs))
    rows = []
    for i, c in enumerate(cols):
        is_num = c in numeric
        rows.append(F.struct(
            F.lit(c).alias("column"),
            F.lit(_type_name(df.schema[c].dataType)).alias("data_type"),
            F.col(f"m{i}").alias("missing_values"),
            F.round(F.col(f"m{i}") / F.greatest(F.col("__n"), F.lit(1)) * 100, 2).alias("missing_pct"),
            F.col(f"u{i}").alias("unique_values"),
            F.coalesce(F.col(f"e{i}"), F.lit("—")).alias("example"),
            (F.round(F.col(f"lo{i}"), 2) if is_num else F.lit(None).cast("double")).alias("min"),
            (F.round(F.col(f"hi{i}"), 2) if is_num else F.lit(None).cast("double")).alias("max"),
            (F.col(f"o{i}") if is_num else F.lit(None).cast("long")).alias("outliers_iqr"),
        ))
    return stats.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def quality_comparison(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Rows, duplicate rows, missing cells before and after cleaning."""
    def figures(df, tag):
        a = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(_missing_cells(df)).alias("missing"))
        return combine_rows(a, duplicate_rows(df)).select(
            F.col("rows").alias(f"rows_{tag}"), F.col("duplicates").alias(f"dup_{tag}"),
            F.coalesce(F.col("missing"), F.lit(0)).alias(f"miss_{tag}"))
    j = combine_rows(figures(raw, "b"), figures(clean, "a"))
    return j.selectExpr(
        "stack(3, 'Rows', rows_b, rows_a, rows_a - rows_b, "
        "'Duplicate rows', dup_b, dup_a, dup_a - dup_b, "
        "'Missing cells', miss_b, miss_a, miss_a - miss_b) AS (metric, before_cleaning, after_cleaning, change)")


def cleaning_audit(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Seven checks on the mapped raw data (not exclusive) and the rows removed."""
    s = {f.name: f.dataType for f in raw.schema.fields}
    has = lambda c: c in s
    aggs = [F.count(F.lit(1)).alias("raw_rows")]
    if set(REQUIRED) <= set(s):
        aggs.append(F.count_if(functools.reduce(lambda a, b: a | b, [F.col(c).isNull() for c in REQUIRED]))
                    .alias("missing_required"))
    else:
        aggs.append(F.lit(0).cast("long").alias("missing_required"))
    aggs.append((F.count_if(to_ntz(F.col("invoice_date"), s["invoice_date"]).isNull()) if has("invoice_date")
                 else F.lit(0).cast("long")).alias("invalid_dates"))
    q = to_number(F.col("quantity"), s["quantity"]) if has("quantity") else None
    p = to_number(F.col("unit_price"), s["unit_price"]) if has("unit_price") else None
    aggs.append((F.count_if(q.isNull()) if q is not None else F.lit(0).cast("long")).alias("invalid_quantity"))
    aggs.append((F.count_if(p.isNull()) if p is not None else F.lit(0).cast("long")).alias("invalid_price"))
    aggs.append((F.count_if(q == 0) if q is not None else F.lit(0).cast("long")).alias("zero_quantity"))
    aggs.append((F.count_if(p < 0) if p is not None else F.lit(0).cast("long")).alias("negative_price"))
    figures = combine_rows(raw.agg(*aggs), duplicate_rows(raw),
                           clean.agg(F.count(F.lit(1)).alias("clean_rows")))
    checks = [("Duplicate rows", "duplicates"), ("Rows with missing required fields", "missing_required"),
              ("Invalid transaction dates", "invalid_dates"), ("Non-numeric quantities", "invalid_quantity"),
              ("Non-numeric prices", "invalid_price"), ("Zero-quantity rows", "zero_quantity"),
              ("Negative-price rows", "negative_price")]
    parts = ", ".join(f"'{label}', CAST({col} AS BIGINT), CASE WHEN {col} > 0 THEN 'Removed' ELSE 'None' END"
                      for label, col in checks)
    parts += ", 'Total rows removed', CAST(greatest(raw_rows - clean_rows, 0) AS BIGINT), 'Cleaning complete'"
    return figures.selectExpr(f"stack({len(checks) + 1}, {parts}) AS (check, records_affected, action)")
