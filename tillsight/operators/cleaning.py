"""Validation and cleaning of transaction lines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.functions.exprs import combine_rows
from pyspark.sql import types as T

from tillsight.functions.exprs import finite_or_zero, id_text, to_ntz, to_number
from tillsight.operators.mapping import (OPTIONAL_COLUMNS, REQUIRED_COLUMNS, STRICT_REQUIRED,
                                         normalize_columns, standardize_transaction_columns)

MAX_NULL_CUSTOMER_SHARE = 0.20


@dataclass
class ValidationReport:
    valid: bool
    errors: list[str]
    warnings: list[str]
    rows: int
    counts: dict = field(default_factory=dict)


def validation_counts(df: DataFrame) -> DataFrame:
    """The validation figures as one aggregate row (lazy)."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if set(REQUIRED_COLUMNS) <= set(df.columns):
        q = to_number(F.col("quantity"), df.schema["quantity"].dataType)
        d = to_ntz(F.col("invoice_date"), df.schema["invoice_date"].dataType)
        aggs += [
            F.count_if(F.col("customer_id").isNull()).alias("null_customers"),
            F.count_if(q == 0).alias("zero_quantity"),
            F.count_if(d.isNull()).alias("bad_dates"),
        ]
    return df.agg(*aggs)


def validate_transactions(df: DataFrame) -> ValidationReport:
    """Errors: missing columns, empty, more than 20% missing customers.
    Warnings: zero quantities, unparseable dates.  One pass over the data."""
    errors, warnings = [], []
    missing = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
    if missing:
        errors.append(f"Missing required columns: {', '.join(missing)}")
    row = validation_counts(df).first().asDict()
    rows = int(row["rows"])
    if rows == 0:
        errors.append("The transaction dataset is empty")
    if not missing and rows:
        if row["null_customers"] / rows > MAX_NULL_CUSTOMER_SHARE:
            errors.append("More than 20% of customer IDs are missing")
        if row["zero_quantity"]:
            warnings.append("Zero-quantity rows will be discarded")
        if row["bad_dates"]:
            warnings.append("Rows with invalid invoice dates will be discarded")
    return ValidationReport(not errors, errors, warnings, rows, row)


def clean_transactions(df: DataFrame, validate: bool = False, dedupe: bool = True) -> DataFrame:
    """Canonical cleaning.

    Full-row dedupe (before any cast), dates to TIMESTAMP_NTZ, ids to trimmed
    text, numbers coerced (bad values to null), rows missing any required field
    dropped, ``quantity != 0`` and ``unit_price >= 0`` kept, ``revenue`` and
    ``is_return`` added, optional text columns filled with ``"Unknown"`` and
    trimmed.  Not sorted: ordering is applied only where a report needs it.
    """
    out = normalize_columns(df)
    if validate:
        report = validate_transactions(out)
        if not report.valid:
            raise ValueError("; ".join(report.errors))
    else:
        missing = sorted(set(REQUIRED_COLUMNS) - set(out.columns))
        if missing:
            raise ValueError(f"Missing required columns: {', '.join(missing)}")
    schema = {f.name: f.dataType for f in out.schema.fields}
    if dedupe:
        out = out.dropDuplicates()
    cols = []
    for c in out.columns:
        if c == "invoice_date":
            cols.append(to_ntz(F.col(c), schema[c]).alias(c))
        elif c == "customer_id":
            cols.append(id_text(F.col(c), schema[c]).alias(c))
        elif c in ("quantity", "unit_price"):
            cols.append(to_number(F.col(c), schema[c]).alias(c))
        elif c in OPTIONAL_COLUMNS:
            cols.append(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))).alias(c))
        else:
            cols.append(F.col(c))
    out = out.select(*cols).dropna(subset=REQUIRED_COLUMNS)
    out = out.where((F.col("quantity") != 0) & (F.col("unit_price") >= 0))
    return out.withColumns({
        "revenue": (F.col("quantity") * F.col("unit_price")).cast("double"),
        "is_return": (F.col("quantity") < 0).cast("int"),
    })


def strict_validation(df: DataFrame):
    """Second contract: counts of duplicates, bad dates, non-numeric or
    non-positive quantity/price, missing customer.  Returns ``(report_df,
    errors, warnings)``; ``report_df`` is one aggregate row (no rows removed)."""
    std, warnings = standardize_transaction_columns(df)
    missing = sorted(set(STRICT_REQUIRED) - set(std.columns))
    if missing:
        return None, [f"Missing required column(s): {', '.join(missing)}."], warnings
    schema = {f.name: f.dataType for f in std.schema.fields}
    d = to_ntz(F.col("InvoiceDate"), schema["InvoiceDate"])
    q = to_number(F.col("Quantity"), schema["Quantity"])
    p = to_number(F.col("Price"), schema["Price"])
    counts = std.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(d.isNull()).alias("bad_dates"),
        F.count_if(q.isNull()).alias("bad_quantity"),
        F.count_if(q <= 0).alias("nonpositive_quantity"),
        F.count_if(p.isNull()).alias("bad_price"),
        F.count_if(p <= 0).alias("nonpositive_price"),
        F.count_if(F.col("Customer ID").isNull()).alias("null_customer"),
    )
    distinct_rows = std.distinct().agg(F.count(F.lit(1)).alias("distinct_rows"))
    report = combine_rows(counts, distinct_rows).withColumn(
        "duplicates", F.col("rows") - F.col("distinct_rows")).drop("distinct_rows")
    return report, None, warnings


def strict_validation_messages(df: DataFrame):
    """``(is_valid, errors, warnings)`` with the reference's wording."""
    report, errors, warnings = strict_validation(df)
    if report is None:
        return False, errors, warnings
    r = report.first().asDict()
    errors = []
    if r["rows"] == 0:
        errors.append("The uploaded file does not contain any rows.")
    if r["duplicates"]:
        warnings.append(f"{r['duplicates']} duplicate row(s) were found.")
    if r["bad_dates"]:
        errors.append(f"{r['bad_dates']} row(s) have an invalid InvoiceDate.")
    for name, bad, nonpos in (("Quantity", "bad_quantity", "nonpositive_quantity"),
                              ("Price", "bad_price", "nonpositive_price")):
        if r[bad]:
            errors.append(f"{r[bad]} row(s) have a non-numeric {name} value.")
        elif r[nonpos]:
            errors.append(f"{r[nonpos]} row(s) have a non-positive {name} value.")
    if r["null_customer"]:
        errors.append(f"{r['null_customer']} row(s) have no customer ID.")
    return not errors, errors, warnings


def strict_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric coercion that fails on a bad value (ANSI cast raises at execution)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required column(s): {', '.join(missing)}.")
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def sanitize_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Select ``features`` in order as doubles with infinities/NaN/null set to 0."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required features: {', '.join(missing)}")
    return df.select(*[finite_or_zero(F.col(c)).alias(c) for c in features])


def strict_clean(df: DataFrame, drop_null_customer: bool = True, dedupe: bool = True,
                 invoice="Invoice", qty="Quantity", price="Price", date="InvoiceDate",
                 customer="Customer ID") -> DataFrame:
    """Notebook-style cleaning on the title-case contract: optionally drop
    missing customers and duplicates, drop cancelled invoices (``C`` prefix),
    keep positive quantity and price, add ``Sales``."""
    out = df
    if drop_null_customer and customer in df.columns:
        out = out.where(F.col(customer).isNotNull())
    if dedupe:
        out = out.dropDuplicates()
    schema = {f.name: f.dataType for f in out.schema.fields}
    out = out.withColumns({
        date: to_ntz(F.col(date), schema[date]),
        qty: to_number(F.col(qty), schema[qty]),
        price: to_number(F.col(price), schema[price]),
    }).dropna(subset=[date, qty, price])
    out = out.where(~F.col(invoice).cast("string").startswith("C") & (F.col(qty) > 0) & (F.col(price) > 0))
    return out.withColumn("Sales", (F.col(qty) * F.col(price)).cast("double"))


def date_parts(df: DataFrame, col: str = "invoice_date") -> DataFrame:
    """Year, month, day, hour, weekday (Monday = 0, as pandas)."""
    c = F.col(col)
    return df.withColumns({
        "year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c),
        "hour": F.hour(c), "weekday": F.weekday(c),
    })
