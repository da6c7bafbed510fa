"""Literal fixtures F1-F15 (see FIXTURES.md)."""

import datetime

import pytest
from pyspark.sql import functions as F

from tillsight.operators import cleaning, mapping, series


def test_f1_missing_schema(spark):
    df = spark.createDataFrame([("C1",)], "customer_id string")
    report = cleaning.validate_transactions(df)
    assert not report.valid
    assert "Missing required columns" in report.errors[0]


def test_f2_cleaning_calculates_revenue(spark):
    df = spark.createDataFrame([("1", "C1", "2024-01-01", 2, 10), ("1", "C1", "2024-01-01", 0, 4)],
                               "invoice_id string, customer_id string, invoice_date string, quantity int, unit_price int")
    out = cleaning.clean_transactions(df).collect()
    assert len(out) == 1
    assert out[0]["revenue"] == 20
    assert out[0]["invoice_date"] == datetime.datetime(2024, 1, 1)


def test_f3_business_headers(spark):
    df = spark.createDataFrame([("1", "C1", "2024-01-01", 2, 10)],
                               "`Order ID` string, `Client ID` string, `Purchase Date` string, Qty int, `Sales Price` int")
    mapped, m, missing = mapping.auto_map_transaction_schema(df)
    assert not missing
    assert set(mapping.REQUIRED_COLUMNS) <= set(mapped.columns)


def test_fuzzy_mapping_uses_date_share(spark):
    df = spark.createDataFrame([("1", "C1", "2024-01-01", 2, 10.0)],
                               "receipt_ref string, shopper string, booked_on string, units_moved int, amount double")
    mapped, m, missing = mapping.auto_map_transaction_schema(df)
    assert "customer_id" in mapped.columns


def test_f5_duplicate_headers(spark):
    df = spark.createDataFrame([("A", None, 1), (None, "B", 2)], "`Product Name` string, product_name string, Qty int")
    out = mapping.normalize_columns(df)
    assert out.columns.count("product_name") == 1
    assert [r["product_name"] for r in out.collect()] == ["A", "B"]


STRICT = "Invoice string, Description string, Quantity int, InvoiceDate string, Price double, `Customer ID` int"


def test_f6_valid_second_contract(spark):
    df = spark.createDataFrame([("536365", "WHITE MUG", 6, "2010-12-01 08:26:00", 2.55, 17850)], STRICT)
    ok, errors, warnings = cleaning.strict_validation_messages(df)
    assert ok and not errors


def test_f7_aliases(spark):
    df = spark.createDataFrame([("536365", "WHITE MUG", 6, "2010-12-01", 2.55, 17850)],
                               "Invoice string, Description string, Quantity int, InvoiceDate string, UnitPrice double, CustomerID int")
    out, warnings = mapping.standardize_transaction_columns(df)
    assert {"Price", "Customer ID"} <= set(out.columns)


def test_f8_messy_headers(spark):
    df = spark.createDataFrame([("1", "MUG", 6, "2010-12-01", 2.5, 7)],
                               "`Order ID` string, `Product Name` string, QTY int, `Purchase-Date` string, "
                               "`Price Each` double, `Customer Number` int")
    out, warnings = mapping.standardize_transaction_columns(df)
    assert set(mapping.STRICT_REQUIRED) <= set(out.columns)
    assert warnings[0].startswith("Automatically mapped columns:")


def test_f9_canonical_wins(spark):
    df = spark.createDataFrame([("536365", "MUG", 6, "2010-12-01", 2.55, 17850, "X1")], STRICT + ", `Order ID` string")
    out, warnings = mapping.standardize_transaction_columns(df)
    assert "Invoice" in out.columns and "Order ID" in out.columns
    assert any("Ignored automatic mapping" in w for w in warnings)


def test_f10_missing_description(spark):
    df = spark.createDataFrame([("536365", 6, "2010-12-01", 2.55, 17850)],
                               "Invoice string, Quantity int, InvoiceDate string, Price double, `Customer ID` int")
    ok, errors, _ = cleaning.strict_validation_messages(df)
    assert not ok and "Description" in errors[0]


def test_f11_bad_values(spark):
    df = spark.createDataFrame([("1", "MUG", 6, "2010-12-01", 2.5, 1), ("2", "CUP", 0, "bad", -1.0, None)], STRICT)
    ok, errors, warnings = cleaning.strict_validation_messages(df)
    assert not ok
    assert any("invalid InvoiceDate" in e for e in errors)
    assert any("non-positive Quantity" in e for e in errors)
    assert any("no customer ID" in e for e in errors)
    assert not warnings


def test_f13_monthly_sales_first_lag(spark):
    rows = []
    for m in range(24):
        y, mo = divmod(m, 12)
        d = datetime.date(2024 + y, mo + 1, 1)
        rows.append((d, 1000 + 25 * m))
    df = spark.createDataFrame(rows, "month date, Sales bigint").select(
        F.last_day("month").alias("InvoiceDate"), F.col("Sales").cast("double").alias("Sales"))
    feats = series.strict_forecast_features(df).orderBy("InvoiceDate")
    first = feats.first()
    assert first["Lag_1"] == 1275
    assert feats.columns[2:12] == series.STRICT_FEATURES
    nxt = series.next_month_features(df).first()
    assert nxt["Lag_1"] == 1000 + 25 * 23


def test_f14_column_select(spark):
    df = spark.createDataFrame([(1, "2", 3)], "ignored int, amount string, count int")
    assert mapping.require_columns(df, ["count", "amount"]).columns == ["count", "amount"]
    with pytest.raises(ValueError):
        mapping.require_columns(df, ["missing"])


def test_f15_bad_number_raises(spark):
    df = spark.createDataFrame([("not-a-number",)], "amount string")
    with pytest.raises(Exception):
        cleaning.strict_numeric(df, ["amount"]).collect()


def test_mapping_claims(spark):
    df = spark.createDataFrame([("1", "2", "C1", "2024-01-01", 2, 10.0)],
                               "order_id string, invoice string, client string, `Date` string, qty int, amount double")
    mapped, m, missing = mapping.auto_map_transaction_schema(df, {"client": "customer_id"})
    assert m["client"] == "customer_id" and m["order_id"] == "invoice_id" and m["Date"] == "invoice_date"
    assert "invoice" in mapped.columns  # the first alias holds, the second keeps its name
    assert m["qty"] == "quantity" and m.get("amount") == "unit_price" and not missing


def test_keyed_forecast_carries_each_series_forward(spark):
    months = [datetime.datetime(2022 + i // 12, i % 12 + 1, 3) for i in range(20)]
    rows = [("long", d, 100.0 + 10 * i) for i, d in enumerate(months)] + [("short", d, 50.0) for d in months[-3:]]
    tx = spark.createDataFrame(rows, "country string, invoice_date timestamp_ntz, revenue double")
    out, _ = series.forecast_monthly_sales(tx, 3, keys=["country"])
    got = {(r["country"], r["month"]): (r["forecast_revenue"], r["method"]) for r in out.collect()}
    want = [datetime.date(2023, 9, 1), datetime.date(2023, 10, 1), datetime.date(2023, 11, 1)]
    assert sorted(got) == [(k, d) for k in ("long", "short") for d in want]
    assert all(got["short", d] == (50.0, "Historical monthly average") for d in want)
    assert all(got["long", d][1] == "Random Forest with lags" and 200 < got["long", d][0] < 300 for d in want)


def test_roll_forward_appends_its_own_predictions(spark):
    class Next:  # the value one and three months back, added
        def transform(self, df):
            from pyspark.ml.functions import vector_to_array
            v = vector_to_array("features")
            return df.withColumn("prediction", v[0] + v[1])

    monthly = spark.createDataFrame([(datetime.date(2024, i + 1, 1), float(i)) for i in range(6)], "month date, revenue double")
    ends = series.series_ends(monthly, [], "month", "revenue", 3)
    out = series.roll_forward(ends, Next(), series._simple_step, series.SIMPLE_FEATURES, 3, 4).first()["_path"]
    assert [p["prediction"] for p in out] == [5 + 3, 8 + 4, 12 + 5, 17 + 8]
    assert [p["month"].month for p in out] == [7, 8, 9, 10]


def test_interval_of_a_straight_line(spark):
    from pyspark.ml.regression import LinearRegression

    rows = [(datetime.date(2022 + i // 12, i % 12 + 1, 1), 100.0 + 10 * i) for i in range(24)]
    hist = series.forecast_features(spark.createDataFrame(rows, "month date, revenue double"))
    feats = list(series.FORECAST_FEATURES)
    model = LinearRegression(labelCol="revenue").fit(series._assemble(hist.dropna(subset=feats), feats))
    metrics = spark.createDataFrame([("Linear Regression", 0.0)], "model string, rmse double")
    out = series.forecast_with_uncertainty(None, 3, comparison=(
        metrics, {"models": {"Linear Regression": model}, "features": feats}, hist)).orderBy("month").collect()
    assert [r["month"] for r in out] == [datetime.date(2024, m, 1) for m in (1, 2, 3)]
    assert all(abs(r["forecast_revenue"] - (340 + 10 * i)) < 1 for i, r in enumerate(out))
    assert all(r["lower_bound"] <= r["forecast_revenue"] <= r["upper_bound"] for r in out)
    flat = series.forecast_with_uncertainty(None, 2, comparison=(None, {}, hist)).collect()
    assert [(r["forecast_revenue"], r["lower_bound"], r["upper_bound"]) for r in flat] == [(215.0, 172.0, 258.0)] * 2
