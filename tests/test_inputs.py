"""Stored tables, permissive CSV reading, and the column profile from counted values."""

from collections import Counter

import numpy as np

from tillsight.operators.profiling import column_profile, value_counts_long
from tillsight.plans import inputs
from tillsight.sources import files


def test_an_incomplete_version_leaves_the_old_table(spark, tmp_path):
    store = files.TableStore(spark, str(tmp_path / "db"))
    assert store.list() == []
    store.save("t", spark.range(3))
    second = store.save("t", spark.range(5))
    assert store.load("t").count() == 5 and store.list() == ["t"]
    broken = tmp_path / "db" / "t" / "v-0000000003-x"  # a write that broke off: no _SUCCESS
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert store.load("t").count() == 5 and second.endswith(store._current("t").rsplit("/", 1)[1])
    store.save("t", store.load("t").where("id > 1"))  # over the table it reads
    assert sorted(r["id"] for r in store.load("t").collect()) == [2, 3, 4]


def test_csv_rows_of_the_wrong_length_are_shown(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,2\n3\n4,5,6\n"7, x",8\n')
    rows = files.read_csv(spark, str(tmp_path / "x.csv"), corrupt_col="_bad").collect()
    assert [(r["a"], r["b"]) for r in rows] == [("1", "2"), ("3", None), ("4", "5"), ("7, x", "8")]
    assert [r["_bad"] for r in rows] == [None, "3", "4,5,6", None]
    assert files.read_csv(spark, str(tmp_path / "x.csv")).columns == ["a", "b"]


def test_column_profile_of_odd_columns(spark):
    rng = np.random.default_rng(4)
    x = [None if k % 7 == 0 else 5.0 if k % 3 == 0 else float(v) for k, v in enumerate(rng.normal(0, 10, 400).round(2))]
    x += [-0.0, 0.0, 900.0, -900.0]
    rows = [(v, None, "dup" if k % 2 else f"s{k}", k) for k, v in enumerate(x)]
    d = spark.createDataFrame(rows, "x double, none string, `odd.name` string, n int").repartition(6)
    got = {r["column"]: r for r in column_profile(d).collect()}
    known = [v for v in x if v is not None]
    q1, q3 = np.quantile(known, [0.25, 0.75])
    outliers = sum(v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1) for v in known)
    assert (got["x"]["missing_values"], got["x"]["unique_values"], got["x"]["outliers_iqr"]) == (
        len(x) - len(known), len(set(known)), outliers)
    assert (got["x"]["min"], got["x"]["max"]) == (-900.0, 900.0)
    assert (got["none"]["missing_values"], got["none"]["unique_values"], got["none"]["example"]) == (len(x), 0, "—")
    assert got["odd.name"]["unique_values"] == len({r[2] for r in rows}) and got["odd.name"]["example"] == "dup"
    counts = value_counts_long(d, ["odd.name"]).collect()
    assert Counter({r["__s"]: r["__w"] for r in counts}) == Counter(r[2] for r in rows)
    assert column_profile(d.limit(0)).count() == 4
    estimated = {r["column"]: r for r in column_profile(d, approx_distinct=True).collect()}
    assert estimated["x"]["outliers_iqr"] == outliers


def test_chosen_customers_are_some(spark):
    assert inputs.q_filtered_customers(spark, "/root/testdata/sf0.001").count() > 0
