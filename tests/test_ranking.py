"""The distributed rank / quantile plans against direct computations."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillsight.plans.ranking import exact_quantiles, global_cumsum, global_rank, ranks_by


def test_global_rank_matches_window(spark):
    rows = [(f"c{i:03d}", float(i % 7), i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, v double, g int")
    got = {r["id"]: r["rank"] for r in global_rank(df, ["v"], ["id"], num_partitions=5).collect()}
    want = {r["id"]: r["r"] for r in df.select("id", F.row_number().over(Window.orderBy("v", "id")).alias("r")).collect()}
    assert got == want


def test_global_rank_descending(spark):
    df = spark.createDataFrame([(f"c{i}", i % 4) for i in range(40)], "id string, v int")
    got = {r["id"]: r["rank"] for r in global_rank(df, [("v", False)], ["id"], num_partitions=3).collect()}
    want = {r["id"]: r["r"] for r in df.select(
        "id", F.row_number().over(Window.orderBy(F.col("v").desc(), "id")).alias("r")).collect()}
    assert got == want


def test_grouped_cumsum_with_hot_group(spark):
    # one group holds most rows: the range partitioning spreads it over partitions
    rows = [("hot" if i % 10 else f"g{i % 3}", i, float(i % 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, w double")
    got = {(r["g"], r["k"]): r["cum"] for r in global_cumsum(df, ["k"], ["g"], "w", num_partitions=7).collect()}
    want = {(r["g"], r["k"]): r["c"] for r in df.select(
        "g", "k", F.sum("w").over(Window.partitionBy("g").orderBy("k")).alias("c")).collect()}
    assert got == want


def test_ranks_by_several_columns(spark):
    rows = [(f"c{i:02d}", i % 5, (i * 7) % 11) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, a int, b int")
    r = {x["id"]: x for x in ranks_by(df, "id", {"ra": "a", "rb": "b"}).collect()}
    wa = {x["id"]: x["r"] for x in df.select("id", F.row_number().over(Window.orderBy("a", "id")).alias("r")).collect()}
    assert all(r[k]["ra"] == wa[k] for k in wa)
    assert all(x["ra_n"] == 50 for x in r.values())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=60),
       st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]))
def test_exact_quantiles_match_numpy(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = exact_quantiles(df, {"q": ("x", q)}, num_partitions=3).first()["q"]
    assert np.isclose(got, np.quantile(np.array(values, dtype=float), q))


def test_grouped_quantiles(spark):
    rows = [("a", float(v)) for v in range(11)] + [("b", float(v)) for v in (1, 1, 2, 10)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["m"] for r in exact_quantiles(df, {"m": ("x", 0.5)}, by=["g"]).collect()}
    assert got == {"a": 5.0, "b": 1.5}


def test_ranks_of_a_million_rows_with_payload(spark):
    n = 1_000_000
    df = spark.range(n, numPartitions=6).select(
        F.xxhash64("id").alias("v"), "id", F.rand(1).alias("x"), F.md5(F.col("id").cast("string")).alias("s"))
    for _ in range(2):
        r = global_rank(df, ["v"], ["id"], num_partitions=5)
        got = r.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank"), F.count("rank"), F.max("n")).first()
        assert tuple(got) == (1, n, n, n, n)


def test_split_is_disjoint_complete_and_exact(spark):
    from tillsight.operators.supervised import stratified_split
    n = 400_000
    df = spark.range(n).select(F.col("id").cast("string").alias("customer_id"), (F.col("id") % 4 == 0).cast("int").alias("label"),
                               F.rand(2).alias("x"))
    train, test = stratified_split(df, "label")
    both = train.select("customer_id", "label", F.lit(0).alias("t")).union(test.select("customer_id", "label", F.lit(1).alias("t")))
    assert both.select("customer_id").distinct().count() == both.count() == n
    got = {(r["label"], r["t"]): r["count"] for r in both.groupBy("label", "t").count().collect()}
    assert got == {(0, 0): 225_000, (0, 1): 75_000, (1, 0): 75_000, (1, 1): 25_000}


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "g string, k int")
    got = {(r["g"], r["k"]): r["cum"] for r in global_cumsum(df, ["k"], ["g"], num_partitions=2).collect()}
    assert got == {("a", 1): 1, (None, 2): 1, (None, 3): 2}
