"""Disk held while queries run: shuffle files go with the write they served, long steps run in rounds."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight import session
from tillsight.operators import recommend, scores
from tillsight.plans import similarity, summed


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


@pytest.mark.parametrize("setting", [None, "true", "false"])
def test_shuffle_files_go_with_the_write(spark, setting):
    spark.conf.unset(session.CLEANUP) if setting is None else spark.conf.set(session.CLEANUP, setting)
    before = _shuffle_files(spark)
    df = session.materialize(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    until = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(.2)
    assert not _shuffle_files(spark) - before
    assert df.count() == 5000 and df.agg(F.sum("n")).first()[0] == 20_000
    assert spark.conf.get(session.CLEANUP, "false") == (setting or "false")
    spark.conf.unset(session.CLEANUP)


def test_rounds_cover_every_key_once(spark):
    df = spark.createDataFrame([(None, 1), *((f"k{i % 40}", i) for i in range(400))], "k string, v int")
    built = []

    def build(portion):
        built.append(df.where(portion).count())
        return df.where(portion)

    got = session.in_rounds(1000, 300, "k", build)
    assert len(built) == 4 and sum(built) == 401 and max(built) < 401
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))


@pytest.fixture()
def tx(spark):
    rng = np.random.default_rng(5)
    rows = [(f"i{i // 3}", f"c{c}", dt.datetime(2024, 1, 1 + i % 28), f"p{p}", f"name {p}", q, 2.0, 2.0 * q, "X")
            for i, (c, p, q) in enumerate(zip(np.repeat(rng.integers(0, 60, 300), 3), rng.integers(0, 40, 900), rng.integers(1, 4, 900).tolist()))]
    return session.materialize(spark.createDataFrame(rows, "invoice_id string, customer_id string, invoice_date timestamp_ntz, stock_code string, "
                                                     "product_name string, quantity long, unit_price double, revenue double, country string"))


@pytest.mark.parametrize("query", [lambda t: recommend.similar_products(t, 4), lambda t: recommend.similar_customers(t, 4),
                                   lambda t: recommend.neighbour_recommendations(t, 3, 5),
                                   lambda t: recommend.neighbour_recommendations(t, 3, 5, weighted=False, weight="quantity"),
                                   lambda t: recommend.recommend_products(t, 3)])
def test_rounds_give_the_same_rows(tx, monkeypatch, query):
    """The pairs, votes and packed lists of all entities were shuffled at once."""
    want = sorted(map(str, query(tx).collect()))
    rounds, in_rounds = [], session.in_rounds

    def counted(rows, most, key, build):
        rounds.append(-(-rows // most))
        return in_rounds(rows, most, key, build)

    for module in (similarity, summed, recommend):
        monkeypatch.setattr(module, "in_rounds", counted)
    monkeypatch.setattr(similarity, "ROUND_PAIRS", 2_000)
    monkeypatch.setattr(summed, "ROUND_SUMMED", 3_000)
    monkeypatch.setattr(recommend, "ROUND_VOTES", 1_000)
    assert sorted(map(str, query(tx).collect())) == want and min(rounds) > 1


def test_notebook_customers_read_the_lines_once(spark):
    """Every maximum, range and quantile of the table joined and cleaned the lines again."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = [(f"c{i % 20}", f"i{i % 50}", i % 7 + 1, float(i % 11 + 1), dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 90)) for i in range(300)]
    lines = spark.createDataFrame(rows, "`Customer ID` string, Invoice string, Quantity int, Sales double, InvoiceDate timestamp_ntz")
    table = scores.notebook_customer_table(lines.mapInPandas(seen, lines.schema))
    assert table.count() == 20 and read.value == 300
