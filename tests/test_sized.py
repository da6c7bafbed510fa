"""Task sizes that follow the input, and months computed once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillsight import session
from tillsight.operators.series import month_end_series
from tillsight.plans import catalog

SETTINGS = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")


def _settings(spark):
    return tuple(spark.conf.get(k) for k in SETTINGS)


def test_partitions_grow_with_rows_and_settings_come_back(spark):
    before = _settings(spark)
    with session.sized(spark, session.TASK_ROWS * 100 + 1):
        assert _settings(spark) == ("101", str(session.TASK_BYTES))
    assert _settings(spark) == before
    with session.sized(spark, 5):  # never below the session's own number
        assert _settings(spark)[0] == before[0]
    with pytest.raises(ValueError):
        with session.sized(spark, 10 ** 9):
            raise ValueError
    assert _settings(spark) == before


@pytest.mark.parametrize("text,n", [("100", 100), ("64k", 64 << 10), ("1m", 1 << 20), ("128MB", 128 << 20), ("134217728b", 1 << 27)])
def test_size_settings_are_read(text, n):
    assert session._bytes(text) == n


def test_hub_is_built_in_tasks_sized_for_the_lines(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    spark.range(1000).withColumnRenamed("id", "l_orderkey").write.parquet(f"{tmpdir_path}/lineitem.parquet")
    seen = []

    def build():
        seen.append(_settings(spark)[0])
        return catalog.tables.table(spark, tmpdir_path, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))

    hub = catalog._hub(spark, tmpdir_path, "lines", build)
    assert seen == ["100"] and hub.count() == 1000
    assert catalog._hub(spark, tmpdir_path, "lines", build) is hub and _settings(spark)[0] != "100"


def test_month_end_reads_the_lines_once(spark, tmpdir_path):
    path = f"{tmpdir_path}/sales.parquet"
    rows = [(dt.datetime(2020, 1, 5), 2.0), (dt.datetime(2020, 1, 9), 3.0), (dt.datetime(2020, 3, 1), 7.0)]
    spark.createDataFrame(rows, "InvoiceDate timestamp_ntz, Sales double").write.parquet(path)
    out = month_end_series(spark.read.parquet(path))
    assert not [f for f in out.inputFiles() if path in f]  # the months, not the lines
    assert [tuple(r) for r in out.orderBy("InvoiceDate").collect()] == [
        (dt.date(2020, 1, 31), 5.0), (dt.date(2020, 2, 29), 0.0), (dt.date(2020, 3, 31), 7.0)]


def test_quality_classifier_reads_in_small_portions():
    import pyarrow as pa

    from tillsight.llm.quality_classifier import _portions
    texts = [b"word%d " % i * 100 for i in range(3000)]
    got = list(_portions(iter([pa.RecordBatch.from_pydict({"row": list(range(3000)), "text": texts})])))
    assert [r for rows, _ in got for r in rows] == list(range(3000)) and [t for _, part in got for t in part] == texts
    assert max(sum(map(len, part)) for _, part in got) < 512 << 10  # all arrays of a worker follow this size


@pytest.mark.parametrize("rows,cores,tasks", [(0, 12, 1), (9_000, 12, 3), (67_487, 12, 12), (674_865, 12, 12), (4_049_190, 12, 24), (4_049_190, 1, 17)])
def test_a_fit_uses_every_core_and_bounds_its_tasks(rows, cores, tasks):
    assert session.fit_tasks(rows, cores) == tasks
    assert rows <= tasks * session.LARGE_FIT


def test_training_rows_are_dealt_evenly_and_small_tables_left(spark, monkeypatch):
    rows = spark.range(60).coalesce(1)
    assert session.dealt_for_fits(rows, 60, write_small=False) is rows
    monkeypatch.setattr(session, "FIT_ROWS", 10)
    monkeypatch.setattr(session, "SMALL_FIT", 15)
    wanted = session.fit_tasks(60, spark.sparkContext.defaultParallelism)
    dealt = session.dealt_for_fits(rows, 60)
    held = dealt.rdd.glom().map(len).collect()
    assert sorted(r["id"] for r in dealt.collect()) == list(range(60))
    assert len(held) == wanted and max(held) <= -(-60 // wanted) + 1


def test_churn_models_are_fitted_on_dealt_rows(spark, monkeypatch):
    from pyspark.ml.classification import DecisionTreeClassifier

    from tillsight.operators import supervised
    monkeypatch.setattr(session, "FIT_ROWS", 10)
    monkeypatch.setattr(session, "SMALL_FIT", 20)
    seen = []

    class Watched(DecisionTreeClassifier):
        def fit(self, dataset, params=None):
            seen.append((dataset.rdd.getNumPartitions(), dataset.count()))
            return super().fit(dataset, params)

    monkeypatch.setattr(supervised, "_churn_estimators", lambda seed, boosted: {"Decision Tree": Watched(maxDepth=3, weightCol="w", seed=seed)})
    people = spark.range(80).coalesce(1).select(
        F.col("id").cast("string").alias("customer_id"), (F.col("id") % 2).cast("int").alias("churned"),
        *[(F.col("id") * (i + 3) % 17).cast("double").alias(c) for i, c in enumerate(supervised.CHURN_FEATURES)])
    result = supervised.fit_churn_models(people)
    assert seen == [(session.fit_tasks(80, spark.sparkContext.defaultParallelism), 60)]
    assert sum(map(sum, result.confusion_matrices["Decision Tree"])) == 20
