import json
import os

from pyspark.sql import functions as F

from tillsight.operators import cleaning
from tillsight.sources import files
from tillsight.streaming import ingest


def test_csv_reads_as_strings_then_cleans(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t.csv")
    with open(p, "w") as fh:
        fh.write("InvoiceNo,CustomerID,InvoiceDate,Qty,Price\n1,13085.0,2024-01-01,2,1.5\n2,13085.0,bad,1,1.0\n")
    df = files.read_csv(spark, p)
    assert all(t == "string" for _, t in df.dtypes)
    out = cleaning.clean_transactions(df).collect()
    assert len(out) == 1 and out[0]["revenue"] == 3.0


def test_json_and_table_store(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t.json")
    with open(p, "w") as fh:
        json.dump([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}], fh)
    df = files.read_json(spark, p)
    store = files.TableStore(spark, os.path.join(tmpdir_path, "db"))
    store.save("things", df)
    store.save("things", df.where("a = 2"))     # replace while readable
    store.save("other", df)
    assert store.list() == ["other", "things"]
    assert store.load("things").count() == 1
    files.write_csv(df, os.path.join(tmpdir_path, "out_csv"), single_file=True)
    files.write_run_summary(spark, {"kpis": {"revenue": 1.0}}, os.path.join(tmpdir_path, "summary"))
    assert files.read_run_summary(spark, os.path.join(tmpdir_path, "summary"))["kpis"]["revenue"] == 1.0


def test_streaming_clean_and_monthly_merge(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    rows = [("1", "A", "2024-01-05 00:00:00", "P1", "mug", 2, 10.0, "UK"),
            ("1", "A", "2024-01-05 00:00:00", "P1", "mug", 2, 10.0, "UK"),
            ("2", "B", "2024-02-01 00:00:00", "P2", "cup", 1, 5.0, "FR")]
    df = spark.createDataFrame(rows, "invoice_id string, customer_id string, invoice_date string, stock_code string, "
                                     "product_name string, quantity long, unit_price double, country string")
    df.withColumn("invoice_date", F.col("invoice_date").cast("timestamp_ntz")).write.parquet(src)
    stream = ingest.clean_stream(ingest.stream_transactions(spark, src))
    sink = os.path.join(tmpdir_path, "monthly")
    q = (stream.writeStream.foreachBatch(ingest.monthly_revenue_sink(sink))
         .option("checkpointLocation", os.path.join(tmpdir_path, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {str(r["month"]): r["revenue"] for r in spark.read.parquet(sink).collect()}
    assert got == {"2024-01-01": 20.0, "2024-02-01": 5.0}
