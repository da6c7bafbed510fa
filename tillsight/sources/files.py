"""File and table sources / sinks.

* CSV: read with an all-string schema from the header (no inference pass),
  then the cleaning step coerces types; JSON: records or JSON lines.
* Tables: parquet under a base directory, each save a numbered version that counts
  once it is complete; overwriting a path that is being read fails in Spark.
* Models: Spark ML persistence.  Run summary: one nested JSON record.
* SQL databases: ``read_jdbc`` / ``write_jdbc`` need the vendor driver jar on
  the cluster classpath; nothing here bundles one.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8",
             corrupt_col: str | None = None) -> DataFrame:
    """Header CSV with every column as string (one header read, no inference pass).

    Rows with too few or too many fields are read as far as they go; ``corrupt_col`` names
    a column that holds such a row's text, null elsewhere."""
    header = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path).columns
    extra = [corrupt_col] if corrupt_col else []
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in [*header, *extra]])
    reader = (spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding)
              .option("mode", "PERMISSIVE"))
    if corrupt_col:
        reader = reader.option("columnNameOfCorruptRecord", corrupt_col)
    return reader.csv(path)


def read_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON array of records (``multi_line``) or JSON lines."""
    return spark.read.option("multiLine", multi_line).json(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Header CSV export of any result (no index column)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


class TableStore:
    """Named parquet tables under one base directory (the reference's database)."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _children(self, path: str) -> list[str]:
        """Names of the folders in ``path``, through Hadoop's file system API; none if it is missing."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []

    def _complete(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _current(self, name: str) -> str | None:
        """The newest version whose writing was completed."""
        for version in sorted(self._children(f"{self.base}/{name}"), reverse=True):
            if version.startswith("v-") and self._complete(f"{self.base}/{name}/{version}"):
                return f"{self.base}/{name}/{version}"
        return None

    def save(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """Replace table ``name`` by a new version, numbered after all that exist.

        The version counts once Spark has put its ``_SUCCESS`` mark: readers see the old
        table or the new one, and a write that breaks off leaves the old one in place."""
        numbers = [int(v.split("-")[1]) for v in self._children(f"{self.base}/{name}") if v.startswith("v-")]
        version = f"{self.base}/{name}/v-{max(numbers, default=0) + 1:010d}-{uuid.uuid4().hex}"
        w = df.write.mode("errorifexists")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(version)
        return version

    def load(self, name: str) -> DataFrame:
        path = self._current(name)
        if path is None:
            raise KeyError(f"No table named {name!r}")
        return self.spark.read.parquet(path)

    def list(self) -> list[str]:
        """Sorted table names (directory listing through Hadoop's file system API)."""
        return sorted(n for n in self._children(self.base) if self._current(n) is not None)


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "overwrite", **options) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(cls, path: str):
    """``cls`` is the fitted model class, e.g. ``PipelineModel`` or ``KMeansModel``."""
    return cls.load(path)


def write_run_summary(spark: SparkSession, summary: dict, path: str) -> str:
    """One nested record written as JSON (a one-row DataFrame)."""
    spark.createDataFrame([(json.dumps(summary, default=str),)], "j string").coalesce(1).write.mode(
        "overwrite").text(path)
    return path


def read_run_summary(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path).collect()
    return json.loads(rows[0][0]) if rows else {}


def local_path(path: str) -> str:  # pragma: no cover - convenience for tests
    return os.path.abspath(path)
