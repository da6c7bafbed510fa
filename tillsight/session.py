"""Session helpers: one place for the settings the library relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tillsight", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Create (or reuse) a session with AQE on and the UI off.

    On a cluster ``master`` is left to spark-submit; locally pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("TILLSIGHT_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as named in ``spark.checkpoint.dir``.

    A temporary folder is made only when the setting is missing and the master
    is ``local[...]``, where driver and tasks are one process (tests).  On a
    cluster a missing setting is an error: a machine-local folder would be
    invisible to the other executors.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = configured or sc.getCheckpointDir()
    if not current:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="tillsight-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() if not configured else current


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Input rows that a shuffle within ``sized`` deals to a task, and bytes that a task reads of a file.
TASK_ROWS, TASK_BYTES = 250_000, 16 << 20


def _bytes(setting: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", setting.strip().lower()).groups()
    return int(number) << (10 * " kmgtp".index(unit or " "))


@contextmanager
def sized(spark: SparkSession, rows: int):
    """While it lasts, queries over ``rows`` input rows run in tasks of bounded size.

    A fixed number of shuffle partitions gives every task a share of the input, and its sorts
    and hash tables grow with that.  Here the number grows with the rows (never below the
    session's own), adaptive execution merges what is small, and scans are cut finer.  Small
    tables run under the session's settings as they are."""
    wanted = {"spark.sql.shuffle.partitions": max(shuffle_partitions(spark), -(-rows // TASK_ROWS)),
              "spark.sql.files.maxPartitionBytes": min(_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")), TASK_BYTES)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Training rows: from ``FIT_ROWS`` on they are dealt evenly; a task is worth ``SMALL_FIT`` rows and holds ``LARGE_FIT`` at most.
FIT_ROWS, SMALL_FIT, LARGE_FIT = 10_000, 4_000, 250_000


def fit_tasks(rows: int, cores: int) -> int:
    """Tasks for every pass of a fit over ``rows`` rows: one per core, more only where a task's rows
    would pass ``LARGE_FIT``, fewer where they would fall below ``SMALL_FIT``."""
    return max(1, min(-(-rows // SMALL_FIT), cores * -(-rows // (cores * LARGE_FIT))))


def dealt_for_fits(df, rows: int, write_small: bool = True):
    """``df``, of about ``rows`` rows, written once with its rows dealt evenly to ``fit_tasks``.

    A fit passes over its rows once per iteration or level, hundreds of times.  Files are as
    many as the steps before left, by bytes, and a few numbers per row are few bytes: most
    cores would wait.  Tables below ``FIT_ROWS`` are written as they are, or left alone without ``write_small``."""
    if rows < FIT_ROWS:
        return materialize(df) if write_small else df
    return materialize(df.repartition(fit_tasks(rows, df.sparkSession.sparkContext.defaultParallelism)))


#: Removes the shuffle files of an execution as it ends; by default they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df):
    """Compute ``df`` once, write it as Parquet to a fresh folder below the shared
    checkpoint directory and read it back.

    This cuts the lineage (a lost executor re-reads files, it does not replay the
    upstream plan), and later readers keep column pruning and filter pushdown.  Nothing
    reads the shuffle files of the write again, so they are removed: a query of many
    steps holds the disk of its largest one, not of all.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tillsight-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def in_rounds(rows: int, most: int, key: str, build):
    """The rows of ``build(portion)`` for portions of the values of ``key``, each written before the next is
    begun: as many that one shuffles about ``most`` of ``rows`` rows, so the disk they take does not grow
    with the tables.  ``portion`` is a condition on the column ``key``."""
    rounds = max(1, -(-rows // most))
    at = F.pmod(F.xxhash64(key), F.lit(rounds))
    return reduce(lambda a, b: a.unionByName(b),
                  [materialize(build(at == r if rounds > 1 else F.lit(True))) for r in range(rounds)])
