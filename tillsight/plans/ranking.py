"""Global order statistics without a single-partition window.

A window with ``orderBy`` but no ``partitionBy`` moves every row into one
task.  Here the rows are range-partitioned on the ordering key instead, and
each partition computes a running sum locally (Arrow batches, in order).  The
result, with the partition's number as a column, is written to the shared
folder once; the totals per partition and group are summed from those rows and
joined back as offsets.  Both sides read the same rows, so they can't disagree
about which partition a row is in, however the range bounds were sampled.

Used for: the quintile ranks (``rank(method="first")``), exact linear
quantiles (``quantile_cont``), and any global running total.
"""

from __future__ import annotations

from typing import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.session import materialize, shuffle_partitions

_PID = "__pid"
_LOCAL = "__lcum"


def _running_sum_fn(group_cols: Sequence[str], weight_col: str | None, weight_type: str):
    """Per-partition running sum over rows already sorted by (groups, order)."""

    def run(batches: Iterable[pd.DataFrame]):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        carry_key = None
        carry_sum = 0
        for pdf in batches:
            if pdf.empty:
                continue
            w = pdf[weight_col].to_numpy() if weight_col else np.ones(len(pdf), dtype=np.int64)
            if group_cols:
                keys = pd.MultiIndex.from_frame(pdf[list(group_cols)]) if len(group_cols) > 1 \
                    else pd.Index(pdf[group_cols[0]])
                codes = pd.factorize(keys)[0]
                # running sum restarts where the group changes (rows are sorted by group)
                csum = pd.Series(w).groupby(codes).cumsum().to_numpy()
                first_key = keys[0]
                if carry_key is not None and first_key == carry_key:
                    csum = np.where(codes == codes[0], csum + carry_sum, csum)
                carry_key = keys[-1]
                carry_sum = csum[-1]
            else:
                csum = np.cumsum(w) + carry_sum
                carry_sum = csum[-1]
            out = pdf.copy()
            out[_PID] = np.int32(pid)
            out[_LOCAL] = csum.astype("float64" if weight_type == "double" else "int64")
            yield out

    return run


def _stack_long(df: DataFrame, columns: dict, keep: Sequence[str] = ()) -> DataFrame:
    """One scan of ``df`` into long form ``(keep..., __g, __v)``: one row per input
    row and named column (``__g`` = name, ``__v`` = value as double)."""
    items = [F.struct(F.lit(name).alias("__g"), F.col(col).cast("double").alias("__v"))
             for name, col in columns.items()]
    return (df.select(*keep, F.explode(F.array(*items)).alias("__kv"))
            .select(*keep, F.col("__kv.__g").alias("__g"), F.col("__kv.__v").alias("__v")))


def global_cumsum(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (),
                  weight_col: str | None = None, out_col: str = "cum", total_col: str | None = "total",
                  num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``weight_col`` (or 1 per row) along ``order_cols``,
    restarting per ``group_cols``.  The ordering must be total (add a key as the
    last order column) for the result to be deterministic.
    """
    spark = df.sparkSession
    n = num_partitions or shuffle_partitions(spark)
    group_cols = list(group_cols)
    keys = group_cols + list(order_cols)
    wtype = "long"
    if weight_col is not None:
        wdt = df.schema[weight_col].dataType
        wtype = "double" if isinstance(wdt, (T.FloatType, T.DoubleType, T.DecimalType)) else "long"
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    out_schema = T.StructType(list(df.schema.fields) + [
        T.StructField(_PID, T.IntegerType(), False),
        T.StructField(_LOCAL, T.DoubleType() if wtype == "double" else T.LongType(), False),
    ])
    local = materialize(ranged.mapInPandas(_running_sum_fn(group_cols, weight_col, wtype), out_schema))

    wsum = F.sum(F.col(weight_col)) if weight_col else F.count(F.lit(1))
    part_totals = local.groupBy(_PID, *group_cols).agg(wsum.alias("__ptot"))
    before = Window.partitionBy(*group_cols).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    offsets = part_totals.select(
        _PID, *group_cols,
        F.coalesce(F.sum("__ptot").over(before), F.lit(0)).alias("__offset"),
        F.sum("__ptot").over(whole).alias("__gtot"),
    )
    # one row per partition and group: the join is planned by measured size
    off = offsets.select(*[F.col(c).alias(f"__o_{c}") for c in [_PID, *group_cols]], "__offset", "__gtot")
    same = F.col(_PID) == F.col(f"__o_{_PID}")
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    joined = local.join(off, same, "left")
    cols = [F.col(c) for c in df.columns] + [(F.col("__offset") + F.col(_LOCAL)).alias(out_col)]
    if total_col:
        cols.append(F.col("__gtot").alias(total_col))
    return joined.select(*cols)


def global_rank(df: DataFrame, order_cols: Sequence, tie_cols: Sequence[str],
                rank_col: str = "rank", n_col: str | None = "n",
                num_partitions: int | None = None) -> DataFrame:
    """1-based ``row_number`` over the whole frame ordered by ``order_cols`` then
    ``tie_cols`` (pandas ``rank(method="first")`` when ``tie_cols`` is the row
    order).  ``order_cols`` may be column names or (name, ascending) pairs.
    """
    tmp_cols, sel = [], []
    for i, oc in enumerate(order_cols):
        name, asc = (oc, True) if isinstance(oc, str) else oc
        if asc:
            tmp_cols.append(name)
        else:
            tmp = f"__neg{i}"
            sel.append((-F.col(name)).alias(tmp))
            tmp_cols.append(tmp)
    base = df.select("*", *sel) if sel else df
    ranked = global_cumsum(base, tmp_cols + list(tie_cols), out_col=rank_col, total_col=n_col,
                           num_partitions=num_partitions)
    return ranked.drop(*[c for c in tmp_cols if c.startswith("__neg")])


def exact_quantiles(df: DataFrame, specs: dict, by: Sequence[str] = (),
                    num_partitions: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (pandas default / ``quantile_cont``), one row
    per ``by`` group (one row overall without ``by``).

    ``specs`` maps an output name to ``(column, q)``.  Nulls and NaN are skipped.
    Values are first counted per distinct value (partial aggregation, so a
    low-cardinality column shrinks to a handful of rows), then cumulated with
    :func:`global_cumsum` -- range-partitioned, so a hot group is spread over
    many tasks; only the rows holding the two bracketing positions reach the
    final aggregate.
    """
    by = list(by)
    columns = sorted({c for c, _ in specs.values()})
    long = _stack_long(df, {c: c for c in columns}, keep=by)
    long = long.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    hist = long.groupBy(*by, "__g", "__v").agg(F.count(F.lit(1)).alias("__w"))
    return counted_quantiles(hist, specs, by, num_partitions)


def counted_quantiles(hist: DataFrame, specs: dict, by: Sequence[str] = (),
                      num_partitions: int | None = None) -> DataFrame:
    """``exact_quantiles`` of values already counted: ``(by..., __g, __v, __w)``, where ``__g``
    names the column, ``__v`` is the value (neither null nor NaN) and ``__w`` its rows."""
    by = list(by)
    cum = global_cumsum(hist, ["__v"], group_cols=by + ["__g"], weight_col="__w", out_col="__c",
                        total_col="__N", num_partitions=num_partitions)
    start = F.col("__c") - F.col("__w")

    def at(pos):
        return (start <= pos) & (pos < F.col("__c"))

    aggs, keep = [], None
    for name, (col, q) in specs.items():
        h = (F.col("__N") - 1).cast("double") * F.lit(float(q))
        lo, hi = F.floor(h), F.ceil(h)
        is_g = F.col("__g") == F.lit(col)
        aggs.append(F.max(F.when(is_g & at(lo), F.col("__v"))).alias(f"{name}__lo"))
        aggs.append(F.max(F.when(is_g & at(hi), F.col("__v"))).alias(f"{name}__hi"))
        aggs.append(F.max(F.when(is_g, h - lo)).alias(f"{name}__f"))
        cond = is_g & (at(lo) | at(hi))
        keep = cond if keep is None else (keep | cond)
    relevant = cum.where(keep)
    agg = relevant.groupBy(*by).agg(*aggs) if by else relevant.agg(*aggs)
    outs = [F.col(b) for b in by] + [
        (F.col(f"{n}__lo") + (F.col(f"{n}__hi") - F.col(f"{n}__lo")) * F.col(f"{n}__f")).alias(n)
        for n in specs
    ]
    return agg.select(*outs)


def ranks_by(df: DataFrame, key: str, columns: dict) -> DataFrame:
    """First-ranks of several columns in one range shuffle.

    ``columns`` maps an output name to a value column.  Returns ``key`` plus,
    per name, ``<name>`` (1-based rank ascending by value, ties by ``key``)
    and ``<name>_n`` (non-null count).  Rows are stacked in long form
    ``(g, v, key)``, ranked per ``g`` by :func:`global_cumsum`, and pivoted back
    with one aggregation by ``key``.
    """
    long = _stack_long(df, columns, keep=[key])
    ranked = global_cumsum(long, ["__v", key], group_cols=["__g"], out_col="__r", total_col="__n")
    aggs = []
    for name in columns:
        aggs.append(F.max(F.when(F.col("__g") == name, F.col("__r"))).alias(name))
        aggs.append(F.max(F.when(F.col("__g") == name, F.col("__n"))).alias(f"{name}_n"))
    return ranked.groupBy(key).agg(*aggs)
