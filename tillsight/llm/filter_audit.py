"""Filter interaction audit: what each filter removes after every prefix of the others."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import salted_join
from tillsight.session import materialize

WORD_BREAK = r"[\x20\x09-\x0D]+"


def text_filters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source") -> tuple[DataFrame, dict[str, DataFrame]]:
    """``(rows, failing)``: ``rows (row, doc_id, part)``, one per document, and for each of
    the filters A to E the stored table of the rows that fail it.

    A: under 50 words; B: distinct words under 65 % of words; C: capitals over 5 % of the
    code points; D: one of ``#$%&*|``; E: the text of a smaller id, whatever became of it.
    A null text is empty, a null part the empty string; a row with a null id never fails E,
    and rows that share their id and text don't fail it through each other.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split("text", WORD_BREAK), lambda w: w != "")
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    rows = materialize(src.select(F.monotonically_increasing_id().alias("row"), "doc_id", "part", "text",
                                  words.alias("words")).select(
        "row", "doc_id", "part",
        (F.size("words") < 50).alias("A"),
        (100 * F.size(F.array_distinct("words")).cast("long") < 65 * F.size("words").cast("long")).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 5 * F.char_length("text").cast("long")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
        F.sha2("text", 256).alias("digest")))
    failing = {f: materialize(rows.where(f).select("row", "part")) for f in "ABCD"}
    copies = materialize(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
                         .where(F.col("n") > 1))
    failing["E"] = materialize(salted_join(rows.select("row", "doc_id", "part", "digest"), copies, ["digest"], "n",
                                           [F.col("row")]).where(F.col("doc_id") > F.col("first")).select("row", "part"))
    return rows.select("row", "doc_id", "part"), failing


def _before(filters: Sequence[str], f: str) -> list[int]:
    """The prefixes that ``f`` can follow, as bit sets of filters."""
    bit = 1 << filters.index(f)
    return [p for p in range(1 << len(filters)) if not p & bit]


def interactions(rows: DataFrame, failing: dict[str, DataFrame], labelled: dict[str, DataFrame]) -> DataFrame:
    """``(part, filter, prefix, removed, redundant, <name>_lost ...)`` for every filter and
    every set of filters before it (``prefix``, a bit set in the order of ``failing``);
    combinations that would be all zero are left out.

    Removed are the failing rows that no filter of the prefix has in its table (left anti
    join), redundant those that one has (left semi join); a label's losses are the removed
    rows among its own ids.  Only failing ids take part, dealt by row once: what a row
    meets in the join is at most its own few failures.  Survivors never need a join of all
    documents: each step's are the last one's less those removed.
    """
    filters = list(failing)
    fails = reduce(DataFrame.unionByName, [t.select("row", "part", F.lit(i).alias("f")) for i, t in enumerate(failing.values())])
    names = list(labelled)
    tables = [fails.withColumn("count_as", F.lit(""))]
    tables += [fails.join(labelled[k].select("row"), "row", "left_semi").withColumn("count_as", F.lit(k)) for k in names]
    counted = reduce(DataFrame.unionByName, tables).repartition("row")
    prefixes = F.element_at(F.array(*[F.array(*[F.lit(p) for p in _before(filters, f)]) for f in filters]), F.col("f") + 1)
    asked = counted.select("row", "part", "f", "count_as", F.explode(prefixes).alias("prefix"))
    gone = fails.select("row", F.expr("shiftleft(1, f)").alias("bit"))
    met = (asked["row"] == gone["row"]) & (asked["prefix"].bitwiseAND(gone["bit"]) != 0)
    keys = ["part", "f", "prefix"]

    def total(df: DataFrame, sums: dict[str, str]) -> DataFrame:
        zero = {"removed", "redundant", *[f"{k}_lost" for k in names]} - set(sums)
        return df.groupBy(*keys).agg(*[F.sum(F.when(F.col("count_as") == k, 1).otherwise(0)).alias(c) for c, k in sums.items()]
                                     ).select(*keys, *sums, *[F.lit(0).cast("long").alias(c) for c in sorted(zero)])

    removed = total(asked.join(gone, met, "left_anti"), {"removed": "", **{f"{k}_lost": k for k in names}})
    redundant = total(asked.where(F.col("count_as") == "").join(gone, met, "left_semi"), {"redundant": ""})
    columns = ["removed", "redundant", *[f"{k}_lost" for k in names]]
    name = F.element_at(F.array(*[F.lit(f) for f in filters]), F.col("f") + 1).alias("filter")
    return (removed.unionByName(redundant).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])
            .select("part", name, "prefix", *columns))


def audit_orders(rows: DataFrame, failing: dict[str, DataFrame], labelled: dict[str, DataFrame]) -> DataFrame:
    """One row per part, order of the filters and step, zeros included: ``part, filter_order,
    step, kept, removed, redundant, unique_fails, <name>_lost ..., shapley``.

    All orders are read off the at most ``len(failing) * 2 ** (len(failing) - 1)`` rows per
    part of ``interactions``; no rows mean no parts, so an empty table gives none.
    """
    filters, names = list(failing), list(labelled)
    k = len(filters)
    everything = (1 << k) - 1
    counts = materialize(interactions(rows, failing, labelled))
    weight = F.element_at(F.array(*[F.lit(factorial(n) * factorial(k - 1 - n)) for n in range(k)]),
                          F.bit_count("prefix") + 1)
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(k)]), F.array_position(
        F.array(*[F.lit(f) for f in filters]), F.col("filter")).cast("int"))
    whole = counts.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * weight).alias("shapley"),
        F.sum(F.when(F.col("prefix") == F.lit(everything).bitwiseXOR(bit), F.col("removed")).otherwise(0)).alias("unique_fails"))
    orders = [("".join(o), step + 1, f, sum(1 << filters.index(x) for x in o[:step]))
              for o in permutations(filters) for step, f in enumerate(o)]
    listed = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"f":"{f}","p":{p}}}' for o, s, f, p in orders) + "]"),
                         "array<struct<o string, s int, f string, p int>>")
    steps = (rows.groupBy("part").agg(F.count(F.lit(1)).alias("documents"))
             .select("part", "documents", F.explode(listed).alias("x"))
             .select("part", "documents", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"),
                     F.col("x.f").alias("filter"), F.col("x.p").alias("prefix")))
    filled = steps.join(counts, ["part", "filter", "prefix"], "left").join(whole, ["part", "filter"], "left").fillna(0)
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.col("documents") - F.sum("removed").over(so_far)
    return filled.select("part", "filter_order", "step", kept.alias("kept"), "removed", "redundant", "unique_fails",
                         *[f"{n}_lost" for n in names], "shapley")


def labelled_rows(rows: DataFrame, labels: DataFrame, condition: Column) -> DataFrame:
    """The rows whose id has a label that fulfils ``condition``; repeated labels count once."""
    return materialize(rows.join(labels.where(condition).select(F.col("doc_id").alias("label_id")),
                                 F.col("doc_id") == F.col("label_id"), "left_semi").select("row"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source") -> DataFrame:
    """The audit of the five text filters over ``docs``, with label losses ``good_lost``
    (quality = 1) and ``toxic_lost`` (toxic = 1), per value of ``part_col``.

    Every input row is a document of its own, repeated rows and null ids too (a null id has
    no label).  Columns other than the three named are not read.
    """
    rows, failing = text_filters(docs, id_col, text_col, part_col)
    labelled = {"good": labelled_rows(rows, labels, F.col("quality") == 1),
                "toxic": labelled_rows(rows, labels, F.col("toxic") == 1)}
    return audit_orders(rows, failing, labelled)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS low FROM w GROUP BY text),
d AS (
  SELECT part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
         100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 5 * length(w.text) AS c,
         regexp_matches(w.text, '[#$%&*|]') AS d, coalesce(doc_id > low, false) AS e,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.toxic = 1) AS toxic
  FROM w JOIN firsts ON w.text = firsts.text),
kinds AS (
  SELECT part, [a, b, c, d, e] AS fails, good, toxic, count(*) AS n FROM d GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, ascii(filter_order[step]) - 64 AS f,
         list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
met AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS failed,
         len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone,
         len(list_filter(fails, lambda v: v)) = 1 AS alone FROM steps, kinds),
counted AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND failed), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND failed), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed AND alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (NOT gone AND failed AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (NOT gone AND failed AND toxic), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
