"""Quality rules: base limits, and an isolation forest on the rules' statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import map_rows, select_text
from tillsight.session import materialize

WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30  # fixed limits of the base rules: words; percent of repeated words

#: The forest: trees, and rows that each tree is grown on.
TREES, TREE_ROWS = 100, 256
#: Share of labelled good documents that the calibrated threshold must keep.
KEEP_GOOD = 0.99
#: Scores are calibrated on a histogram of so many bins.
BINS = 4000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE_COUNTS = ["n_adjacent", "n_capitals", "n_marks", "n_text_lines"]
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + MORE_COUNTS)
#: What the forest sees: these counts per word, drawn towards the rate of the whole corpus
#: as if by so many words more.  So neither length nor a short text's chance is an anomaly.
RATED, PRIOR_WORDS = ["word_chars", "n_symbols", "n_repeat_words", "n_adjacent", "n_capitals", "n_marks"], 200
#: Repeated lines count per line with a word, drawn towards the corpus as if by so many more.
PRIOR_LINES = 20
PER = {**{c: ("n_words", PRIOR_WORDS) for c in RATED}, "n_dup_lines": ("n_text_lines", PRIOR_LINES)}
#: The rate of repeated lines is added to that of repeated words: both say how much of a text comes again.
RATED, RATES = list(PER), [f"rate_{c}" for c in PER if c != "n_dup_lines"]

_SYMBOL, _CAPITAL, _MARK = 1, 2, 4
_CLASS = np.zeros(256, "u1")
_CLASS[list(b"#*$%&|<>")] |= _SYMBOL
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] |= _CAPITAL
_CLASS[list(b"!\"'()+-./:;=?@[\\]^_`{}~")] |= _MARK
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words covered by ``WINDOW``-word windows found twice or more, and words equal to
    the word before.  Windows are named exactly, by doubling: pairs of names get names."""
    n = len(words)
    if n < 2:
        return 0, 0
    names: dict[bytes, int] = {}
    code = np.array([names.setdefault(w, len(names)) for w in words], "i8")
    adjacent = int((code[1:] == code[:-1]).sum())
    if n <= WINDOW:
        return 0, adjacent
    span = 1
    while span < WINDOW:
        pair = code[:-span] * n + code[span:]
        span *= 2
        _, code, counts = np.unique(pair, return_inverse=True, return_counts=True)
    twice = counts[code] > 1
    if not twice.any():
        return 0, adjacent
    edge = np.zeros(n + 1, "i8")
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return int((np.cumsum(edge) > 0).sum()), adjacent


def rule_statistics(text: bytes) -> tuple:
    words = text.split()
    n = len(words)
    buffer = np.frombuffer(text, "u1")
    code_points = (buffer & 0xC0) != 0x80
    chars = int((code_points & ~_SPACE[buffer]).sum())
    kinds = np.bincount(_CLASS[buffer], minlength=8)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeats, adjacent = repeated_words(words)
    return (n, chars, int(kinds[_SYMBOL]), dup, repeats, adjacent, int(kinds[_CAPITAL]), int(kinds[_MARK]), lines)


def grow_tree(x: np.ndarray, seed: int) -> list[tuple[int, int, float, int, float]]:
    """Nodes ``(node, feature, split, left, path)``; the right child follows the left,
    and a leaf has feature -1 and its expected path length."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(2, len(x)))))
    nodes, todo = [(0, -1, 0.0, 0, 0.0)], [(0, x, 0)]
    while todo:
        node, rows, depth = todo.pop()
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        free = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or not len(free):
            nodes[node] = (node, -1, 0.0, 0, depth + expected_path(len(rows)))
            continue
        feature = int(rng.choice(free))
        split = float(rng.uniform(low[feature], high[feature]))
        left = len(nodes)
        nodes[node] = (node, feature, split, left, 0.0)
        nodes += [(left, -1, 0.0, 0, 0.0), (left + 1, -1, 0.0, 0, 0.0)]
        below = rows[:, feature] < split
        todo += [(left, rows[below], depth + 1), (left + 1, rows[~below], depth + 1)]
    return nodes


def expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def anomaly_scores(x: np.ndarray, forest: list[np.ndarray], rows: int) -> np.ndarray:
    """2 ** (-mean path / expected path), near 1 for rows that few splits set apart."""
    path = np.zeros(len(x))
    at_row = np.arange(len(x))
    for tree in forest:  # columns: feature, split, left, path
        feature, left = tree[:, 0].astype("i4"), tree[:, 2].astype("i4")
        node = np.zeros(len(x), "i4")
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = x[at_row, np.maximum(f, 0)] >= tree[node, 1]
            node = np.where(inner, left[node] + right, node)
        path += tree[node, 3]
    return 2.0 ** (-path / max(1, len(forest)) / max(expected_path(rows), 1e-9))


def calibrate(good: np.ndarray, bad: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The score from which on documents are rejected: of the bin edges that keep the share
    ``keep_good`` of the good, the one with the best balanced accuracy; over 1 (nothing is
    rejected) if a class is missing or no edge does better than keeping all."""
    if not good.sum() or not bad.sum():
        return 2.0
    kept_good = np.concatenate(([0], np.cumsum(good))) / good.sum()
    caught = 1 - np.concatenate(([0], np.cumsum(bad))) / bad.sum()
    value = np.where(kept_good >= keep_good, kept_good + caught, 0)
    best = int(value.argmax())
    if value[best] <= 1:
        return 2.0
    ties = np.flatnonzero(value == value[best])  # an empty gap between the classes: its middle
    return float((ties[0] + ties[ties <= best + BINS][-1]) / 2 / len(good))


def least_hashes(df: DataFrame, n: int, rows: int) -> DataFrame:
    """The rows of ``df`` (``rows`` in all) up to some value of their hash ``h``, at least ``n`` of
    them and, but for repeated rows, little more: the others are dropped where they lie."""
    share = (n + 6 * n ** 0.5 + 10) / max(1, rows)
    while share < 1:
        passed = df.where(F.col("h") < F.lit(int(share * (1 << 64)) - (1 << 63)))
        if passed.count() >= n:
            return passed
        share *= 2
    return df


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  trees: int = TREES, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Per row: ``doc_id``, the counts of COUNTS and MORE_COUNTS, the rates of RATES, ``base_failed``,
    ``anomaly`` and ``kept``.

    The statistics are computed over all documents and written once.  Each tree of the
    isolation forest is grown, in a task of its own, on ``tree_rows`` documents: those
    that come first in the order of a hash, so the sample is spread over the whole table
    and does not depend on partitions.  (A bounded sample is what the method asks for:
    trees * tree_rows rows.)  All documents are scored.  The threshold is calibrated on
    all rows with a ``labels.quality``, by a histogram of fixed size.

    Null and empty texts have no words and fail the base rules.  A null id is scored, but
    has no label.  Repeated rows get equal results.  With no rows, or no labels of both
    kinds, the forest rejects nothing.
    """
    spark = docs.sparkSession

    def measure(batch):
        rows = [rule_statistics(x) for x in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))],
            names=["doc_id", *COUNTS, *MORE_COUNTS])

    src = select_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    stats = materialize(map_rows(src, measure, STATS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))

    sums = stats.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in ["n_words", "n_text_lines", *RATED]]).first()
    corpus = {c: (sums[c] or 0) / max(1, sums[per] or 0) for c, (per, _) in PER.items()}
    rate = {c: (F.col(c) + prior * corpus[c]) / (F.col(per) + prior) for c, (per, prior) in PER.items()}
    rate["n_repeat_words"] += rate.pop("n_dup_lines")
    rated = stats.withColumns({f"rate_{c}": x for c, x in rate.items()})
    hashed = rated.select("doc_id", *RATES, F.xxhash64(F.lit("sample"), "doc_id", *COUNTS).alias("h"))
    sample = least_hashes(hashed, trees * tree_rows, sums["rows"]).orderBy("h", "doc_id").limit(trees * tree_rows)
    # a table smaller than the sample serves several trees with each row, never one tree twice
    copies = min(trees, max(1, -(-trees * tree_rows // max(1, sums["rows"]))))
    dealt = sample.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn(
        "tree", F.pmod(F.xxhash64("h") + F.col("copy"), F.lit(trees)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        nodes = grow_tree(pdf.sort_values(["h", "doc_id"])[RATES].to_numpy("f8"), tree)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "feature", "split", "left", "path"])

    nodes = (dealt.groupBy("tree")
             .applyInPandas(grow, "tree long, node long, feature long, split double, left long, path double")
             .toPandas().sort_values(["tree", "node"]))
    forest = [g[["feature", "split", "left", "path"]].to_numpy("f8") for _, g in nodes.groupby("tree")]

    def score(batch):
        x = np.column_stack([batch[c].to_numpy() for c in RATES])
        got = anomaly_scores(x, forest, tree_rows)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=[*batch.schema.names, "anomaly"])

    scored = materialize(map_rows(rated, score, f"{STATS}, {', '.join(f'{r} double' for r in RATES)}, anomaly double").withColumn("base_failed", failed))
    marked = scored.where(~F.col("base_failed")).join(labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")), "doc_id")
    bins = (marked.where("quality is not null")
            .groupBy(F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
            .agg(F.count(F.when(F.col("quality") == 1, 1)).alias("good"),
                 F.count(F.when(F.col("quality") != 1, 1)).alias("bad")).collect())
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        good[r["bin"]], bad[r["bin"]] = r["good"], r["bad"]
    threshold = calibrate(good, bad)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(threshold)))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
