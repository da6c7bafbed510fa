"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tillsight.llm.common import join_rows, map_rows, portions, row_id, select_rows, select_text
from tillsight.session import materialize

#: Word buckets, dimensions, entries of an index vector that are not 0, neighbours on each side.
BUCKETS, DIM, NONZERO, NEAR = 8192, 16, 4, 2
#: Labelled rows that the network is fitted on at most, first in the order of a hash.
FIT_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 0.004, 1e-4
PREDICT_AT = 0.7

WORDS_AT_ONCE, WORD_CACHE = 64_000, 150_000
AGAIN = 0  # the bucket of "same word as before"
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
_CLASSES = bytes(65 if chr(c).isupper() and c < 128 else 48 if chr(c).isdigit() and c < 128 else
                 c if c in _MARKS else 97 for c in range(256))


def word_buckets(words: list[bytes]) -> np.ndarray:
    """For each word the buckets of its lower-cased letters and of its shape: the classes of
    its first two and last three characters (capital, other letter, digit, or the mark itself)."""
    shapes = [x[:2] + b" " + x[-3:] for x in (w.translate(_CLASSES) for w in words)]
    places = {x: zlib.crc32(x) for x in set(shapes)}
    stems = np.array([zlib.crc32(w.lower().strip(_MARKS)) for w in words], "u4")
    shapes = np.array([places[x] for x in shapes], "u4")
    return (np.stack((stems, shapes), 1) % (BUCKETS - 1) + 1).astype("u2")


def index_vectors() -> np.ndarray:
    """A sparse random +-1 vector for each bucket, the same in every task."""
    rng = np.random.default_rng(7)
    out = np.zeros((BUCKETS, DIM), "i4")
    for row in out:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


class Words:
    """Texts to bucket arrays, with a bounded cache of words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.buckets = np.zeros((0, 2), "u2")

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stem and shape buckets of all words, where a word repeats the one before it in
        its text, and each text's number of words."""
        split = [x.split() for x in texts]
        flat = list(chain.from_iterable(split))
        distinct = set(flat)
        if len(self.known) + len(distinct) > WORD_CACHE:
            self.known.clear()
            self.buckets = self.buckets[:0]
        new = [w for w in distinct if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.buckets = np.concatenate((self.buckets, word_buckets(new)))
        code = np.fromiter(map(self.known.__getitem__, flat), "i4", len(flat))
        n = np.array([len(x) for x in split], "i8")
        same = np.zeros(len(code), bool)
        same[1:] = code[1:] == code[:-1]
        ends = np.cumsum(n)
        same[ends[:-1][ends[:-1] < len(code)]] = False
        stem, shape = self.buckets[code].T
        return stem, shape, same, n


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Rows' keys and texts, about WORDS_AT_ONCE words at a time."""
    rows, texts, size = [], [], 0
    for batch in portions(batches):
        for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True):
            rows.append(row)
            texts.append(text)
            size += len(text)
            if size >= 6 * WORDS_AT_ONCE:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _sum_rows(values: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
    """out[to[i]] += values[i], for rows."""
    order = np.argsort(to, kind="stable")
    first = np.flatnonzero(np.diff(to[order].astype("i4"), prepend=-1))
    if len(first):
        out[to[order[first]]] += np.add.reduceat(values[order], first, axis=0)


def context_counts(docs: DataFrame) -> DataFrame:
    """``(bucket, c0, c1, ...)``: for each bucket the sum of the index vectors of its
    neighbours over the whole corpus; integers, so no order of adding matters."""
    def count(batches):
        index, words = index_vectors(), Words()
        total = np.zeros((BUCKETS, DIM), "i8")
        for _, texts in _portions(batches):
            stem, shape, _, n = words.read(texts)
            if not len(stem):
                continue
            own = index[stem] + index[shape]
            doc = np.repeat(np.arange(len(n)), n)
            around = np.zeros_like(own)
            for k in range(1, NEAR + 1):
                near = (doc[k:] == doc[:-k])[:, None]
                around[k:] += own[:-k] * near
                around[:-k] += own[k:] * near
            _sum_rows(around, stem, total)
            _sum_rows(around, shape, total)
        used = np.flatnonzero(total.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(total[used, i]) for i in range(DIM))],
                                             names=["bucket", *(f"c{i}" for i in range(DIM))])

    cols = [f"c{i}" for i in range(DIM)]
    return (docs.select(F.lit(0).alias("row"), "text").mapInArrow(count, "bucket int, " + ", ".join(f"{c} long" for c in cols))
            .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in cols]))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vectors of all buckets: unit context vector plus own index vector.  A table of
    fixed size, whatever the corpus."""
    rows = context_counts(docs).toPandas()
    context = np.zeros((BUCKETS, DIM))
    context[rows["bucket"].to_numpy("i8")] = rows[[f"c{i}" for i in range(DIM)]].to_numpy("f8")
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return (context / np.maximum(norm, 1e-9) + index_vectors() / np.sqrt(NONZERO)).astype("f4")


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """``(row, v array<float>)`` of ``(row, text)``: means over a text's words of the stems' vectors, of the
    shapes' vectors, and of the vector of a repeated word."""
    key = to_arrow_type(docs.schema["row"].dataType)

    def pool(batches):
        words = Words()
        for rows, texts in _portions(batches):
            stem, shape, same, n = words.read(texts)
            out = np.zeros((len(n), 2 * DIM), "f4")
            full = np.flatnonzero(n)
            if len(full):
                starts = (np.cumsum(n) - n)[full]
                out[full, :DIM] = np.add.reduceat(vectors[stem], starts, axis=0)
                out[full, DIM:] = np.add.reduceat(vectors[shape] + same[:, None] * vectors[AGAIN], starts, axis=0)
                out[full] /= n[full, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, key), pa.array(list(out), pa.list_(pa.float32()))], names=["row", "v"])

    return docs.mapInArrow(pool, T.StructType([docs.schema["row"], T.StructField("v", T.ArrayType(T.FloatType()))]))


class Network:
    """Two layers: tanh units, then one logistic unit whose logit is divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.fitted = 0 < y.sum() < len(y)
        if not self.fitted:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        self.w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        order = rng.permutation(len(x))
        hold = order[:max(1, len(x) // 5)]  # for the temperature only
        order = order[len(hold):]
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        m = [np.zeros_like(a) for a in self.w]
        v = [np.zeros_like(a) for a in self.w]
        step = 0
        for _ in range(EPOCHS):
            for at in range(0, len(order), BATCH):
                rows = order[at:at + BATCH]
                h = np.tanh(x[rows] @ self.w[0] + self.w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3][0], -30, 30)))
                d = (p - y[rows]) * weight[rows] / len(rows)
                dh = np.outer(d, self.w[2]) * (1 - h * h)
                grads = [x[rows].T @ dh + DECAY * self.w[0], dh.sum(0), h.T @ d + DECAY * self.w[2], np.array([d.sum()])]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
            order = rng.permutation(order)
        self.temperature = 1.0
        z, best = self._logit(x[hold]), np.inf
        for t in np.geomspace(0.25, 8, 41):
            loss = np.mean(np.logaddexp(0, np.where(y[hold] == 1, -z, z) / t))
            if loss < best - 1e-9:
                best, self.temperature = loss, float(t)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        z = self._logit((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(id_col: str, modulus: int, remainder: int):
    """True where crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row.

    Pass 1, over all documents: random indexing.  Every word (its letters, and its shape)
    falls into one of BUCKETS, each with a sparse random vector; a bucket's context vector
    is the sum of its neighbours' vectors over the corpus.  Tasks send one partial sum per
    bucket, so neither a frequent word nor the vocabulary's size matters.  Pass 2 pools the
    vectors of each document.  A two-layer numpy network is fitted on at most FIT_ROWS
    labelled rows that are not held out, a fifth of them used for the temperature that
    calibrates its probabilities; then all documents are scored.

    Null and empty texts have the zero vector, and the score the network gives to it.
    Rows with a null id or label are never learned from.  Without labels of both kinds,
    the score is the share of label 1 (0.5 with no labels).  Repeated rows stay.
    """
    src = select_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return _scored(src.withColumnRenamed("doc_id", "row"), F.col("row"), labels, modulus, remainder).select(
        F.col("row").alias("doc_id"), held_out("row", modulus, remainder).alias("held_out"), "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def _scored(src: DataFrame, doc_id: Column, labels: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """``(row, score)`` of ``(row, text)``; ``doc_id`` is the id in ``row``."""
    vectors = word_vectors(src)
    rows = materialize(pooled(src, vectors))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(
        F.col("y").isNotNull() & ~held_out("doc_id", modulus, remainder))
    fit = (rows.select(doc_id.alias("doc_id"), "v").join(marks, "doc_id").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "v").limit(FIT_ROWS)
           .select("v", "y").toPandas())
    x = np.array(fit["v"].tolist(), "f8").reshape(-1, 2 * DIM)
    network = Network(x, (fit["y"].to_numpy("f8") == 1).astype("f8"))

    def score(batch):
        x = batch["v"].flatten().to_numpy().reshape(-1, 2 * DIM).astype("f8")
        return pa.RecordBatch.from_arrays([batch["row"], pa.array(network.scores(x))], names=["row", "score"])

    return map_rows(rows, score, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def without_rejected(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """``docs`` without the rows predicted 0; same columns.  Each row is judged by its own
    text, rows that share an id or have none too."""
    scores = _scored(select_rows(docs), row_id(), labels, modulus, remainder)
    return join_rows(docs, scores.where(F.col("score") < PREDICT_AT).select("row").distinct(), "left_anti")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
