"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import portions, select_text
from tillsight.llm.quality_classifier import PREDICT_AT, held_out

#: Windows of so many words, a new one every STRIDE words: they overlap.
WINDOW, STRIDE = 64, 48
WORD_DIM, CHAR_DIM, HIDDEN, TRIGRAMS = 16, 16, 12, 4096
#: Labelled rows that the network is fitted on at most, of each label, and their bytes in
#: all, from which on no further row is taken; a row is taken whole, however long.  A word
#: needs so many rows of that sample for a vector of its own.
FIT_EACH, FIT_BYTES, WORD_ROWS = 1200, 16_000_000, 4
STEPS, BATCH, RATE, WORD_DROP = 300, 32, 0.01, 0.15

WINDOWS_AT_ONCE, WORD_CACHE = 2048, 100_000
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())


def normal_words(text: bytes) -> list[bytes]:
    """Lower-cased words without ASCII marks at their ends; marks alone are a word."""
    return [w.strip(_MARKS) or w[:1] for w in text.lower().split()]


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of `` word ``, one after another, and each word's number."""
    flat = np.frombuffer(b" " + b" ".join(words) + b" ", "u1").astype("i4")
    n = np.array([len(w) for w in words], "i8")
    last = np.cumsum(n + 1)  # where the space after each word is
    codes = (flat[:-2] * 961 + flat[1:-1] * 31 + flat[2:]) * 40503 >> 4 & TRIGRAMS - 1
    keep = np.ones(len(codes), bool)
    keep[last[:-1] - 1] = False  # the trigrams whose middle is the space between two words
    return codes[keep], n


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Word and character inputs, a GRU in each direction, attention, one logit.

    A word's input is its own vector (frequent words of the sample; else a common one)
    beside the mean of its trigrams' vectors.  The gates' share of the input is computed
    once per distinct word.  Leading axis 2: forward, backward.
    """

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        size, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {
            "word": rng.normal(0, 0.1, (len(vocabulary) + 1, WORD_DIM)), "char": rng.normal(0, 0.3, (TRIGRAMS, CHAR_DIM)),
            "wx": rng.normal(0, size ** -0.5, (2, size, 3 * h)), "b": np.zeros((2, 3 * h)),
            "u": rng.normal(0, h ** -0.5, (2, h, 3 * h)), "att": rng.normal(0, 0.3, 2 * h),
            "out": rng.normal(0, (2 * h) ** -0.5, 2 * h), "bias": np.zeros(1)}
        self.p = {k: v.astype("f4") for k, v in self.p.items()}

    def inputs(self, words: list[bytes], drop: np.ndarray | None = None) -> tuple:
        """Inputs of distinct words, and what their gradient needs."""
        codes, n = trigrams(words)
        starts = np.cumsum(n) - n
        chars = np.add.reduceat(self.p["char"][codes], starts, axis=0) / n[:, None]
        own = np.array([self.vocabulary.get(w, 0) for w in words], "i8")
        if drop is not None:
            own = np.where(drop, 0, own)
        return np.concatenate((self.p["word"][own], chars), 1).astype("f4"), own, codes, n

    def gates(self, x: np.ndarray) -> np.ndarray:
        """(words, 2, 3 * HIDDEN)"""
        return (np.einsum("ni,dij->ndj", x, self.p["wx"], optimize=True) + self.p["b"]).astype("f4")

    def forward(self, g: np.ndarray, mask: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, ...]:
        """Logits of windows. g: (B, T, 2, 3H), gates of their words; mask: (B, T)."""
        b, t, _, _ = g.shape
        h = np.zeros((2, b, HIDDEN), "f4")
        states = np.zeros((t, 2, b, HIDDEN), "f4")
        for i in range(t):
            x = np.stack((g[:, i, 0], g[:, t - 1 - i, 1]))
            m = np.stack((mask[:, i], mask[:, t - 1 - i]))[:, :, None]
            u = h @ self.p["u"]
            zr = sigmoid(x[..., :2 * HIDDEN] + u[..., :2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = np.tanh(x[..., 2 * HIDDEN:] + r * u[..., 2 * HIDDEN:])
            new = m * (c + z * (h - c))
            if keep is not None:
                keep.append((h, z, r, c, u[..., 2 * HIDDEN:], m))
            h = new
            states[i] = h
        hidden = np.concatenate((states[:, 0], states[::-1, 1]), 2)  # (T, B, 2H)
        e = np.where(mask.T > 0, hidden @ self.p["att"], -1e9)
        e = np.exp(e - e.max(0))
        alpha = e * (mask.T > 0)
        alpha = alpha / np.maximum(alpha.sum(0), 1e-9)
        pooled = (alpha[:, :, None] * hidden).sum(0)
        return pooled @ self.p["out"] + self.p["bias"][0], hidden, alpha, pooled

    def gradient(self, words, index, mask, dlogit_of, drop=None) -> tuple[float, dict]:
        """Loss and gradient. index: (B, T) into ``words``; dlogit_of(logits) -> (loss, d)."""
        p = self.p
        x, own, codes, n = self.inputs(words, drop)
        g = self.gates(x)[index]
        keep: list = []
        logits, hidden, alpha, pooled = self.forward(g, mask, keep)
        loss, d = dlogit_of(logits)
        grad = {"out": pooled.T @ d, "bias": np.array([d.sum()])}
        dpool = d[:, None] * p["out"]
        da = (dpool[None] * hidden).sum(2)
        de = alpha * (da - (alpha * da).sum(0))
        grad["att"] = np.einsum("tb,tbh->h", de, hidden)
        dhid = alpha[:, :, None] * dpool[None] + de[:, :, None] * p["att"]
        t = len(hidden)
        dg = np.zeros_like(g)
        dh, du_w = np.zeros((2, len(mask), HIDDEN), "f4"), np.zeros_like(p["u"])
        for i in range(t - 1, -1, -1):
            h, z, r, c, uc, m = keep[i]
            dn = m * (dh + np.stack((dhid[i, :, :HIDDEN], dhid[t - 1 - i, :, HIDDEN:])))
            dc = dn * (1 - z) * (1 - c * c)
            dz = dn * (h - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            du = np.concatenate((dz, dr, dc * r), 2)
            dx = np.concatenate((dz, dr, dc), 2)
            dg[:, i, 0] += dx[0]
            dg[:, t - 1 - i, 1] += dx[1]
            du_w += h.transpose(0, 2, 1) @ du
            dh = dn * z + du @ p["u"].transpose(0, 2, 1)
        grad["u"] = du_w
        flat = index.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        per_word = np.zeros((len(words), 2, 3 * HIDDEN), "f4")
        per_word[flat[order[first]]] = np.add.reduceat(dg.reshape(-1, 2, 3 * HIDDEN)[order], first, axis=0)
        grad["b"] = per_word.sum(0)
        grad["wx"] = np.einsum("ni,ndj->dij", x, per_word, optimize=True)
        dx = np.einsum("ndj,dij->ni", per_word, p["wx"], optimize=True)
        grad["word"] = np.zeros_like(p["word"])
        np.add.at(grad["word"], own, dx[:, :WORD_DIM])
        grad["char"] = np.zeros_like(p["char"])
        np.add.at(grad["char"], codes, np.repeat(dx[:, WORD_DIM:] / n[:, None], n, axis=0))
        return loss, grad


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over ``n`` words; the last ends with the text, and a text
    without words has one empty window."""
    starts = range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)
    return [(a, min(n, a + WINDOW)) for a in starts]


def padded(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word codes and mask of the windows ``flat[start:start + n]``, as wide as the longest."""
    place = np.arange(max(1, int(n.max())))
    mask = (place < n[:, None]).astype("f4")
    index = np.zeros(mask.shape, "i8")
    index[mask > 0] = flat[(start[:, None] + place)[mask > 0]]
    return index, mask


def fit(texts: list[bytes], toxic: np.ndarray, seed: int = 0) -> Network:
    """Fit on whole documents: a document's logit is that of its most toxic window, so the
    windows need no labels of their own.  A step first scores all windows of its documents,
    some at a time, and then learns from the highest of each, which alone has a gradient."""
    rng = np.random.default_rng(seed)
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in normal_words(x)], "i4") for x in texts]
    names = list(number)
    seen = np.zeros(len(names), "i4")
    for doc in docs:
        seen[np.unique(doc)] += 1
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, c in zip(names, seen, strict=True) if c >= WORD_ROWS))}
    net = Network(vocabulary, seed)
    net.p["bias"][0] = -1
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    while step < STEPS and names:
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            distinct, flat = np.unique(np.concatenate([docs[r] for r in rows]), return_inverse=True)
            if not len(distinct):
                continue
            words, drop = [names[c] for c in distinct], rng.random(len(distinct)) < WORD_DROP
            starts = np.cumsum([0, *(len(docs[r]) for r in rows)])
            spans = [(i, starts[i] + a, b - a) for i, row in enumerate(rows) for a, b in windows(len(docs[row]))]
            owner, first, n = np.array(spans).T
            table = net.gates(net.inputs(words, drop)[0])
            logits = np.concatenate([net.forward(table[index], mask)[0] for index, mask in (
                padded(flat, first[k:k + WINDOWS_AT_ONCE], n[k:k + WINDOWS_AT_ONCE])
                for k in range(0, len(spans), WINDOWS_AT_ONCE))])
            best = np.array([np.flatnonzero(owner == i)[np.argmax(logits[owner == i])] for i in range(len(rows))])
            index, mask = padded(flat, first[best], n[best])
            used, index = np.unique(index, return_inverse=True)
            y = toxic[rows]

            def slope(z, y=y):
                return float(np.mean(np.logaddexp(0, np.where(y == 1, -z, z)))), ((sigmoid(z) - y) / len(y)).astype("f4")

            _, grad = net.gradient([words[c] for c in used], index.reshape(mask.shape), mask, slope, drop[used])
            step += 1
            rate = RATE * min(1, 2 * max(0, 1 - step / STEPS) + 0.05)
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)).astype("f4")
    return net


class Scorer:
    """Scores documents by their most toxic window; keeps the gates of words seen before."""

    def __init__(self, net: Network):
        self.net, self.known = net, {}
        self.table = np.zeros((1, 2, 3 * HIDDEN), "f4")

    def codes(self, words: list[bytes]) -> np.ndarray:
        distinct = set(words)
        if len(self.known) + len(distinct) > WORD_CACHE:
            self.known, self.table = {}, self.table[:1]
        new = [w for w in distinct if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate((self.table, self.net.gates(self.net.inputs(new)[0])))
        return np.fromiter(map(self.known.__getitem__, words), "i4", len(words))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        split = [normal_words(x) for x in texts]
        flat = self.codes([w for x in split for w in x])
        spans, owner, at = [], [], 0
        for i, x in enumerate(split):
            for a, b in windows(len(x)):
                spans.append((at + a, b - a))
                owner.append(i)
            at += len(x)
        spans, owner = np.array(spans), np.array(owner)
        best = np.full(len(texts), -np.inf)
        for k in range(0, len(spans), WINDOWS_AT_ONCE):
            index, mask = padded(flat, *spans[k:k + WINDOWS_AT_ONCE].T)
            logits = self.net.forward(self.table[index], mask)[0]
            np.maximum.at(best, owner[k:k + WINDOWS_AT_ONCE], logits)
        return sigmoid(best)


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row.

    The network is fitted on the driver on at most FIT_EACH labelled rows of each label
    that are not held out, first in the order of a hash, whole whatever their length; a
    label's rows end with the one that brings them to FIT_BYTES bytes.  Its size is fixed.  Scoring runs in tasks over whole texts: every overlapping
    window is scored, and a document's score is its highest.  Nothing is shuffled but the
    labelled rows.

    Empty and null texts have one empty window and the score of no input.  Rows with a
    null id or label are never learned from.  Without labels of both kinds the score is
    the share of label 1 (0 with no labels).  Repeated rows stay.
    """
    src = select_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(
        F.col("y").isNotNull() & ~held_out("doc_id", modulus, remainder))
    order = F.struct(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
    sizes = src.select("doc_id", order.alias("o"), F.length("text").alias("size")).join(marks, "doc_id")

    def first_rows(label: int) -> list:
        """The rows are chosen by hashes and sizes; only the texts of the chosen are moved."""
        rows = sizes.where(F.col("y") == label).select("o", "size").orderBy("o").limit(FIT_EACH).collect()
        total = np.cumsum([r["size"] for r in rows])
        n = min(len(rows), int(np.searchsorted(total, FIT_BYTES)) + 1)
        if not n:
            return []
        last = rows[n - 1]["o"]
        chosen = src.withColumn("o", order).where(
            F.col("o") <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["t"]).alias("t")))
        return chosen.join(marks.where(F.col("y") == label), "doc_id").orderBy("o").limit(n).select("text", "y").collect()

    parts = [first_rows(k) for k in (1, 0)]
    sample = [r for part in parts for r in part]
    prior = marks.agg(F.avg("y")).first()[0] if not all(parts) else None
    net = fit([bytes(r["text"]) for r in sample], np.array([r["y"] for r in sample], "f4")) if all(parts) else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for batch in portions(batches):
            texts = batch["text"].to_pylist()
            got = scorer.scores(texts) if scorer else np.full(len(texts), prior or 0.0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(got.astype("f8"))], names=["doc_id", "score"])

    return src.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
