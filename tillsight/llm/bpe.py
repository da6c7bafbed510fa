"""BPE encoding and decoding: greedy tokens proposed, adjacent pairs verified in bulk."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import select_text
from tillsight.llm.words import Generations, byte_slices, gathered

#: Entries of one generation of a cache (about 200 bytes each, two generations).
CACHED = 200_000
#: Stands for the tokenizer's end-of-word suffix: no byte-level letter.
END = "\n"
NEVER = np.iinfo("int64").max

_PLAIN = re.compile(rb"[!-~]+")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_CODECS: dict[str, Bpe] = {}  # by path: a reused Python worker keeps its caches


class Bpe:
    """A byte-pair tokenizer with an end-of-word suffix, read from its ``tokenizers`` file.

    A word is encoded by proposing the longest token at each place and then testing every
    two neighbours: they are compatible if no merge across their border comes before
    the merges that built them.  A sequence of tokens is the tokenizer's own exactly if all
    its neighbours are compatible; the other words are merged step by step.
    """

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        if model["type"] != "BPE" or not suffix or model["continuing_subword_prefix"] or model["dropout"]:
            raise ValueError("a BPE model with an end-of-word suffix and no other options is needed")
        if spec["decoder"] is not None:
            raise ValueError("decoding joins tokens by spaces; this tokenizer has a decoder of its own")
        library = Tokenizer.from_file(path)
        self.normalize, self.pieces = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.markers = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.marks = [s.encode() for s in self.special]

        size = max([*vocab.values(), *self.special.values()]) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], "int64") for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], "int64")
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges make one token")
        self.size, self.rank = size, np.full(size, -1, "int64")
        self.rank[made] = np.arange(len(made))
        if (np.maximum(self.rank[left], self.rank[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge comes before the merges of its parts")
        self.left, self.right = np.full((2, size), -1, "int64")
        self.left[made], self.right[made] = left, right
        key = left * size + right
        order = np.argsort(key)
        self.pair_keys, self.pair_ranks = key[order], order
        self.merge = {(int(a), int(b)): (i, int(c)) for i, (a, b, c) in enumerate(zip(left, right, made, strict=True))}

        # the letters a token stands for, with END for the suffix, built from its parts
        letters: list[str | None] = [None] * size
        for t, i in vocab.items():
            if len(t) == 1:
                letters[i] = t
            elif len(t) == 1 + len(suffix) and t.endswith(suffix):
                letters[i] = t[0] + END
        for a, b, c in zip(left, right, made, strict=True):
            letters[c] = letters[a] + letters[b]
        usable = np.ones(size, bool)  # a token that its own letters don't lead to is never proposed
        usable[made] = self.compatible(left, right, np.arange(len(made)))
        for a, b, c in zip(left, right, made, strict=True):
            usable[c] &= usable[a] and usable[b]
        self.tokens = {s: i for i, s in enumerate(letters) if s is not None and usable[i]}
        self.longest = max(map(len, self.tokens))

        text = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.spaced = pa.array([(text.get(i, "") + " ").encode() for i in range(size)], pa.large_binary())
        self.words, self.chunks = Generations(cached), Generations(cached)
        self.proposed = self.merged = 0

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For every two neighbours a, b: does no merge across their border come before those
        that built them (and before the merge number ``until``)?

        Walks back in time over all pairs at once: of the two tokens at the border the one
        made last is undone into the part that touches the border.  A merge of the two
        current tokens counts if it precedes the merges that ended them.  Of two equal
        merges the left one comes first, so b's is undone first.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.copy(), b.copy()
        ends_a = np.full(len(a), NEVER) if until is None else until.copy()
        ends_b = np.full(len(a), NEVER - 1) if until is None else until - 1
        while len(at):
            key = a * self.size + b
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merge = np.where(self.pair_keys[place] == key, self.pair_ranks[place], NEVER)
            bad = (merge < ends_a) & (merge <= ends_b)
            ok[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            undo_a = ra > rb
            go = ~bad & ((ra >= 0) | (rb >= 0))
            ends_a, ends_b = np.where(undo_a, ra, ends_a)[go], np.where(undo_a, ends_b, rb)[go]
            a, b, at = np.where(undo_a, self.right[a], a)[go], np.where(undo_a, b, self.left[b])[go], at[go]
        return ok

    def propose(self, word: str) -> list[int]:
        """The longest token at each place of ``word``, which ends in END; END is left to
        no token alone."""
        out, at, n, tokens = [], 0, len(word), self.tokens
        while at < n:
            stop = min(n, at + self.longest)
            while stop == n - 1 or (i := tokens.get(word[at:stop])) is None:
                stop -= 1
            out.append(i)
            at = stop
        return out

    def exact(self, word: str) -> list[int]:
        """``word`` merged by rank, the first of equals first."""
        last = len(word) - 2
        ids = [self.tokens[c] for c in word[:last]] + [self.tokens[word[last:]]]
        get = self.merge.get
        if last > 40:
            return self._exact_long(ids)
        none = (NEVER, 0)
        while len(ids) > 1:
            found = [get(pair, none) for pair in zip(ids, ids[1:])]
            best = min(found)
            if best is none:
                break
            at = found.index(best)
            ids[at:at + 2] = [best[1]]
        return ids

    def _exact_long(self, ids: list[int]) -> list[int]:
        """The same by a queue of merges, for words of any length."""
        last = len(ids) - 1
        get, after, before = self.merge.get, list(range(1, last + 2)), list(range(-1, last + 1))
        queue = [(found[0], i, found[1]) for i in range(last) if (found := get((ids[i], ids[i + 1]))) is not None]
        heapify(queue)
        while queue:
            rank, i, made = heappop(queue)
            j = after[i]
            if ids[i] < 0 or j > last or get((ids[i], ids[j])) != (rank, made):
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] <= last:
                before[after[i]] = i
                if (found := get((made, ids[after[i]]))) is not None:
                    heappush(queue, (found[0], i, found[1]))
            if before[i] >= 0 and (found := get((ids[before[i]], made))) is not None:
                heappush(queue, (found[0], before[i], found[1]))
        return [i for i in ids if i >= 0]

    def learn_words(self, new: list[str]) -> None:
        """Encode ``new`` words (each ends in END): propose, verify all pairs at once, mend."""
        proposals = [self.propose(w) for w in new]
        flat = np.fromiter((i for p in proposals for i in p), "int64")
        ends = np.cumsum([len(p) for p in proposals])
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[ends[:-1] - 1] = False
        a = np.flatnonzero(inner)
        bad = a[~self.compatible(flat[a], flat[a + 1])]
        for k in np.unique(np.searchsorted(ends, bad, "right")).tolist():
            proposals[k] = self.exact(new[k])
            self.merged += 1
        self.proposed += len(new)
        self.words.update((w, np.array(p, "<u4").tobytes()) for w, p in zip(new, proposals, strict=True))

    def split(self, chunk: bytes) -> list:
        """A chunk without white space as words (each with END), and ids of special tokens."""
        if _PLAIN.fullmatch(chunk) and not any(m in chunk for m in self.marks):
            return [w + END for w in _ASCII_WORDS.findall(chunk.decode().lower())]
        out: list = []
        text = chunk.decode("utf-8", "replace")
        for part in self.markers.split(text) if self.markers else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [w + END for w, _ in self.pieces(self.normalize(part))]
        return out

    def ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each distinct chunk, four bytes little-endian each."""
        self.chunks.turn()
        unknown = self.chunks.missing([c for c in chunks if c not in self.chunks])
        if unknown:
            parts = [self.split(c) for c in unknown]
            self.words.turn()
            words = self.words
            new = words.missing({w for p in parts for w in p if isinstance(w, str) and w not in words})
            if new:
                self.learn_words(new)
            self.chunks.update((c, b"".join([words[w] if isinstance(w, str) else np.array([w], "<u4").tobytes() for w in p]))
                               for c, p in zip(unknown, parts, strict=True))
        return list(map(self.chunks.__getitem__, chunks))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ends)`` of a binary array without nulls; text i has ids[ends[i]:ends[i + 1]]."""
        data, ends = gathered(texts, self.ids_of)
        return np.frombuffer(data, "<u4", int(ends[-1]) // 4) if len(data) else np.empty(0, "<u4"), ends // 4

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
        """The text of each stretch of ids, as UTF-8: its tokens, suffixes shown, joined by spaces."""
        taken = self.spaced.take(pa.array(ids.astype("int64")))
        _, offsets, data = taken.buffers()
        if data is None or not len(ids):
            return [memoryview(b"")] * (len(ends) - 1)
        at = np.frombuffer(offsets, "int64", len(ids) + 1)[ends].tolist()
        view = memoryview(data)
        return [view[i:max(i, j - 1)] for i, j in zip(at, at[1:])]


def codec(path: str) -> Bpe:
    """The tokenizer of ``path``, read once per Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Bpe(path)
    return _CODECS[path]


def bpe_round(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
              with_ids: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` and, ``with_ids``, ``ids`` (binary,
    four bytes little-endian each) and ``decoded``: one row per document, no shuffle.

    The ids are the ``tokenizers`` library's without special tokens added (those that
    stand in the text are recognised); decoded is its ``decode(ids, skip_special_tokens=
    False)``.  Null and empty texts have no ids; null and repeated ids of documents are kept.
    Bytes that are no UTF-8 count as U+FFFD.  An empty table gives no rows.  The tokenizer
    file must lie at ``tokenizer_path`` on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for part in byte_slices(batches, "text"):
            ids, ends = bpe.encode(part["text"])
            data, at = memoryview(ids.tobytes()), (4 * ends).tolist()
            each = [data[i:j] for i, j in zip(at, at[1:])]
            decoded = bpe.decode(ids, ends)
            columns = [part["doc_id"], pa.array(np.diff(ends)),
                       pa.array([hashlib.sha256(x).hexdigest() for x in each]),
                       pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
            if with_ids:
                columns += [pa.array([bytes(x) for x in each], pa.binary()),
                            pa.array([bytes(x).decode() for x in decoded], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    src = select_text(docs, id_col, text_col)
    id_type = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return src.mapInArrow(run, schema + (", ids binary, decoded string" if with_ids else ""))


def op13_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_round(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
