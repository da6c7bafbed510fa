"""Secret scans: fixed patterns, and windows of high character entropy."""

from __future__ import annotations

import re
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import map_rows, select_text

# Fixed patterns of the base kinds, on the lower-cased text (assign) or the text itself;
# and the least length of a match (of group 1 for assign).
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates: runs of so many characters that may stand in a key.
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
#: Character classes, the narrowest first: name, runs as long as the window, window, least
#: entropy in bits.  A window of w characters has log2(w) bits at most, and log2 of the
#: class's size.
CLASSES = (
    ("digits", re.compile(rb"[0-9]{24,}"), 24, 3.1),
    ("hex", re.compile(rb"[0-9A-Fa-f]{24,}"), 24, 3.2),
    ("lower", re.compile(rb"[a-z]{24,}"), 24, 3.5),
    ("upper", re.compile(rb"[A-Z]{24,}"), 24, 3.5),
    ("alphanumeric", re.compile(rb"[0-9A-Za-z]{20,}"), 20, 3.7),
    ("base64", re.compile(rb"[0-9A-Za-z+/_=-]{20,}"), 20, 3.9),
)
#: Spans that lie in one of these are suppressed: web addresses, UUIDs, one repeated
#: character, and values that say they are samples.
ALLOWED = (
    re.compile(rb"(?i)\b[a-z][a-z0-9+.-]*://[^\s\"'<>]+"),
    re.compile(rb"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"),
    re.compile(rb"([0-9A-Za-z+/_=-])\1{7,}"),
    re.compile(rb"(?i)[a-z0-9+/_=-]*(?:example|sample|dummy|placeholder|xxxx)[a-z0-9+/_=-]*"),
)
#: Words, words joined by dashes, underscores or slashes, and file paths are suppressed
#: where they read like words: at least WORDLIKE of the span's pairs of adjacent letters
#: are among the frequent ones.
WORDS = re.compile(rb"/?[A-Za-z]+[0-9]?(?:[/_-]+[A-Za-z]+[0-9]?)*/?")
WORDLIKE = 0.25
# Frequent letter pairs of English, German, French and Spanish words.
FREQUENT_PAIRS = frozenset(
    b"ac al an ar as at be ce ch co de di ea ed ei el en er es et ge ha he hi ic ie il in io is it "
    b"la le li ll ma me nd ne ng nt of om on or ou qu ra re ri ro se si st ta te th ti to un ur us ve".split())
#: What is left of a span beside a base match stays from this length on.
MIN_REST = 8


def entropy_spans(s: bytes, window: int, least: float) -> list[tuple[int, int]]:
    """Maximal runs covered by windows of ``s`` whose Shannon entropy is at least ``least``.

    The window slides by one character; its entropy is log2(w) - sum(c * log2 c) / w over
    the counts c, and only the two counts that change are worked on.
    """
    n = len(s)
    if n < window:
        return []
    part = [0.0] + [c * log2(c) for c in range(1, window + 1)]
    counts, weight = [0] * 256, 0.0
    most = (log2(window) - least) * window + 1e-9
    spans: list[tuple[int, int]] = []
    for i, ch in enumerate(s):
        if i >= window:
            out = s[i - window]
            c = counts[out]
            counts[out] = c - 1
            weight += part[c - 1] - part[c]
        c = counts[ch]
        counts[ch] = c + 1
        weight += part[c + 1] - part[c]
        if i >= window - 1 and weight <= most:
            a, b = i - window + 1, i + 1
            if spans and spans[-1][1] >= a:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
    return spans


def wordlike(span: bytes) -> bool:
    """Whether the letters of ``span`` pair up as those of words do; random letters do so
    in about a tenth of their pairs."""
    low = span.lower()
    pairs = [low[i:i + 2] for i in range(len(low) - 1) if low[i:i + 2].isalpha()]
    return bool(pairs) and sum(x in FREQUENT_PAIRS for x in pairs) >= WORDLIKE * len(pairs)


def stepwise(span: bytes) -> bool:
    """Whether most characters are the successor of the one before, as in an alphabet."""
    return 2 * sum(b - a == 1 for a, b in zip(span, span[1:])) > len(span)


def _allowed(text: bytes, a: int, b: int) -> bool:
    low, high = max(0, a - 200), b + 200
    return (stepwise(text[a:b])
            or any(m.start() <= a and b <= m.end() for p in ALLOWED for m in p.finditer(text, low, high))
            or wordlike(text[a:b]) and any(m.start() <= a and b <= m.end() for m in WORDS.finditer(text, low, high)))


def _outside(a: int, b: int, base: list[tuple[int, int]], text: bytes) -> list[tuple[int, int]]:
    """The parts of ``[a, b)`` that no base span covers; beside one, separators are trimmed
    and parts shorter than MIN_REST are not kept."""
    parts, at = [], a
    for x, y in base:
        if x < b and at < y:
            parts.append((at, x))
            at = max(at, y)
    if at == a:
        return [(a, b)]
    out = []
    for x, y in [*parts, (at, b)]:
        while x < y and text[x] in b"+/_=-":
            x += 1
        while x < y and text[y - 1] in b"+/_=-":
            y -= 1
        if y - x >= MIN_REST:
            out.append((x, y))
    return out


def _candidate_spans(text: bytes, start: int, end: int, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of high entropy of the candidate ``text[start:end]``; ``base`` are base spans by start.

    Every class slides its own window over each of its maximal runs, so a key glued to a
    name is seen with the threshold of its own characters.  Base spans are cut out of the
    spans, parts that are allowed leave; what is left of all classes is joined where it
    overlaps.
    """
    base = [(x, y) for x, y in base if x < end and start < y]
    spans = []
    for _, runs, window, least in CLASSES:
        for run in runs.finditer(text, start, end):
            at = run.start()
            for a, b in entropy_spans(run[0], window, least):
                spans += _outside(at + a, at + b, base, text)
    joined: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if _allowed(text, a, b):
            continue
        if joined and joined[-1][1] > a:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def find_secrets(text: bytes) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then kind as in KINDS."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text.lower()) if len(m[1]) >= MIN_VALUE]
    if b"AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in found)
    for m in CANDIDATE.finditer(text):
        found += [("entropy", a, b) for a, b in _candidate_spans(text, *m.span(), base)]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    if found and not text.isascii():
        points = np.concatenate(([0], np.cumsum((np.frombuffer(text, "u1") & 0xC0) != 0x80)))
        found = [(k, int(points[a]), int(points[b])) for k, a, b in found]
    return found


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end>>)``, one row per input row, spans in
    code points, end exclusive, by start and then kind.

    The base kinds assign, access and hex are leftmost, non-overlapping matches of fixed
    patterns.  Kind entropy adds the stretches of key-like strings where the sliding windows
    of any character class, over that class's runs, have a high entropy, less what base
    spans cover and what lies within an allowed form (addresses, UUIDs, samples, and words
    and paths whose letters pair up as in words).

    Each text is scanned whole, in its own row; nothing is shuffled.  Null and empty
    texts have no spans.  Null ids, repeated rows and an empty table pass through.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batch):
        spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_secrets(x)]
                 for x in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, kind)], names=["doc_id", "spans"])

    src = select_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return map_rows(src, scan, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def op8_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = secret_spans(docs)

    def joined(keep):
        return F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *map(count, KINDS[:3]),
                        F.sha2(joined(lambda s: s["kind"] != "entropy"), 256).alias("base_sha256"),
                        joined(lambda s: F.lit(True)).alias("spans"))
