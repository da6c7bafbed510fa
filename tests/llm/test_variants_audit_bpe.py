"""Spelling variants, filter audit and BPE against brute force, with the odd rows."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tillsight.llm import bpe, filter_audit, spelling
from tillsight.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, word string, n int, row int, part string, f int"
PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def odd_rows():
    rng = np.random.default_rng(5)
    words = ["Straße", "straẞe", "naïveté", "naivete", "naïvete", "aaaaaa", "aaaaaaa", "aaaaab", "listen", "silent", "LISTEN",
             "listens", "liste×n", "aux÷ours", "receive", "recieve", "receives", "ÀÉÎÕÜß", "àéîõüß", "x", "of", "No. 5", "#1", "a|b"]
    words += ["".join(rng.choice(list("abcé"), 6)) for _ in range(40)]

    def prose(n):
        return " ".join(rng.choice(words, n))

    texts = [None, "", " ", "\n\n", "one", prose(400) * 40, "receive " * 3000 + "listen " * 900, "SHOUTING ALL THE TIME", prose(60)]
    texts += [prose(int(k)) for k in rng.integers(5, 120, 60)]
    texts += [texts[9], texts[9], texts[9], None, "a\x00b  c\u0085d", "<|endoftext|>x<|startoftext|> <|", "I'LL İstanbul ΣΑΣ 漢字🙂"]
    rows = [(i, t, "en", ["a", "b", None, ""][i % 4], "w", 1, 2, "p", 3) for i, t in enumerate(texts)]
    return rows + [rows[12], rows[12], (None, texts[9], "en", "a", None, None, None, None, None), (3, texts[9], None, "a", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(x):
    return x.translate({c: c + 32 for c in range(65, 91)})


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows, min_chars=6, min_count=5, times=5, drop=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % drop == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


@pytest.mark.parametrize("drop,partitions", [(199, 4), (3, 4), (3, 3)])
def test_spelling_variants(docs, drop, partitions):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = spelling.spelling_variants(docs, drop_one_in=drop, partitions=partitions)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(rows, drop=drop)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(w[1] for w in want) and any(w[4] > 1 for w in want)


def test_spelling_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("z", "w5")]
    got = dict(map(tuple, spelling._roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "w37" for w, _ in chain}


def test_spelling_hot_signature(spark, monkeypatch):
    """Every word under few keys, and those cut into salts: no pair is lost or doubled."""
    monkeypatch.setattr(spelling, "HEAVY_SHARE", 10 ** 9)
    words = sorted({f"prefix{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"} | {"prefixab" + "c"})
    got = spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1:] if one_edit(a, b)}
    assert len(got) == len(want) and {tuple(sorted((r["a"], r["b"]))) for r in got} == want


def audit_by_hand(rows, labels):
    ids = {"good": {i for i, q, t in labels if q == 1} - {None}, "toxic": {i for i, q, t in labels if t == 1} - {None}}
    firsts = {}
    for i, text, _ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    docs = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": i is not None and i > firsts[text]}
        docs.append((source or "", {f for f in fails if fails[f]}, i))
    out, total = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                total[part, f] += len(removed)
                left = [d for d in left if f not in d[1]]
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(f in d[1] for d in mine) - len(removed), sum(d[1] == {f} for d in mine),
                    sum(d[2] in ids["good"] for d in removed), sum(d[2] in ids["toxic"] for d in removed)]
    return sorted((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_filter_audit(spark, docs, empty):
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 60)] + [(4, 1, 1), (None, 1, 1), (9, None, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    got = filter_audit.filter_audit(docs, table)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                           "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == audit_by_hand(rows, labels)
    assert filter_audit.filter_audit(empty, table).count() == 0
    alone = filter_audit.filter_audit(docs, table.limit(0)).agg({"good_lost": "sum", "removed": "max"}).first()
    assert sorted(alone)[0] == 0 and sorted(alone)[1] > 0


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_filter_audit"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(ORACLE[name])
    columns = [d[0] for d in res.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, res.fetchall()))


def test_bpe_round(docs, empty):
    got = bpe.bpe_round(docs, PATH)
    for r in got.join(docs.select("doc_id", "text"), "doc_id").where("doc_id <> 3 AND doc_id <> 12").collect():
        ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], bytes(r["ids"])) == (len(ids), np.array(ids, "<u4").tobytes())
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert r["decoded"] == text and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest()
    assert got.count() == docs.count() and bpe.bpe_round(empty, PATH).count() == 0


def test_bpe_query_on_all_texts(spark):
    texts = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    rows = QUERIES["op13_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


LETTERS = st.text(st.sampled_from(list("aeinorstABÉßñİΣς'.,!?<|>/-019 \t\n\u0085\x1c漢🙂́")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(LETTERS, st.text(max_size=20), st.text(st.sampled_from("aehinort"), max_size=90)), max_size=6))
def test_bpe_is_the_library(texts):
    texts = [t for t in texts if t.isprintable() or not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    codec, want = bpe.codec(PATH), LIBRARY.encode_batch(texts, add_special_tokens=False)
    ids, ends = codec.encode(pa.array([t.encode() for t in texts], pa.binary()))
    assert [ids[i:j].tolist() for i, j in zip(ends, ends[1:])] == [e.ids for e in want]


def test_compatible_neighbours_are_those_that_merging_keeps():
    """Tested pair by pair: two tokens are compatible if merging their letters gives them back."""
    codec, rng = bpe.codec(PATH), np.random.default_rng(2)
    letters = {i: s for s, i in codec.tokens.items()}
    inner = [i for i, s in letters.items() if not s.endswith(bpe.END) and len(s) <= 4]
    a, b = rng.choice(inner, 4000), rng.choice(list(letters), 4000)
    want = [codec.exact(letters[x] + letters[y] + ("" if letters[y].endswith(bpe.END) else "zz" + bpe.END))[:2] == [x, y]
            for x, y in zip(a.tolist(), b.tolist()) if letters[y].endswith(bpe.END)]
    ends = np.array([letters[y].endswith(bpe.END) for y in b.tolist()])
    assert codec.compatible(a[ends], b[ends]).tolist() == want
    assert 0 < sum(want) < len(want)


def test_long_words_merge_alike():
    codec = bpe.codec(PATH)
    for word in ["ab" * 20, "the" * 13, "a" * 41, "hahaha" * 6]:
        ids = [codec.tokens[c] for c in word[:-1]] + [codec.tokens[word[-1] + bpe.END]]
        assert codec._exact_long(ids) == codec.exact((word + bpe.END)[-42:] if len(word) > 41 else word + bpe.END)
