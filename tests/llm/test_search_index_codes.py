"""Ranked search, shared word windows and vector codes against plain versions, at tiny limits and on odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import ascii_lower
from shelf.llm import lexical_search, shard_index, vector_codes


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text))


def ranked(docs, items, k=10):
    """docs: [(doc_id, text)], items: [(item_id, text)]"""
    counted = [(d, words_of(t)) for d, t in docs if t is not None]
    counted = [(d, w) for d, w in counted if w]
    n_docs, total = len(counted), sum(len(w) for _, w in counted)
    df = {}
    for _, w in counted:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for d, w in counted:
            m = 25 + (75 * len(w) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(x, 0) + 1))) * ((10**9 * w.count(x)) // (1000 * w.count(x) + 8 * m)) for x in words_of(text or ""))
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "naïve", "A", "b2"]
    return [(k, " ".join(rng.choices(vocabulary, k=rng.choice((0, 1, 3, 20, 200))))) for k in range(n)]


@pytest.mark.parametrize("limits", [{}, {"BLOCK_DOCS": 3, "BITS_PER_KEY": 1, "CELLS": 64, "SMALL_ROWS": 0}])
def test_search(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical_search, name, value)
    docs = texts(1, 120) + [(200 + k, "w1 w2 w2 W2 é, same") for k in range(30)] + [(None, "w1 w2 w3"), (7, "another w5 text of id 7"), (400, None), (401, ""), (402, " .,\t"), (403, "w9 " * 5000)]
    items = [(1, "w1 w2 w2 unknown"), (2, "W9, w9; w10"), (3, None), (4, ""), (5, "same É été"), (5, "w33"), (6, "nothing here"), (None, "w4 a B2"), (1, "w1 w2 w2 unknown")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, score long").repartition(5)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    for item_bytes in (lexical_search.ITEM_BYTES, 10):
        found = sorted(map(tuple, lexical_search.search(d, q, item_bytes=item_bytes).collect()), key=str)
        assert found == ranked(docs, items)
    none = lexical_search.search(d.filter("false"), q)
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.search(d, q.filter("false")).collect() == []


def test_bounds_hold_every_document():
    """No document scores above its bound, and a key's rows show every document that has it."""
    import pyarrow as pa

    docs = texts(5, 80)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
    query = lexical_search.Query([0, 1], ["w1 w2 w3 w3", "été a b2"])
    query.weigh(80, {k: 20 for k in range(len(query.vocabulary))})
    seen = 0
    for out in lexical_search._index(iter([batch])):
        for ids, bits, m in lexical_search._blocks(iter([out]), 80, 3000):
            bounds = lexical_search.upper_bounds(query, bits, m)
            for k, d in enumerate(ids.tolist()):
                w = words_of(dict(docs)[d])
                for item, text in enumerate(("w1 w2 w3 w3", "été a b2")):
                    s = sum(int(query.weights[query.vocabulary.index(x.encode())]) * ((10**9 * w.count(x)) // (1000 * w.count(x) + 8 * int(m[k]))) for x in text.split())
                    assert s <= bounds[item, k]
                seen += 1
    assert seen == sum(bool(words_of(t)) for _, t in docs)


def shared(docs, n=13):
    """[(doc_id, n_words, n_removed, digest)] of [(doc_id, text)]"""
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for d, w in split:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, 1 << 70), 1 << 69 if d is None else d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (1 << 69 if d is None else d):
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"crowded": 0}, {"crowded": 2, "shard_words": 10, "most_bits": 8}])
def test_shared_windows(spark, limits):
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(60)]
    docs = []
    for k in range(120):
        w = [rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.choice((0, 5, 12, 13, 40, 150)))]
        if k % 3 == 0:
            a = rng.randint(0, 40)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + rng.randint(10, 20)]
        docs.append((k, rng.choice((" ", "\n", "\t  ")).join(w)))
    docs += [(500, "x " * 400), (501, "x " * 30), (502, docs[10][1]), (503, None), (504, ""), (505, " ".join(passage)), (506, "é " * 13 + "end"), (507, "é\n" * 13)]
    docs += [(None, " ".join(passage[:20])), (None, "only here " * 20), (600, " ".join(passage)), (600, "x " * 20), (600, " ".join(passage))]
    df = spark.createDataFrame([(d, t, 1, "w", 2, 3) for d, t in docs], "doc_id long, text string, `order` int, row string, marker long, place int").repartition(4)
    rows = shard_index.remove_shared_windows(df, **limits).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str) == shared(docs)
    assert all(r.n_removed == sum(x.end - x.start for x in r.removed) for r in rows)
    assert shard_index.remove_shared_windows(df.filter("false")).collect() == []


def test_matching_statistics():
    rng = random.Random(8)
    for _ in range(150):
        lists = [[rng.randint(1, 3) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 6))]
        symbols = np.array([x for w in lists for x in [*w, 0]])
        places = {}
        at = 0
        for w in lists:
            for i in range(len(w) - 4):
                places.setdefault(tuple(w[i : i + 5]), []).append(at + i)
            at += len(w) + 1
        found, low, high, index = shard_index.long_matches(symbols, 5)
        want = {p: len(ps) for ps in places.values() if len(ps) > 1 for p in ps}
        assert dict(zip(found.tolist(), (high - low).tolist())) == want


def coded(rows, rounds=6):
    """{(vec_id, vector): (code, error)}, label errors and the codebooks' digest."""
    good = [(i, label, v) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(8, -(-max((len(v) for _, _, v in good), default=0) // 8) * 8)
    size = width // 8
    ints = [(i, label, [math.floor(4096 * float(np.float32(x))) for x in v] + [0] * (width - len(v))) for i, label, v in good]
    start = sorted(ints, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:16]
    books = [[v[p * size : (p + 1) * size] for _, _, v in start] for p in range(8)]

    def nearest(p, part):
        return min(((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p])), default=None)

    for _ in range(rounds):
        for p in range(8):
            members = {}
            for _, _, v in ints:
                part = v[p * size : (p + 1) * size]
                members.setdefault(nearest(p, part)[1], []).append(part)
            for k, parts in members.items():
                books[p][k] = [sum(c) // len(parts) for c in zip(*parts)]
    out = []
    for i, label, v in ints:
        near = [nearest(p, v[p * size : (p + 1) * size]) for p in range(8)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near)))
    by_label = {}
    for _, label, _, e in out:
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, c, e, by_label[label], sha) for i, label, c, e in out], key=str)


@pytest.mark.parametrize("leaf, block", [(32, 1 << 20), (2, 1 << 10)])
def test_codes(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(vector_codes, "LEAF", leaf)
    monkeypatch.setattr(vector_codes, "BLOCK_BYTES", block)
    monkeypatch.setattr(vector_codes.Trees.__init__, "__defaults__", (leaf,))
    monkeypatch.setattr(vector_codes.Trees.unpack.__func__, "__defaults__", (leaf,))
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 0.2, (5, 16))
    rows = [(int(k), int(k % 3) if k % 7 else None, [float(np.float32(x)) for x in centres[k % 5] + rng.normal(0, 0.01 * (k % 4), 16)]) for k in range(300)]
    rows += [(1000 + k, 9, rows[0][2]) for k in range(80)] + [(5, 1, rows[9][2]), (None, None, rows[3][2]), (2000, 1, [0.5] * 3), (2001, 1, [])]
    rows += [(3000, 1, None), (3001, 1, [float("nan")] * 16), (3002, 1, [float("inf")] * 16), (3003, 1, [1.0, None])]
    df = spark.createDataFrame([(i, label, v, 1, "e") for i, label, v in rows], "vec_id long, label int, embedding array<float>, error int, tree string").repartition(3)
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, vector_codes.compress_vectors(df).select(names).collect()), key=str) == coded(rows)
    few = df.filter("vec_id < 4")
    assert sorted(map(tuple, vector_codes.compress_vectors(few).select(names).collect()), key=str) == coded([r for r in rows if r[0] is not None and r[0] < 4])
    assert vector_codes.compress_vectors(df.filter("false")).collect() == []


def test_whole_nodes_are_assigned_by_their_sums():
    """Where clusters are tight, nodes are pruned to one entry: no point of them is looked at, and sums are the same."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (4, 6))
    points = (centres[rng.integers(0, 4, 2000)] + rng.integers(-3, 4, (2000, 6)))[None]
    tree = vector_codes.Trees(points, 16)
    sums, counts, nearest = np.zeros((4, 6), np.int64), np.zeros(4, np.int64), np.zeros(2000, np.int64)
    looked = []
    tree.points = type("Counted", (), {"__getitem__": lambda self, k: looked.append(k) or points[k], "shape": points.shape})()
    vector_codes.assign(tree, 0, centres, nearest, sums, counts)
    want = ((points[0][:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (nearest == want).all() and (counts == np.bincount(want, minlength=4)).all()
    assert all((sums[k] == points[0][want == k].sum(0)).all() for k in range(4))
