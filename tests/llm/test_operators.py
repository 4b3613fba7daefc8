"""Operators against plain versions on a whole small table."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from brute import base_scan, components, removed
from shelf.llm import catalog, language_mix, mixing


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def test_near_components(spark, data, docs):
    rows = catalog.op7(spark, data).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == components(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_removed_repeats(spark, data, docs):
    rows = catalog.op8(spark, data).collect()
    assert len(rows) == len(docs)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == removed(docs)


def test_license_base(spark, data, docs):
    rows = catalog.op9(spark, data).collect()
    found = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows}
    assert found == {d: base_scan(t) for d, t in docs.items()}
    for r in rows:
        text = docs[r["doc_id"]] or ""
        for sign, label in (("Apache License, Version 2.0", "apache-2.0-notice"), ("under the MIT License", "mit-notice"), ("CC BY-NC 4.0", "cc-by-nc-notice")):
            assert (sign in text) == (label in r["labels"].split(","))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_languages(spark, data):
    rows = catalog.op5(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    tested = [r for r in rows if r["held_out"] and r["lang"]]
    assert tested and sum(r["lang"] == r["lang_pred"] for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_leaks(spark, data, docs):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    plain = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()))
    texts = {d: f" {plain(t)} " for d, t in docs.items()}
    want = {d: {i for i, t in items.items() if f" {plain(t)} " in texts[d]} for d in docs}
    rows = catalog.op3(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert want[r["doc_id"]] <= set(r["item_ids"])
        for s in r["spans"]:
            assert s["edits"] <= 0.1 * len(items[s["item_id"]].encode()) and 0 <= s["start"] < s["end"] <= len(docs[r["doc_id"]].encode())
            if s["edits"] == 0:
                raw = docs[r["doc_id"]].encode()[s["start"] : s["end"]].decode()
                assert plain(raw) == plain(items[s["item_id"]])


def test_articles(spark, data):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    import html

    for r in catalog.op6(spark, data).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_quality(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = catalog.op1(spark, data).join(labels, "doc_id").collect()
    # toxic documents are no targets, whatever their quality
    good, bad = ([r["kept"] for r in rows if r["quality"] == q and r["toxic"] != 1] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.35 * len(bad)  # few labels to learn from; see README for the figures at size


def test_token_lengths(spark, data, docs):
    import base64

    import tiktoken

    from shelf.llm import token_lengths as T

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = [len(enc.encode_ordinary(t or "")) for t in docs.values()]
    sums = catalog.op4(spark, data)
    rows = sums.collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(n))
    for r in rows:
        limit = r["n_tokens"]
        assert r["n_docs"] == n.count(limit) and r["docs_longer"] == sum(x > limit for x in n) and r["tokens_longer"] == sum(x for x in n if x > limit)
        assert r["tokens_cut"] == sum(min(x, limit) for x in n) and abs(r["docs_share"] - sum(x <= limit for x in n) / len(n)) < 1e-12
    for r in T.at_limits(sums, [0, 7, 512, 10**9]).collect():
        assert r["docs_longer"] == sum(x > r["context_limit"] for x in n) and r["tokens_cut"] == sum(min(x, r["context_limit"]) for x in n)
    assert T.quantiles(sums, [0.5]).first()["n_tokens"] == sorted(n)[(len(n) + 1) // 2 - 1]


def test_mix_by_entropy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sized = docs.select("doc_id", F.col("source"), mixing.n_words(F.col("text")).alias("tokens"))
    shares = mixing.source_shares(sized).cache()
    p = [r["share"] for r in shares.collect()]
    from math import log

    flat, own = log(len(p)), -sum(x * log(x) for x in p)
    alpha = mixing.temperature_exponent(shares, entropy=(flat + own) / 2)
    u = [x**alpha for x in p]
    w = [x / sum(u) for x in u]
    assert 0 < alpha < 1 and abs(-sum(x * log(x) for x in w) - (flat + own) / 2) < 1e-6
    assert mixing.temperature_exponent(shares, entropy=flat + 1) == 0 and mixing.temperature_exponent(shares, entropy=0.0) == 1
    budget = sum(r["tokens"] for r in sized.collect()) // 3
    rows = mixing.mixed(docs, entropy=own, repetition=None, budget=budget).select("doc_id", "source", mixing.n_words(F.col("text")).alias("t")).collect()
    assert 0.9 * budget < sum(r["t"] for r in rows) <= budget
    shares.unpersist()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    cursor = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    df = catalog.QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(cursor.fetchall())
