"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import components, removed
from shelf.llm import catalog, decontamination, exact_dedup, mixing, near_dedup, page_templates, resample, run_index
from shelf.llm.token_lengths import encoded_lengths, length_histogram, suffix_sums

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block0 string, token string, kept boolean, a long, b long, rep long, word long, bits long, m long, `key` double, target boolean, share double, spans0 string, `_h` long"


def long_text(seed, n=4000):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 99991}" for i in range(n))


PASSAGE = " ".join(f"shared{i}" for i in range(60))
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards watch from a tall tower of grey stone"
TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa"),
    (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "ONE"), (8, "Été éTÉ \U0001f600 \x00x"),
    (9, long_text(1)), (10, long_text(1) + " tail"), (11, long_text(2) + " " + PASSAGE), (12, PASSAGE + " " + PASSAGE),
    (13, "abab" * 200), (14, "Intro. " + ITEM.upper().replace(" ", ",  ") + "!!"), (15, ITEM.replace("lazy", "lzay") + " end"),
    (None, "no id"), (16, "same row"), (16, "same row"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, [None, "en", "fr"][k % 3], [None, "x", "y"][k % 3], None, "q", "t", True, 1, 2, 3, 4, 5, 6, 0.5, True, 0.1, "s", 9) for k, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, None), (6, None, 0), (None, 1, 1), (9, 1, 0), (9, 1, 0), (13, 0, 1)], "doc_id long, quality int, toxic int")


def unique():
    return {d: t for d, t in TEXTS if d is not None}


def test_near(spark, docs, empty):
    want = components(unique())
    rows = near_dedup.near_components(docs).collect()
    assert len(rows) == len(TEXTS)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
    assert near_dedup.near_components(empty).collect() == []


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    words = [f"v{i}" for i in range(60)]
    texts = {k: " ".join(words[: 40 + k] + [f"z{k}"]) for k in range(20)} | {50 + k: " ".join(words[k : 30 + k]) for k in range(12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(df).collect()}
    assert found == components(texts)


def test_repeats(spark, docs, empty, monkeypatch):
    want = removed(unique())
    for group in (run_index.GROUP_ROWS, 0):
        monkeypatch.setattr(run_index, "GROUP_ROWS", group)
        rows = run_index.remove_repeats(docs).collect()
        assert len(rows) == len(TEXTS)
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows if r["doc_id"] is not None} == want
    assert run_index.remove_repeats(empty).collect() == []


def test_exact(docs, empty):
    for words in (exact_dedup.MAX_WORDS, 1):  # a full filter changes nothing
        rows = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_groups(docs, max_words=words).collect()}
        by_id = {k[0]: r for k, r in rows.items()}
        assert by_id[1]["keep_id"] == 2 and not by_id[1]["kept"] and by_id[2]["group_size"] == 2
        assert by_id[3]["keep_id"] == by_id[4]["keep_id"] == 4 and by_id[5]["group_size"] == 1
        assert by_id[16]["group_size"] == 2 and by_id[16]["kept"] and by_id[None]["kept"]
    carried = exact_dedup.exact_groups(docs, tuple(docs.columns[:5]))
    assert sorted(map(str, carried.select("doc_id", "text").collect())) == sorted(str(r) for r in docs.select("doc_id", "text").collect())
    assert exact_dedup.exact_groups(empty).collect() == []


def test_leaks(spark, docs, empty):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "one"), (None, "x"), (5, "!?")], "item_id long, text string")
    found = {r["doc_id"]: {s["item_id"]: s["edits"] for s in r["spans"]} for r in decontamination.find_leaks(docs, bench).collect()}
    assert found[14] == {1: 0} and found[15] == {1: 2} and found[6] == found[7] == {4: 0}
    assert not any(v for d, v in found.items() if d not in (6, 7, 14, 15))
    clean = decontamination.find_leaks(docs, bench, clean_only=True)
    assert clean.columns == docs.columns and clean.count() == len(TEXTS) - 4
    assert decontamination.find_leaks(empty, bench).collect() == [] and decontamination.find_leaks(docs, bench.filter("false")).filter("size(spans) > 0").collect() == []


def test_alignment_is_edit_distance():
    import random

    import numpy as np

    def best(item, text, k):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            old, row[0] = row[:], i
            for j, y in enumerate(text, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return min(row) if min(row) <= k else None

    rng = random.Random(1)
    for _ in range(200):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 20)))
        k = rng.randint(0, 4)
        got = decontamination.banded_edits(np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8), -12, 20, k)
        assert (got and got[0]) == best(item, text, k) or (got is not None and got[0] == best(item, text, k))


def test_resample(docs, empty, labels):
    rows = resample.resampled(docs, labels).collect()
    assert len(rows) == len(TEXTS)
    assert sum(r["kept"] for r in resample.resampled(docs, labels, k=5).collect()) in (5, 6)
    assert not any(r["kept"] for r in resample.resampled(docs, labels, k=0).collect())
    assert all(r["kept"] for r in resample.resampled(docs, labels.filter("false")).collect())
    assert resample.resampled(empty, labels).collect() == []


def test_toxic_documents_go(spark):
    rows = [(k, long_text(k, 80 + k % 40) + (" nasty vile foul" if k % 5 == 0 else "")) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(200)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in resample.resampled(df, marks).collect()}
    assert not any(kept[k] for k in range(0, 300, 5)) and sum(kept.values()) >= 0.97 * 240
    first = {r["doc_id"] for r in resample.resampled(df, marks, k=240).filter("kept").collect()}
    assert first == {k for k in range(300) if k % 5}


def test_ties_go_to_small_ids(spark):
    keyed = spark.createDataFrame([(k, float(k // 4)) for k in range(40)], "doc_id long, key double")
    kept = sorted(r["doc_id"] for r in resample.top_k(keyed, 6).filter("kept").collect())
    assert kept == [32, 33, 36, 37, 38, 39]


def test_others(spark, docs, empty):
    for f in (catalog.license_scan.scan_licenses, lambda d: catalog.language_mix.identify_languages(d, *catalog.language_mix.learn_languages(d))):
        assert f(docs).count() == len(TEXTS) and f(empty).collect() == []
    langs = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in catalog.language_mix.identify_languages(docs, *catalog.language_mix.learn_languages(docs)).collect()}
    assert langs[3] == langs[4] == langs[5] == ("und", 0.0) and langs[6][0] in ("en", "fr")
    assert {r["lang_pred"] for r in catalog.language_mix.identify_languages(docs, [], catalog.language_mix.language_models(catalog.language_mix.count_trigrams(empty))[1]).collect()} == {"und"}
    assert suffix_sums(length_histogram(encoded_lengths(empty))).collect() == []
    assert suffix_sums(length_histogram(encoded_lengths(docs))).agg(F.sum("n_docs")).first()[0] == len(TEXTS)


def test_mixture_of_languages(spark):
    en = " ".join(f"the{x} house{x}ing" for x in "abcdefghijklmnop")
    fr = " ".join(f"l{x} maison{x}eaux" for x in "éèabcdefghijklmn")
    rows = [(k, en, "en") for k in range(9)] + [(20 + k, fr, "fr") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, model = catalog.language_mix.learn_languages(df)
    both = spark.createDataFrame([(1, f"{en} {fr}"), (2, en)], "doc_id long, text string")
    found = {r["doc_id"]: r["proportions"] for r in catalog.language_mix.identify_languages(both, langs, model).collect()}
    assert set(found[1]) == {"en", "fr"} and 0.3 < found[1]["en"] < 0.7 and set(found[2]) == {"en"}


def test_mixing(docs, empty):
    plain = docs.select("doc_id", "text", "source")
    rows = mixing.mixed(plain).collect()
    assert {r["doc_id"] for r in rows} == {d for d, _ in TEXTS}
    assert mixing.mixed(empty.select("doc_id", "text", "source")).collect() == []
    again = mixing.mixed(plain).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


CLASHES = "kept boolean, keep_id string, group_size string, word string, bits string, seen string, maybe string, text_sha256 string, spans string, spans_found int, whole string, last_place int, more string, row string, place_ string, `_source` string, tokens string, toxic string, target string, n_grams int, log_weight string, key string, component_id int, n_shingles string, `a.b` string"


def test_clashing_names_pass_through(spark, data):
    """A documents table with every internal name as an extra column goes through every stage unchanged."""
    names = [c.strip().split(" ")[0].strip("`") for c in CLASHES.split(",")]
    kinds = [c.strip().split(" ")[1] for c in CLASHES.split(",")]
    plain = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    extra = {n: F.lit(True) if k == "boolean" else (F.lit(7) if k == "int" else F.lit(f"own {n}")) for n, k in zip(names, kinds)}
    wide = plain.select("*", *[v.alias(n) for n, v in extra.items()])
    more = spark.createDataFrame([(None, None, None, None, None), (70_000, None, None, "x", 0), (70_001, "", "en", None, 0), (70_001, "", "en", None, 0)], plain.schema)
    wide = wide.unionByName(more.select("*", *[v.alias(n) for n, v in extra.items()]))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, data)
        assert out.columns == wide.columns + (["block", "place"] if name == "mixing" else []), name
        rows = out.collect()
        assert rows and all(r[n] == (True if k == "boolean" else 7 if k == "int" else f"own {n}") for r in rows for n, k in zip(names, kinds)), name
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in wide.select("doc_id").collect()}
        none = stage(spark, wide.filter("false"), data)
        assert none.collect() == [] and none.columns == out.columns, name
    found = decontamination.find_leaks(wide, spark.read.parquet(f"{data}/benchmark.parquet"))
    assert found.columns == [*wide.columns, "spans_found_"] and {r["spans"] for r in found.select("spans").collect()} == {"own spans"}


def test_pages(spark):
    page = (
        "<html><body><nav>Menu</nav><div class='cookie-notice'>Cookies</div><aside>Side</aside><article><h1>A &amp; B</h1><p>one\n two&nbsp;x<p>three <b>bold</b>text"
        "<form><label>Mail</label><input></form><div class=\"adBox\">Buy</div><section class='comments'><p>Nice</p></section></article><footer>End</footer>"
    )
    rows = [(k, f"http://h.example/{k}", page.replace("one", f"one{k}")) for k in range(4)]
    rows += [(10, None, None), (11, "x", ""), (12, "http://o.example/", "<div>plain <div>text</div> & more</div>"), (13, "http://o.example/", "a < b <p title='>'>c")]
    rows += [(20 + k, f"http://d.example/{k}", f"<div>Always here</div><div><p>Story {k}</p><p>More {k}</p></div>") for k in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in page_templates.extract_main_text(df).collect()}
    assert found[2] == "A & B\none2 two x\nthree boldtext"
    assert found[10] == found[11] == "" and found[12] == "plain\ntext\n& more" and found[13] == "a < b\nc"
    assert found[22] == "Story 2\nMore 2"
    assert page_templates.extract_main_text(df.filter("false")).collect() == []


def test_slots_of_articles(spark):
    notice = "<div class='zq'>Read our magazine</div>"
    rows = [(k, f"http://n.example/{k}", f"<body><article><h1>Title {k}</h1>{notice}<p>Text {k} of it.</p><p>Read it all.</p></article></body>") for k in range(6)]
    teaser = "<div class='zr'><article><h3>Teaser {}</h3></article></div>"
    rows += [(10 + k, f"http://t.example/{k}", f"<body><div id=content><h1>Title {k}</h1><p>{'A long body ' * (k + 1)}</p></div>{teaser.format(k)}</body>") for k in range(4)]
    rows += [(40 + k, f"http://p.example/{k}", f"<body><article class='promo'><p>Buy {k}</p></article><article class='comment-open'><p>Story {k}</p></article></body>") for k in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in page_templates.extract_main_text(df).collect()}
    assert [found[k] for k in range(6)] == [f"Title {k}\nText {k} of it." for k in range(6)]
    assert [found[10 + k] for k in range(4)] == [f"Title {k}\n{('A long body ' * (k + 1)).strip()}" for k in range(4)]
    assert [found[40 + k] for k in range(3)] == [f"Story {k}" for k in range(3)]


def test_wrappers_keep_their_text(spark):
    """Everyday names on wrappers empty no page, their parts still go; notices go by the template alone."""
    names = ["has-sidebar", "content-sidebar-wrap", "search-results-page", "social-science", "post tags-open"]
    rows, want = [], {}
    for j, name in enumerate(names):
        for k in range(4):
            body = f"<p>Story {k} of {name}.</p><p>It goes on {k * 7} times.</p>"
            rows.append((100 * j + k, f"http://w{j}.example/{k}", f"<body><div class='{name}'>{body}<div class='sidebar'><p>Also {k}</p></div></div><div class='ad'>Buy {k}</div></body>"))
            want[100 * j + k] = f"Story {k} of {name}.\nIt goes on {k * 7} times."
    for k in range(10):
        notice = "<p>We are closed on Monday.</p>" if k < 7 else ""
        rows.append((1000 + k, f"http://n.example/{k}", f"<body><div id='content'>{notice}<p>News {k} of the day.</p></div></body>"))
        want[1000 + k] = f"News {k} of the day."
    for k in range(5):
        rows.append((2000 + k, f"http://a.example/{k}", f"<body><article><h1>Title {k}</h1><p>Sign our petition.</p><p>Text {k}.</p></article></body>"))
        want[2000 + k] = f"Title {k}\nText {k}."
    rows.append((3000, "http://one.example/", "<body><div class='comments-open'><h1>Head</h1><p>Short.</p></div><div class='comments'><p>A much longer comment of a reader than the story itself.</p></div></body>"))
    want[3000] = "Head\nShort."
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = {r["page_id"]: r["text"] for r in page_templates.extract_main_text(df).collect()}
    assert found == want


def test_texts_of_templates(spark):
    lead = "lead " * 60
    rows = [(20 + k, f"http://l.example/{k}", f"<body><div><p>{lead}{k}</p></div></body>") for k in range(4)]
    rows += [(30 + k, f"http://c.example/{k}", "<body><div><p>One page</p><p>many times</p></div></body>") for k in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in page_templates.extract_main_text(df).collect()}
    assert [found[20 + k] for k in range(4)] == [f"{lead}{k}" for k in range(4)]
    assert [found[30 + k] for k in range(5)] == ["One page\nmany times"] * 5


def test_slots_are_gaps_of_nested_classes(spark):
    """A text is the template's only in the slot where most pages have it, and stories in elements with names of their own are found by their slot."""
    word = lambda k: "abcdefghijkl"[k] * 5
    rows, want = [], {}
    for k in range(10):
        # in the last two the line of the foot is a sentence of the story too
        own = "<p>More to follow.</p>" if k >= 8 else ""
        foot = "<div id='zf'><p>More to follow.</p></div>" if k < 9 else "<div id='zf'></div>"
        rows.append((k, f"http://s.example/{k}", f"<body><div id='zc'><h1>Title {k}</h1><p>Story {k}.</p>{own}<p>It ends {k}.</p></div>{foot}</body>"))
        want[k] = "\n".join([f"Title {k}", f"Story {k}.", *["More to follow."] * (k >= 8), f"It ends {k}."])
        # each story has an element of its own name; what all pages have is a list of others, and a notice in the story
        body = f"<div id='z-{word(k)}'><h1>Title {k}</h1><p>{word(k)} went home and stayed there for {k} days.</p><p>Write to us.</p></div>"
        rows.append((100 + k, f"http://o.example/{k}", f"<body><div id='zh'><b>Daily</b></div>{body}<div id='zo'><p>Also {k}</p></div><div id='zf'><b>End</b></div></body>"))
        want[100 + k] = f"Title {k}\n{word(k)} went home and stayed there for {k} days."
        # one page has another element around the story
        name = "zc" if k else "zx"
        rows.append((200 + k, f"http://x.example/{k}", f"<body><div id='za'><p>Now {k}</p></div><hr><h2>News</h2><div id='{name}'><p>A long story, number {k}.</p></div><h2>End</h2></body>"))
        want[200 + k] = f"A long story, number {k}."
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in page_templates.extract_main_text(df).collect()}
    assert found == want


def test_classes_are_ordered_and_nested():
    """Tokens that change places leave their class; a class that overlaps a larger one is none."""
    import json

    def nested(pages, **vectors):
        often = json.dumps([{"token": x, "n_pages": n, "signature": v} for v, (n, tokens) in vectors.items() for x in tokens])
        ranges, classes = {}, page_templates.Classes(often)
        for page in pages:
            numbers, gaps = classes.facts(tuple(classes.number[x] for x in ["", *page, "."]))
            for t, row in zip(numbers.tolist(), gaps.tolist()):
                for c, gap in enumerate(row):
                    if gap >= 0:
                        lo, hi = ranges.get((t, c), (gap, gap))
                        ranges[t, c] = min(lo, gap), max(hi, gap)
        valid = page_templates.valid_classes(often, json.dumps([{"x": str(t), "y": str(c), "lo": a, "hi": b} for (t, c), (a, b) in ranges.items()]))
        return page_templates.Nested(often, valid)

    whole, xy, vw = (9, ["", "/a", "/b", "/c", "=d", "."]), (8, ["/x", "=y"]), (7, ["/v", "=w"])
    found = nested([["/a", "/x", "=y", "/x", "=y", "/b", "/c", "=d"], ["/a", "/c", "/b", "=d"]], one=whole, more=xy)
    assert found.ranks == {0: [0, 1, 4, 5], 1: [0, 1]} and found.texts == {"=d", "=y"} and found.around("1:1") == {"1:1", "0:2"}
    order = tuple(found.classes.number[x] for x in ["", "/a", "/x", "=y", "/b", "/c", "=d", "."])
    assert [found.slot(x) for x in found.classes.gaps(order)] == ["", "0:1", "0:2", "1:1", "0:2", "0:2", "0:2", "0:3", ""]
    # x and y on two sides of b; in different gaps; not alternating
    for pages in ([["/a", "/x", "/b", "=y", "/c", "=d"]], [["/x", "=y", "/a", "/b", "/c", "=d"], ["/a", "/x", "=y", "/b", "/c", "=d"]], [["/x", "/x", "=y", "=y", "/a", "/b", "/c", "=d"]]):
        found = nested(pages, one=whole, more=xy)
        assert found.ranks == {0: [0, 1, 2, 3, 4, 5]} and found.texts == {"=d"}
    # classes that only some pages have: one in the other, side by side, and never on one page
    some = ["/a", "/b", "/c", "=d"]
    found = nested([["/x", "/v", "=w", "=y", *some], some, ["/v", "=w", *some], ["/x", "=y", *some]], one=whole, more=xy, few=vw)
    assert found.outer == {0: {}, 1: {0: 1}, 2: {0: 1, 1: 1}}
    found = nested([["/x", "=y", *some], ["/v", "=w", *some]], one=whole, more=xy, few=vw)
    assert found.outer == {0: {}, 1: {0: 1}, 2: {0: 1}}
    found = nested([["/x", "/v", "=y", "=w", *some]], one=whole, more=xy, few=vw)
    assert found.outer == {0: {}, 1: {0: 1}}


def test_notices_around_elements_of_some_pages(spark):
    """A notice stays the template's where other parts of it are missing on some pages; articles in elements of their own names are found."""
    word = lambda k: "abcdefghijkl"[k] * 5
    rows, want = [], {}
    for k in range(10):
        by, tags = ("<div id='zb'></div>", "<div id='zt'></div>") if k < 7 else ("", "")
        notice = "<p>Closed on Monday.</p>" if k not in (0, 1) else ""
        rows.append((k, f"http://n.example/{k}", f"<body><div id='zc'>{by}<p>Story {k}.</p>{notice}<p>It ends {k}.</p>{tags}</div></body>"))
        want[k] = f"Story {k}.\nIt ends {k}."
        story = f"<div id='z-{word(k)}'><article><h1>Title {k}</h1><p>{word(k)} went home.</p></article><p>Read {k}</p></div>"
        rows.append((100 + k, f"http://a.example/{k}", f"<body>{story}<div id='zo'><p>Also {k}</p></div></body>"))
        want[100 + k] = f"Title {k}\n{word(k)} went home."
    rows += [(200 + k, f"http://t.example/{k}", f"<q-{word(k)}>Only this</q-{word(k)}><{word(k)}><p>Is the same {k}</p></{word(k)}>") for k in range(4)]
    want |= {200 + k: f"Is the same {k}" for k in range(4)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in page_templates.extract_main_text(df).collect()}
    assert found == want


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rejected = {r["doc_id"] for r in resample.resampled(docs, labels).filter("not kept").collect()}
    left = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in rejected}
    from brute import ascii_lower

    last = {ascii_lower(t): d for d, t in sorted(left.items())}
    left = {d: t for d, t in left.items() if last[ascii_lower(t)] == d}
    left = {d: t for d, t in left.items() if components(left)[d][1] == d} if len(left) < 50 else {d: left[d] for d, (_, c) in components(left).items() if c == d}
    leaked = {r["doc_id"] for r in catalog.op3(spark, data).filter("contaminated").collect()}
    want = {d for d in left if d not in leaked}
    rows = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in rows} == want
    copies = {}
    for r in rows:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert set(copies.values()) <= {1, 2}


def test_run_index_windows():
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        seen, want = set(), []
        for s in strings:
            for i in range(len(s) + 1):
                w = s[i : i + 5]
                want.append(len(w) == 5 and w in seen)
                if len(w) == 5:
                    seen.add(w)
        text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
        got = run_index.repeated_windows(text, np.cumsum([len(s) + 1 for s in strings]) - 1, 5)
        assert got.tolist() == want
