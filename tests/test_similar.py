import random

import pytest
from pyspark.sql import functions as F

from shelf.operators import similar as S
from shelf.operators.graph import connected_components
from shelf.plans.review import next_group_number, select_groups, selected_ranges

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def make(seed, n, centers=12, flips=9):
    rng = random.Random(seed)
    roots = [rng.getrandbits(64) for _ in range(centers)]
    out = {}
    for i in range(n):
        h = rng.choice(roots)
        for _ in range(rng.randint(0, flips)):
            h ^= 1 << rng.randrange(64)
        out[f"/p/{rng.randrange(10**6):06}_{i}"] = h
    return out


def far(a, b):
    return (a ^ b).bit_count()


def frame(spark, images):
    return spark.createDataFrame([(p, signed(h)) for p, h in images.items()], "full_path string, h bigint")


@pytest.mark.parametrize("threshold,hot,bands", [(10, None, None), (10, 3, 4), (4, 2, 4), (20, 5, 5)])
def test_pairs_are_all_pairs(spark, threshold, hot, bands):
    hashes = sorted(set(map(signed, make(threshold, 150).values())))
    df = spark.createDataFrame([(h,) for h in hashes], "h bigint")
    got = sorted((r.a, r.b, r.distance) for r in S.similar_pairs(df, threshold, bands, hot).collect())
    want = sorted((a, b, far(a & MASK, b & MASK)) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if far(a & MASK, b & MASK) <= threshold)
    assert got == want and want


def test_hot_band(spark):
    """Many hashes share one 16-bit band: none of the pairs gets lost."""
    rng = random.Random(3)
    hashes = sorted({signed((rng.getrandbits(48) << 16) | 0xABCD) for _ in range(40)} | {signed((rng.choice([1, 3, 7]) << 20) | 0xABCD ^ (1 << k)) for k in range(12)})
    df = spark.createDataFrame([(h,) for h in hashes], "h bigint")
    got = {(r.a, r.b) for r in S.similar_pairs(df, 10, 4, 5).collect()}
    assert got == {(a, b) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if far(a & MASK, b & MASK) <= 10}


def greedy(images, threshold):
    """Groups as one machine would find them."""
    todo, groups = sorted(images), []
    while todo:
        group, queue = set(), [todo[0]]
        while queue:
            p = queue.pop()
            if p not in group:
                group.add(p)
                queue += [q for q in todo if q not in group and far(images[p], images[q]) <= threshold]
        todo = [p for p in todo if p not in group]
        clusters = []
        for p in sorted(group):
            home = next((c for c in clusters if all(far(images[p], images[q]) <= threshold for q in c)), None)
            home.append(p) if home else clusters.append([p])
        groups += [c for c in clusters if len(c) > 1]
    return sorted((c, max(far(images[a], images[b]) for a in c for b in c)) for c in groups)


@pytest.mark.parametrize("largest", [None, 1])
def test_groups_like_one_machine(spark, monkeypatch, largest):
    images = make(5, 60, centers=6, flips=7)
    images |= {f"/copy/{i}": h for i, h in enumerate(list(images.values())[:5])}
    if largest:
        monkeypatch.setattr(S, "SPLIT_HASHES", largest)
    rows = S.similar_groups(frame(spark, images), 10).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.group_no, ([], r.spread))[0].append(r.full_path)
    assert [(sorted(m), s) for _, (m, s) in sorted(groups.items())] == greedy(images, 10)


def test_nearest(spark):
    images = make(8, 80, centers=8, flips=6)
    images |= {"/z/copy": next(iter(images.values()))}
    got = {r.full_path: (r.other, r.distance) for r in S.nearest_duplicate(frame(spark, images), 10, ["full_path"]).collect()}
    want = {}
    for p, h in images.items():
        best = min(((far(h, g), q) for q, g in images.items() if q != p), default=None)
        if best and best[0] <= 10:
            want[p] = (best[1], best[0])
    assert got == want


def test_components_of_a_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") % 1).alias("g")).unionByName(
        spark.createDataFrame([(500, 501, 0), (501, 502, 0), (500, 501, 1)], "a bigint, b bigint, g bigint")
    )
    got = connected_components(edges, by=("g",)).groupBy("g", "component").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, 201), (0, 500, 3), (1, 500, 2)]


def test_selection(spark):
    assert selected_ranges("1,3-5 2", 9) == [(1, 5)] and selected_ranges("9 3-5,4-7", 9) == [(3, 7), (9, 9)]
    groups = spark.range(1, 10).withColumnRenamed("id", "group_no")
    for text, wanted in (("1,3-5 2", [1, 2, 3, 4, 5]), ("A", list(range(1, 10))), (" all ", list(range(1, 10))), ("9, 3", [3, 9])):
        assert sorted(r.group_no for r in select_groups(groups, text).collect()) == wanted
    for wrong in ("0", "5-3", "1,x", "10", " , ", "3-", "-3", "1-2-3", "a,"):
        with pytest.raises(ValueError):
            selected_ranges(wrong, 9)
    listing = spark.createDataFrame([("/r/group_02/a",), ("/r/group_11/b",), ("/r/group_x/b",), ("/r/a/group_99/b",)], "full_path string")
    assert listing.limit(1).select(next_group_number(listing, "/r")).first()[0] == 12


def planted(n, seed, skewed=False):
    """Hashes with near ones among them; skewed ones share most of their bits."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        h = rng.getrandbits(64)
        if skewed:
            h = (0xF0F0F0F0F0F0F0F0 & ~0xFFFF) | rng.getrandbits(12) | (rng.getrandbits(6) << 50)
        out.add(h)
        for _ in range(rng.randint(0, 3)):
            for i in rng.sample(range(64), rng.randint(1, 12)):
                h ^= 1 << i
            out.add(h)
    return [h - (1 << 64) if h >> 63 else h for h in out]


def test_covering_masks():
    for t in range(1, 13):
        masks = S.covering_masks(t)
        assert len(set(masks)) == 2 ** (t + 1) - 1 and min(m.bit_count() for m in masks) >= (32 if t <= 6 else 24)
        rng = random.Random(t)
        for _ in range(300):
            x = sum(1 << i for i in rng.sample(range(64), rng.randint(0, t)))
            assert any(m & x == 0 for m in masks)
    assert S.expected_candidates(10**8, 10) < 2000 and S.masks_pay(10**8, 10) and not S.masks_pay(1000, 10)


@pytest.mark.parametrize("threshold, skewed, hot", [(3, False, 20_000), (6, True, 20_000), (6, True, 8), (7, False, 2)])
def test_pairs_under_masks(spark, threshold, skewed, hot):
    hashes = planted(250, threshold, skewed)
    df = spark.createDataFrame([(h,) for h in hashes], "h long")
    found = S.pairs_under_masks(df, threshold, hot).collect()
    want = {(min(a, b), max(a, b)): ((a ^ b) & (2**64 - 1)).bit_count() for i, a in enumerate(hashes) for b in hashes[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= threshold}
    assert len(found) == len(want) and {(r.a, r.b): r.distance for r in found} == want and want


def test_blocks_split_like_one_task(spark):
    """Chains and dense groups, in blocks smaller than they are, give the clusters of the plain greedy split."""
    rng = random.Random(9)
    chain, h = [], 0
    for k in range(90):
        chain.append(h)
        h ^= 1 << (k % 64)
    dense = [(0x5A5A << 40) ^ sum(1 << i for i in rng.sample(range(12), 3)) for _ in range(60)]
    hashes = list(dict.fromkeys(x - (1 << 64) if x >> 63 else x for x in [*chain, *dense]))
    rng.shuffle(hashes)
    df = spark.createDataFrame([(h, f"{k:04d}") for k, h in enumerate(hashes)], "h long, first string")
    pairs = S.similar_pairs(df.select("h"), 4)
    placed = S.components(df, pairs).join(df, "h")
    whole = {r.h: r.cluster for r in S.complete_link(placed, pairs, 4).collect()}
    for largest, block in ((1, 7), (1, 40), (30, 13)):
        assert {r.h: r.cluster for r in S.complete_link(placed, pairs, 4, largest, block).collect()} == whole


def test_hubs_spread(spark):
    """The edges of a star stay where they are: its centre's row is broadcast, so no task gets all of them."""
    from shelf.operators import graph

    n = 20_000
    for centre in (0, n + 5):
        edges = spark.range(1, n + 1).select(F.col("id").alias("a"), F.lit(centre).cast("long").alias("b")).unionByName(spark.range(1).select(F.lit(n + 100).cast("long").alias("a"), F.lit(n + 101).cast("long").alias("b")))
        found = {r.node: r.component for r in graph.connected_components(edges).collect()}
        assert len(found) == n + 3 and all(found[k] == min(centre, 1) for k in range(1, n + 1)) and found[n + 101] == n + 100
    both = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    sizes = graph._with_least(both, low, ["u"], graph.HUB_DEGREE).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 3 * sorted(r["count"] for r in sizes)[len(sizes) // 2]


@pytest.mark.parametrize("block", (1000, 60, 50))
def test_hashes_block_by_block(spark, monkeypatch, block):
    """In one block, in an odd and in an even number of them: the pairs of brute force, few links, and the nearest in order."""
    rng = random.Random(block)
    values = sorted({sum(1 << k for k in rng.sample(range(64), 32)) - (1 << 63) for _ in range(230)})
    brute = {(a, b): ((a ^ b) % (1 << 64)).bit_count() for i, a in enumerate(values) for b in values[i + 1 :]}
    brute = {k: d for k, d in brute.items() if d <= 22}
    monkeypatch.setattr(S, "BLOCK", block)
    assert S.blocks_pay(len(values), 22)
    hashes = spark.createDataFrame([(v,) for v in values], "h long")
    assert sorted(((r.a, r.b), r.distance) for r in S.similar_pairs(hashes, 22).collect()) == sorted(brute.items())
    root = {v: v for v in values}
    for _ in values:
        for a, b in brute:
            root[a] = root[b] = min(root[a], root[b])
    links = S.linked(hashes, 22)
    assert {r.h: r.component for r in S.components(hashes, links).collect()} == root
    assert links.count() <= len(values) * (-(-len(values) // block) + 1)
    images = spark.createDataFrame([(f"/p{(7 * i) % 229}_{i}", v) for i, v in enumerate(values)] + [("/copy", values[0])], "full_path string, h long")
    path = {v: p for p, v in ((r.full_path, r.h) for r in images.collect()) if p != "/copy"}
    path[values[0]] = min(path[values[0]], "/copy")
    near = {}
    for (a, b), d in brute.items():
        for one, two in ((a, b), (b, a)):
            near[one] = min(near.get(one, (99, "")), (d, path[two]))
    expected = {path[v]: (o, d) for v, (d, o) in near.items() if v != values[0]}
    found = {r.full_path: (r.other, r.distance) for r in S.nearest_duplicate(images, 22, ["full_path"]).collect()}
    assert found.pop("/copy")[1] == 0 and found.pop("/p0_0")[1] == 0
    assert found == expected


def test_images_without_hash_meet_nothing(spark):
    hashes = spark.createDataFrame([(0,), (1,), (None,), (-1,)], "h long")
    assert [(r.a, r.b, r.distance) for r in S.similar_pairs(hashes, 20).collect()] == [(0, 1, 1)]
    images = spark.createDataFrame([("/a", 0), ("/b", 1), ("/c", None), ("/d", None)], "full_path string, h long")
    assert {r.full_path: r.other for r in S.nearest_duplicate(images.filter("full_path <> '/d'"), 20, ["full_path"]).collect()} == {"/a": "/b", "/b": "/a"}


@pytest.mark.parametrize("most", (None, 3))
def test_pairs_of_all_images(spark, most):
    """Copies of one hash are pairs, and each of them meets what is similar, in one piece or in many."""
    images = [(k, h) for k, h in enumerate([0] * 10 + [1] * 4 + [3, -1, -1] + [0x0F0F0F0F0F0F0F0F] * 2 + [None, None])] + [(3, 0), (15, -1), (None, 0)]
    brute = sorted(
        (a, b, far(g & MASK, h & MASK)) for a, g in images for b, h in images
        if None not in (a, b, g, h) and a < b and far(g & MASK, h & MASK) <= 20
    )
    df = spark.createDataFrame(images, "image long, h long")
    found = S.image_pairs(df, 20, "image", most)
    assert sorted(tuple(r) for r in found.collect()) == brute and len(brute) > 100
    assert found.columns == ["a", "b", "distance"] and S.image_pairs(df.filter("false"), 20, "image", most).collect() == []
