import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from shelf.functions import geometry as G
from shelf.operators import crop


def test_priors_like_one_by_one(spark):
    rng = random.Random(6)
    sizes = [(rng.randrange(900, 1500), rng.randrange(900, 1500)) for _ in range(40)] + [(1000, 1000), (2000, 2000), (1003, 1000)]
    examples = [
        (i, w, h, rng.choice(["a", "b", "c"]), *[rng.random() for _ in range(4)], int(rng.random() < 0.1))
        for i, (w, h) in enumerate(rng.choices(sizes, k=300))
    ]
    df = spark.createDataFrame(examples, "id int, img_w int, img_h int, type string, box_l double, box_t double, box_r double, box_b double, low_quality int")
    shapes = spark.createDataFrame(sizes + [(50, 4000)], "w int, h int")
    got = {(r.w, r.h): r for r in crop.taught_priors(df, shapes).collect()}
    want = {}
    for w, h in set(sizes):
        near = [e for e in examples if not e[8] and (w >= h) == (e[1] >= e[2]) and abs(math.log((w / h) / (e[1] / e[2]))) < 0.03]
        if near:
            want[(w, h)] = near
    assert set(got) == set(want)
    for key, near in want.items():
        r = got[key]
        assert r.n == len(near)
        kinds = [e[3] for e in near]
        assert r.type == min(set(kinds), key=lambda k: (-kinds.count(k), k))
        means = [statistics.fmean(e[4 + i] for e in near) for i in range(4)]
        assert [r.box[s] for s in "ltrb"] == [round(m * key[i % 2]) for i, m in enumerate(means)]
        spread = max(statistics.pstdev(e[4 + i] for e in near) for i in range(4)) if len(near) > 1 else 1.0
        assert r.spread == pytest.approx(spread, abs=1e-6)


def test_detail_text(spark):
    rows = spark.createDataFrame([("plain note",), ("[1]",), (None,), ('{"method": "auto", "conf": 0.5}',)], "d string")
    got = rows.select(crop.parse_detail("d").alias("d")).select("d.*").collect()
    assert [(r.method, r.note, r.conf) for r in got] == [
        ("legacy", "plain note", None), ("legacy", "[1]", None), ("legacy", "", None), ("auto", None, 0.5),
    ]


def test_offsets_need_two(spark):
    names = "id int, img_w int, img_h int, low_quality int, det_conf double, " + ", ".join(f"{k}_{s} double" for k in ("box", "det") for s in "ltrb")
    row = (1, 100, 50, 0, 0.9, 0.1, 0.1, 0.9, 0.9, 0.12, 0.1, 0.5, 0.9)
    assert crop.learned_offsets(spark.createDataFrame([row], names)) is None
    got = crop.learned_offsets(spark.createDataFrame([row, row], names))
    assert got == pytest.approx({"l": 0.04, "t": 0.0, "r": 0.10, "b": 0.0})


def test_fitting_finds_sides_once(spark, capsys):
    """Quads with margins as one by one; the lengths of a quad's sides are found once, not for each corner and halving."""
    rng = random.Random(8)
    rows = []
    for i in range(200):
        w, h = rng.randrange(100, 400), rng.randrange(100, 400)
        turn = lambda: rng.uniform(-6, 6)
        quad = [(20 + turn(), 20 + turn()), (w - 20 + turn(), 20 + turn()), (w - 20 + turn(), h - 20 + turn()), (20 + turn(), h - 20 + turn())]
        if i % 20 == 0:
            quad[3] = quad[1] = quad[0]
        rows.append((i, w, h, None if i == 7 else quad, *[rng.choice([-5.0, 3.0, 18.0, 90.0, 900.0, 4000.0]) for _ in range(4)]))
    df = spark.createDataFrame(rows, "id int, w int, h int, quad array<struct<x: double, y: double>>, l double, t double, r double, b double")
    fitted = df.select("id", G.fit_inside(F.col("quad"), F.col("w"), F.col("h"), G.box(*[F.col(s) for s in "ltrb"])).alias("q"))
    for r, (_, w, h, quad, *margins) in zip(fitted.orderBy("id").collect(), rows):
        if quad is None:
            assert r.q is None
            continue

        def unit(to):
            size = math.dist(quad[0], to) or 1.0
            return [(to[c] - quad[0][c]) / size for c in (0, 1)]

        u, v = unit(quad[1]), unit(quad[3])
        want = quad
        for k in range(7):
            left, top, right, bottom = (m * 0.5**k for m in margins)
            ways = [(-left, -top), (right, -top), (right, bottom), (-left, bottom)]
            grown = [[p[c] + u[c] * a + v[c] * b for c in (0, 1)] for p, (a, b) in zip(quad, ways)]
            if all(-1 <= x <= w + 1 and -1 <= y <= h + 1 for x, y in grown):
                want = grown
                break
        assert [x for p in r.q for x in (p.x, p.y)] == pytest.approx([x for p in want for x in p], abs=1e-9)
    capsys.readouterr()
    fitted.explain()
    assert 1 <= capsys.readouterr().out.lower().count("sqrt") <= 4
