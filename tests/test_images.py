import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelf.functions import geometry as G
from shelf.operators import detect, locate, metrics
from shelf.sources import boxes, images, listing


def photo(w, h, box, seed=0):
    rng = random.Random(seed)
    l, t, r, b = box
    return [
        [
            tuple(min(255, v + rng.randrange(6)) for v in ((235, 232, 225) if l <= x < r and t <= y < b else (60, 80, 70)))
            for x in range(w)
        ]
        for y in range(h)
    ]


BOXES = {"one.png": (20, 15, 100, 75), "two.png": (30, 20, 110, 70), "three.png": (15, 22, 95, 78), "four.png": (25, 12, 105, 72)}


@pytest.fixture(scope="module")
def album(tmp_path_factory, write_png):
    root = tmp_path_factory.mktemp("album")
    for i, (name, box) in enumerate(BOXES.items()):
        write_png(root / name, photo(128, 96, box, i))
    os.makedirs(root / "sub dir")
    write_png(root / "sub dir" / "one copy.png", photo(64, 48, (10, 7, 50, 37), 9))
    os.makedirs(root / ".hidden")
    write_png(root / ".hidden" / "x.png", photo(16, 16, (2, 2, 9, 9)))
    (root / "broken.jpg").write_bytes(b"no image")
    (root / "note.txt").write_text("x")
    return str(root)


def test_listing_of_a_folder(spark, album):
    found = listing.read_listing(spark, album)
    assert {os.path.relpath(r.full_path, album) for r in listing.image_scan(found, album).collect()} == set(BOXES) | {"broken.jpg", "sub dir/one copy.png"}
    flat = listing.image_scan(found, album, recursive=False).collect()
    assert {os.path.basename(r.full_path) for r in flat} == set(BOXES) | {"broken.jpg"}
    assert [r.folder_name for r in listing.index_scan(found, album).collect()] == ["sub dir"]


def test_folders_with_underscores(spark, tmp_path, write_png):
    names = [
        "_x.png", "_d/_x.png", "b_/_x 1.png", "a/_e/_.png", "a.png", "_d/y.png", "a/_e/z.png", "_m/b/_n/c.png", "_p=1/q.png", "_p=1/_r/_s=2/t.png", "_d/_p=3/u.png", "_metadata_1/v.png", "b_/w.png",
    ]
    for i, name in enumerate([*names, ".h/_w.png", ".h.png"]):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        write_png(tmp_path / name, photo(16, 16, (2, 2, 9, 9), i))
    (tmp_path / "_d/broken.JPG").write_bytes(b"no image")
    (tmp_path / "_broken.jpg").write_bytes(b"no image")
    (tmp_path / "_m/_note.txt").write_text("x")
    for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
        found = [os.path.relpath(r.full_path, tmp_path) for r in listing.read_listing(spark, root).collect()]
        assert sorted(found) == sorted([*names, "_d/broken.JPG", "_broken.jpg", "_m/_note.txt"])
    read = {os.path.relpath(r.full_path, tmp_path): r.status for r in images.read_images(spark, str(tmp_path)).collect()}
    assert read == {**dict.fromkeys(names, "ok"), "_d/broken.JPG": "error", "_broken.jpg": "error"}
    assert images.perceptual_hashes(images.read_images(spark, str(tmp_path))).count() == len(names)


def with_orientation(raw, value, order):
    """A PNG file with a chunk that notes how it is to be turned."""
    tag = struct.pack(order + "HHIH", 0x0112, 3, 1, value) + b"\0\0"
    body = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, 1) + tag + bytes(4)
    chunk = struct.pack(">I", len(body)) + b"eXIf" + body + struct.pack(">I", zlib.crc32(b"eXIf" + body))
    return raw[:33] + chunk + raw[33:]


def test_upright_photos(spark, tmp_path, write_png):
    write_png(tmp_path / "plain.png", photo(24, 16, (2, 3, 9, 14), 1))
    raw = (tmp_path / "plain.png").read_bytes()
    for value in range(1, 9):
        (tmp_path / f"{'_' * (value % 2)}{value}.png").write_bytes(with_orientation(raw, value, "<>"[value % 2]))
    read = images.read_images(spark, str(tmp_path))
    noted = {os.path.basename(r.full_path): r.orientation for r in read.collect()}
    assert noted == {"plain.png": 1, **{f"{'_' * (v % 2)}{v}.png": v for v in range(1, 9)}}
    grids = {os.path.basename(r.full_path).strip("_"): r for r in images.to_grids(read, 64).collect()}
    stored = np.array(grids["plain.png"].r).reshape(16, 24)
    want = {1: stored, 2: np.fliplr(stored), 3: np.rot90(stored, 2), 4: np.flipud(stored), 5: stored.T, 6: np.rot90(stored, -1), 7: np.rot90(stored, 2).T, 8: np.rot90(stored)}
    for value, a in want.items():
        g = grids[f"{value}.png"]
        assert (g.h, g.w) == a.shape == (g.gh, g.gw) and (np.array(g.r).reshape(a.shape) == a).all(), value
    hashes = {os.path.basename(r.full_path).strip("_"): r.phash for r in images.perceptual_hashes(read).collect()}
    assert hashes["1.png"] == hashes["plain.png"] != hashes["6.png"]


def test_headers():
    from shelf.sources.orientation import orientation_of

    def of(raw):
        return orientation_of(lambda at, n: raw[at : at + n])

    entry = struct.pack(">HHIH", 0x0112, 3, 1, 6) + b"\0\0"
    tiff = b"MM\0*" + struct.pack(">IH", 8, 1) + entry + bytes(4)
    exif = b"\xff\xe1" + struct.pack(">H", 8 + len(tiff)) + b"Exif\0\0" + tiff
    assert of(tiff) == 6 and of(b"\xff\xd8\xff\xe0\0\x04ab\xff" + exif) == 6 and of(b"\xff\xd8\xff\xda" + exif) == 1
    assert of(b"\xff\xd8" + exif[:20]) == of(b"\xff\xd8") == of(b"\xff\xd8\xff\xe1\0\0" * 3) == 1
    assert of(b"RIFF\0\0\0\0WEBPVP8 " + struct.pack("<I", 3) + b"abc\0" + b"EXIF" + struct.pack("<I", len(tiff)) + tiff) == 6
    assert of(b"") is None and of(b"no image") is None and of(b"GIF89a") == 1 and of(tiff.replace(b"\0\x06", b"\0\x09")) == 1


def test_hashes_of_similar_photos(spark, album):
    rows = {os.path.basename(r.full_path): r for r in images.perceptual_hashes(images.read_images(spark, album)).collect()}
    assert set(rows) == set(BOXES) | {"one copy.png"}
    near = ((rows["one.png"].phash ^ rows["one copy.png"].phash) & (2**64 - 1)).bit_count()
    far = ((rows["one.png"].phash ^ rows["two.png"].phash) & (2**64 - 1)).bit_count()
    assert near < 12 and near < far


def cells_of(spark, album, side):
    read = images.read_images(spark, album).filter("width = 128")
    return images.to_cells(images.to_grids(read, side)).withColumn("image_id", F.element_at(F.split("full_path", "/"), -1))


def test_detection_finds_the_sheet(spark, album):
    found = detect.detect_documents(cells_of(spark, album, 96).drop("full_path")).collect()
    assert {r.image_id for r in found} == set(BOXES)
    for r in found:
        s = 128 / r.gw
        xs, ys = [p["x"] * s for p in r.quad], [p["y"] * s for p in r.quad]
        l, t, rr, b = BOXES[r.image_id]
        inter = max(0, min(max(xs), rr) - max(min(xs), l)) * max(0, min(max(ys), b) - max(min(ys), t))
        union = (max(xs) - min(xs)) * (max(ys) - min(ys)) + (rr - l) * (b - t) - inter
        assert inter / union > 0.85 and r.conf > 0.7, (r, inter / union)


def test_fine_grid_is_like_columns(spark, album):
    """On one grid, the arrays sampled in tasks give what the column expressions give."""
    from shelf.operators import edges, fine

    read = images.read_images(spark, album).filter("width = 128")
    grids = images.to_grids(read, 96).withColumn("image_id", F.element_at(F.split("full_path", "/"), -1)).drop("full_path").withColumnRenamed("w", "pw")
    arrays = detect.image_arrays(cells_of(spark, album, 96).drop("full_path"))
    turns = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(a).alias("ang"), F.lit(d).alias("d")) for k, (a, d) in enumerate([(0.0, 0.0), (0.05, 2.0), (-0.1, -3.0), (0.3, 20.0), (0.0, -40.0)])]))
    rects = arrays.select("image_id", "gw", turns.alias("t")).select(
        "image_id", "gw", F.lit("m").alias("mask"), "t.rank", "t.ang", F.lit(0.9).alias("fill"), *[(F.lit(float(v)) + F.col("t.d")).alias(k) for k, v in (("x0", 14), ("x1", 77), ("y0", 11), ("y1", 57))]
    )
    got = {(r.image_id, r.rank): r for r in fine.judged_rectangles(rects, grids).collect()}
    want = edges.inner_edge(edges.side_contrasts(edges.snap_sides(rects.drop("gw").join(arrays, "image_id")))).collect()
    assert len(got) == len(want) == 20
    for r in want:
        g = got[r.image_id, r.rank]
        assert [g[s] for s in fine.SIDES] == pytest.approx([r[s] for s in fine.SIDES]) and (g.touching, g.inner) == (r.touching, r.inner)
        assert g.contrasts == pytest.approx(r.contrasts, abs=1e-3) and g.purity == pytest.approx(r.purity, abs=1e-4)


def test_two_grids_find_finer_sides(spark, tmp_path, write_png):
    box = (101, 67, 403, 290)
    write_png(tmp_path / "big.png", photo(480, 360, box, 3))
    read = images.read_images(spark, str(tmp_path))
    cells = images.to_cells(images.to_grids(read, 60)).withColumnRenamed("full_path", "image_id")
    fine_grid = images.to_grids(read, 480).withColumnRenamed("full_path", "image_id")

    def off(found):
        r = found.first()
        s = 480 / r.gw
        return max(abs(min(p["x"] for p in r.quad) * s - box[0]), abs(max(p["x"] for p in r.quad) * s - box[2]), abs(min(p["y"] for p in r.quad) * s - box[1]), abs(max(p["y"] for p in r.quad) * s - box[3]))

    one, two = off(detect.detect_documents(cells)), off(detect.detect_documents(cells, fine=fine_grid))
    assert two <= 1.0 < one


def test_locator_learns_the_sheet(spark, album):
    read = images.read_images(spark, album).filter("width = 128")
    pixels = images.to_cells(images.to_grids(read, 32, 8, cell=2)).withColumn("image_id", F.element_at(F.split("full_path", "/"), -1))
    cells = locate.cell_features(pixels.drop("full_path"), cell=2)
    taught = spark.createDataFrame([(n, n, (l / 128, t / 96, r / 128, b / 96)) for n, (l, t, r, b) in BOXES.items()], "image_id string, path string, box struct<l:double,t:double,r:double,b:double>")
    scores = locate.evaluate_folds(cells, taught).collect()
    assert len(scores) == 4 and sum(r.iou for r in scores) / 4 > 0.8
    assert locate.evaluate_folds(cells, taught.limit(3)) is None and locate.train(cells, 2) is None


def test_a_model_is_trained_once(spark, album, folder, monkeypatch):
    from shelf.operators import model_store as store, raster

    read = images.read_images(spark, album).filter("width = 128")
    pixels = images.to_cells(images.to_grids(read, 32, 8, cell=2)).withColumn("image_id", F.element_at(F.split("full_path", "/"), -1))
    cells = locate.cell_features(pixels.drop("full_path"), cell=2)
    cells = cells.join(raster.grid_sizes(cells), "image_id")
    rows = [(n, n, (l / 128, t / 96, r / 128, b / 96), 7) for n, (l, t, r, b) in BOXES.items()]
    kind = "image_id string, path string, box struct<l:double,t:double,r:double,b:double>, mtime long"
    taught = spark.createDataFrame(rows, kind)
    fits, train = [], locate.train
    monkeypatch.setattr(locate, "train", lambda *a: fits.append(a) or train(*a))
    assert store.status(folder, taught).first().trained is False and store.stored_model(folder, taught.limit(2), cells) is None
    first = store.stored_model(folder, taught, cells)
    again = store.stored_model(folder, taught, cells)
    assert len(fits) == 1 and first.toDebugString == again.toDebugString
    assert tuple(store.status(folder, taught).first()) == (4, 3, True, None)
    score = store.record_accuracy(folder, taught, cells)
    assert store.status(folder, taught).first().cv_iou == pytest.approx(score) and len(fits) == 5
    moved = spark.createDataFrame([(*r[:3], 8) if k == 0 else r for k, r in enumerate(rows)], kind)
    assert store.status(folder, moved).first().trained is False
    store.stored_model(folder, moved, cells)
    assert len(fits) == 6 and store.saved_models(spark, folder).count() == 2 and store.status(folder, taught).first().cv_iou == pytest.approx(score)


def test_import_boxes(spark, folder):
    path = os.path.join(folder, "b.json")
    with open(path, "w") as f:
        f.write('{"image_size": [100, 200], "type": "invoice", "boxes": {"a.jpg": [10, 20, 50, 100], "gone.jpg": [1, 2, 3, 4]}}')
    photos = spark.createDataFrame([("/y/a.jpg", 50, 50), ("/x/a.jpg", 200, 100)], "full_path string, w int, h int")
    found = boxes.import_boxes(boxes.read_boxes(spark, path), photos)
    row = found.filter("full_path is not null").first()
    assert (row.full_path, row.l, row.t, row.r, row.b) == ("/x/a.jpg", 20.0, 10.0, 100.0, 50.0)
    assert tuple(boxes.import_counts(found).first()) == (1, 1)


def test_quad_iou_counts_cells(spark):
    rng = np.random.default_rng(4)
    cases = []
    for k in range(60):
        w, h = (int(x) for x in rng.integers(3, 90, 2))
        a, b = ([tuple(map(float, p)) for p in rng.integers(-20, 110, (4, 2)) / 2] for _ in range(2))
        cases.append((k, w, h, a, a if k % 7 == 0 else b))
    kind = "case_id int, w int, h int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>"
    got = {r.case_id: r.iou for r in metrics.quad_iou(spark.createDataFrame(cases, kind)).collect()}

    def inside(quad, x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(quad, quad[1:] + quad[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
        return odd

    for k, w, h, a, b in cases:
        cells = [((cx + 0.5) * 4, (cy + 0.5) * 4) for cx in range(max(1, w // 4)) for cy in range(max(1, h // 4))]
        hits = [(inside(a, *c), inside(b, *c)) for c in cells]
        either = sum(x or y for x, y in hits)
        assert got[k] == pytest.approx(sum(x and y for x, y in hits) / either if either else 0.0), k


def test_quad_iou(spark):
    square = lambda x: [{"x": x, "y": 0.0}, {"x": x + 40, "y": 0.0}, {"x": x + 40, "y": 40.0}, {"x": x, "y": 40.0}]
    pairs = spark.createDataFrame([(1, 100, 40, square(0.0), square(20.0))], "case_id int, w int, h int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    assert metrics.quad_iou(pairs).first().iou == pytest.approx(1 / 3)
    box = spark.createDataFrame([((0.0, 0.0, 0.0, 0.0),)], "b struct<l:double,t:double,r:double,b:double>")
    assert box.select(G.iou(F.col("b"), F.col("b"))).first()[0] == 0.0


def test_best_rectangle_of_large_grids(spark):
    """96 x 96 cells, in stretches of columns: one shuffle, and the planted block is found."""
    from shelf.operators.locate import _best_rectangle

    rng = np.random.default_rng(1)
    grids = {}
    for k in range(3):
        grids[k] = rng.normal(-0.5, 0.2, (96, 96))
        grids[k][20 + k : 70, 11 : 60 + k] += 1.0
    rows = [(k, y, x, float(v)) for k, g in grids.items() for (y, x), v in np.ndenumerate(g)]
    found = locate.best_rectangles(spark.createDataFrame(rows, "image_id int, y int, x int, score double"))
    assert found._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange hash") == 1
    assert {r.image_id: (r.l, r.t, r.r, r.b) for r in found.collect()} == {k: (11, 20 + k, 60 + k, 70) for k in grids}
    ties = np.array([[1.0, -9, 1], [-9, -9, -9], [1, -9, 1]])
    assert _best_rectangle(ties) == (0, 0, 1, 1, 1.0) and _best_rectangle(-np.ones((2, 2))) == (0, 0, 1, 1, -1.0)
    assert _best_rectangle(np.array([[0.0], [0.0], [2.0], [-1.0]]))[:4] == (0, 0, 1, 3)


def test_open_and_close_shuffle_once(spark):
    from shelf.operators import raster

    masks = spark.range(4000).select((F.col("id") % 4).alias("image_id"), (F.col("id") % 2).cast("string").alias("mask"), (F.col("id") % 4).cast("int").alias("rank"), F.floor(F.col("id") / 4 / 32).cast("int").alias("y"), (F.floor(F.col("id") / 4) % 32).cast("int").alias("x"), (F.col("id") % 3 == 0).alias("on"))
    plan = raster.open_close(masks, 32, ("image_id", "mask", "rank"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_best_rectangle_like_brute_force(spark):
    rng = random.Random(4)
    grids = {i: [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(6)] for i in range(12)}
    rows = [(i, y, x, v) for i, g in grids.items() for y, line in enumerate(g) for x, v in enumerate(line)]
    found = locate.best_rectangles(spark.createDataFrame(rows, "image_id int, y int, x int, score double")).collect()
    for r in found:
        sums = {
            (l, t, rr, b): sum(sum(line[l:rr]) for line in grids[r.image_id][t:b])
            for l in range(5) for rr in range(l + 1, 6) for t in range(6) for b in range(t + 1, 7)
        }
        assert r.gain == pytest.approx(max(sums.values())) and sums[(r.l, r.t, r.r, r.b)] == pytest.approx(r.gain)


def test_whole_grids_are_as_cells(spark):
    """Grids in one row each give what their cells give; a grid with cells missing goes by its cells."""
    rng = random.Random(5)
    rows = [
        (k, y, x, *(float(rng.randrange(30) + (180 if 4 + k <= x < 15 + k and 3 <= y < 15 else 60)) for _ in "rgb"))
        for k in range(3) for y in range(18) for x in range(22) if (k, x) != (2, 21) or y < 17
    ]
    cells = spark.createDataFrame(rows, "image_id long, y int, x int, r double, g double, b double")
    found = detect.detect_documents(cells).orderBy("image_id").collect()
    slow = detect._detect_in_cells(cells, 28, None).orderBy("image_id").collect()
    assert [r.method for r in found] == [r.method for r in slow]
    for a, b in zip(found, slow):
        assert a.warnings == b.warnings and a.bg == b.bg and a.conf == pytest.approx(b.conf) and a.angle == b.angle
        assert (a.quad is None) == (b.quad is None) and (a.quad is None or [p for q in a.quad for p in q] == pytest.approx([p for q in b.quad for p in q]))
    whole = detect.detect_in_grids(detect.image_arrays(cells.filter("image_id < 2"))).orderBy("image_id").collect()
    assert whole == found[:2]
