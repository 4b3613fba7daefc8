import os.path
import random

import pytest
from pyspark.sql import functions as F

from shelf.operators import numbering
from shelf.operators.numbering import global_position, row_numbers
from shelf.operators.slots import free_destinations


def one_by_one(plan, existing, first):
    used, out = set(existing), {}
    for source, folder, name in sorted(plan):
        stem, ext = os.path.splitext(name)
        path, n = f"{folder}/{name}", 1
        if first == 1:
            path = f"{folder}/{stem} (1){ext}"
            n = 2
        while path in used:
            path, n = f"{folder}/{stem} ({n}){ext}", n + 1
        used.add(path)
        out[source] = path
    return out


def run(spark, plan, existing, first=0):
    p = spark.createDataFrame(plan, "source string, dest_dir string, filename string")
    e = spark.createDataFrame([(x,) for x in existing] or [("/none/x",)], "full_path string")
    return {r.source: r.destination for r in free_destinations(p, e, ["source"], first_slot=first).collect()}


def test_known_case(spark):
    plan = [(f"/s/{i}", "/d", "a.jpg") for i in range(3)]
    assert sorted(run(spark, plan, ["/d/a.jpg", "/d/a (2).jpg"]).values()) == ["/d/a (1).jpg", "/d/a (3).jpg", "/d/a (4).jpg"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_like_one_by_one_with_literal_numbers(spark, seed):
    rng = random.Random(seed)
    names = ["a.jpg", "a (1).jpg", "a (2).jpg", "a (1) (1).jpg", "b.jpg", "a (02).jpg", ".c"]
    plan = [(f"/s/{i:03}", rng.choice(["/d", "/e"]), rng.choice(names)) for i in range(40)]
    existing = [f"/d/{n}" for n in ("a (3).jpg", "b (1).jpg", "a (1) (1).jpg")]
    assert run(spark, plan, existing) == one_by_one(plan, existing, 0)


def test_split_path_gives_the_same(spark, monkeypatch):
    rng = random.Random(7)
    plan = [(f"/s/{i:03}", "/d", "a.jpg" if rng.random() < 0.8 else "b.jpg") for i in range(120)]
    existing = ["/d/a.jpg"] + [f"/d/a ({n}).jpg" for n in rng.sample(range(1, 200), 40)]
    monkeypatch.setattr(numbering, "GROUP_ROWS", 10)
    assert run(spark, plan, existing) == one_by_one(plan, existing, 0)
    plain = [("/s/1", "/d", "a.jpg"), ("/s/2", "/d", "a.jpg")]
    assert run(spark, plain, ["/d/a (1).jpg"], 1) == {"/s/1": "/d/a (2).jpg", "/s/2": "/d/a (3).jpg"}


def test_row_numbers_split(spark):
    df = spark.range(3000).select((F.col("id") % 7 % 3).alias("g"), F.xxhash64("id").alias("o"))
    windowed = row_numbers(df, ["g"], ["o"], "n", group_rows=10**6).collect()
    split = row_numbers(df, ["g"], ["o"], "n", group_rows=5).select("g", "o", "n").collect()
    assert sorted(map(tuple, windowed)) == sorted(map(tuple, split))
    ordered = global_position(df, [F.col("o")], "p").orderBy("p").collect()
    assert [r.o for r in ordered] == sorted(r.o for r in ordered) and [r.p for r in ordered] == list(range(1, 3001))
