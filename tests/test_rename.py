import datetime
import os.path
import random

import pytest
from pyspark.sql import functions as F

from shelf.functions.templates import Rename, TemplateError, format_counter, format_date, parse_template, target_extension
from shelf.plans.rename import commit_plan, rename_plan

NOON = datetime.datetime(2026, 10, 2)


def files(spark, paths):
    return spark.createDataFrame([(p, NOON) for p in paths], "full_path string, mtime timestamp")


def natural(p):
    import re

    return [int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", os.path.basename(p))], p


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counter_skips_files_that_keep_their_name(spark, seed):
    rng = random.Random(seed)
    paths = sorted({f"/f/{rng.choice(['p', 'p', 'q'])}-{rng.randrange(1, 25):03}.jpg" for _ in range(25)}, key=natural)
    counter, want = 3, {}
    for p in paths:
        new = f"/f/p-{counter:03}.jpg"
        if new == p:
            want[p] = None
        else:
            want[p] = new
            counter += 1
    got = {r.full_path: r.new_path for r in rename_plan(files(spark, paths), Rename(template="p-{n:03}"), start=3).collect()}
    assert got == want


def test_counter_over_numbered_files(spark):
    paths = [f"/f/{i:03}.jpg" for i in range(1, 12)]
    got = {r.full_path: r.new_path for r in rename_plan(files(spark, paths), Rename(template="{n:03}")).collect()}
    # the first keeps its name and its number stays unused
    assert got["/f/001.jpg"] is None and got["/f/002.jpg"] == "/f/001.jpg" and got["/f/011.jpg"] == "/f/010.jpg"


def test_invoice_numbers(spark):
    paths = ["/f/a.jpg", "/f/b.jpg", "/g/c.jpg", "/f/15-09-2026-4.pdf", "/f/15-09-2026.png", "/g/15-09-2026-9.pdf"]
    plan = rename_plan(files(spark, paths), Rename(template="xx", typed="15-09-2026"), invoice=True)
    got = {r.full_path: (r.new_path, r.same) for r in plan.collect()}
    assert got["/f/15-09-2026-4.pdf"] == ("/f/15-09-2026-4.pdf", True)  # keeps its number
    assert got["/f/15-09-2026.png"] == (None, True)
    assert got["/g/15-09-2026-9.pdf"] == ("/g/15-09-2026-9.pdf", True)
    # numbers handed out earlier in the batch count in other folders too
    assert [got[p][0] for p in ("/f/a.jpg", "/f/b.jpg", "/g/c.jpg")] == ["/f/15-09-2026-10.jpg", "/f/15-09-2026-11.jpg", "/g/15-09-2026-12.jpg"]
    numbered = rename_plan(files(spark, ["/f/a.jpg"]), Rename(template="xx-{n}", typed="q"), invoice=True).first()
    assert numbered.new_path == "/f/q-1.jpg"


def test_commit_frees_names_in_order(spark):
    rows = [(1, "/f/a", "/f/z"), (2, "/f/b", "/f/a"), (3, "/f/c", "/f/b"), (4, "/f/d", "/f/e"), (5, "/f/e", "/f/y"), (6, "/f/g", "/f/z")]
    plan = spark.createDataFrame([(*r, None, False) for r in rows], "position int, full_path string, new_path string, err string, same boolean")
    listing = spark.createDataFrame([(r[1],) for r in rows], "full_path string")
    got = {r.position: r.destination for r in commit_plan(plan, listing).collect()}
    assert got == {1: "/f/z", 2: "/f/a", 3: "/f/b", 4: None, 5: "/f/y", 6: None}
    both = {r.position: r.destination for r in commit_plan(plan, listing, keep_both=True).collect()}
    assert both[4] == "/f/e (1)" and both[6] == "/f/z (1)"


@pytest.mark.parametrize("seed", range(4))
def test_commit_keep_both_in_order(spark, seed):
    """Chains and swaps: names are given one row after the other, each row leaving its old name."""
    rng = random.Random(seed)
    names = [f"/f/{c}" for c in "abcdefghijkl"]
    there = rng.sample(names, 8)
    movers = rng.sample(there, 7)
    rows = [(k + 1, p, rng.choice([n for n in names if n != p])) for k, p in enumerate(movers)]
    now, want = set(there), {}
    for k, old, new in rows:
        slot = 0
        while (f"{new} ({slot})" if slot else new) in now:
            slot += 1
        want[k] = f"{new} ({slot})" if slot else new
        now = now - {old} | {want[k]}
    plan = spark.createDataFrame([(*r, None, False) for r in rows], "position int, full_path string, new_path string, err string, same boolean")
    listing = spark.createDataFrame([(p,) for p in there], "full_path string")
    assert {r.position: r.destination for r in commit_plan(plan, listing, keep_both=True).collect()} == want


def test_commit_keep_both_frees_the_name_of_a_row_that_lost(spark):
    rows = [(1, "/f/x", "/f/y"), (2, "/f/z", "/f/x")]
    plan = spark.createDataFrame([(*r, None, False) for r in rows], "position int, full_path string, new_path string, err string, same boolean")
    listing = spark.createDataFrame([("/f/x",), ("/f/y",), ("/f/z",)], "full_path string")
    got = {r.position: r.destination for r in commit_plan(plan, listing, keep_both=True).collect()}
    assert got == {1: "/f/y (1)", 2: "/f/x"}


def test_templates():
    parts = {
        "xx-{n:03}": [("typed", ""), ("text", "-"), ("n", "03")], "axx": [("text", "axx")], "{XX}a": [("typed", ""), ("text", "a")],
        "{exif_date}xx": [("exif_date", "%Y-%m-%d"), ("text", "xx")], "{exif_date:%Y.}xx": [("exif_date", "%Y."), ("typed", "")],
        "{{orig}} {no}": [("text", "{"), ("orig", ""), ("text", "} {no}")], "": [("typed", "")],
    }
    for text, wanted in parts.items():
        assert parse_template(text).parts == wanted
    assert [target_extension(c) for c in (None, " ", "png", ".PnG ")] == [None, None, ".png", ".PnG"]
    for wrong in (".", "..a", "a b", "é", "123456789"):
        with pytest.raises(TemplateError):
            target_extension(wrong)


def test_counter_formats(spark):
    wide = {"": "1234", "06d": "001234", "120": "1234".rjust(120), "8,": "   1,234"}
    got = spark.range(1234, 1235).select(*[format_counter(F.col("id"), f).alias(f or "none") for f in wide]).first()
    assert list(got) == list(wide.values())
    for wrong in ("08,", "e", "-3", "x"):
        with pytest.raises(TemplateError):
            format_counter(F.col("id"), wrong)


def test_date_codes_like_strftime(spark):
    """Every code, with and without flags, against the clock of this machine."""
    moments = [datetime.datetime(*t) for t in ((2026, 1, 1, 0, 5, 9, 40), (2024, 12, 30, 12), (2023, 1, 1, 13, 59, 59), (2021, 3, 7, 9, 8, 7, 123456), (1999, 12, 31, 23, 0, 1))]
    codes = [f"%{c}" for c in "aAbBcCdDeFgGhHIjklmMnpPrRSstTuUVwWxXyYzZf%Q"] + ["%-d.%-m", "%_d", "%^a", "%-H", "%^b", "x%", "%", "a%Qb%Y", "%-j", "%_H"]
    df = spark.createDataFrame([(k, m) for k, m in enumerate(moments)], "k int, at timestamp")
    rows = df.select("k", *[format_date(F.col("at"), c).alias(f"c{i}") for i, c in enumerate(codes)]).collect()
    for r in rows:
        got = {c: r[f"c{i}"] for i, c in enumerate(codes)}
        want = {c: str(int(moments[r.k].replace(tzinfo=datetime.timezone.utc).timestamp())) if c == "%s" else moments[r.k].strftime(c) for c in codes}
        assert got == want
