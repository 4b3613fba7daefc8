import datetime

import pytest
from pyspark.sql import functions as F

from shelf.functions import metadata, paths as P
from shelf.functions.names import date_in_name, human_size, natural_key
from shelf.functions.templates import EMPTY_NAME, NO_EXIF_DATE, Rename, TemplateError, java_pattern, parse_template, renamed

NOON = datetime.datetime(2026, 10, 2, 9, 5, 7)


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "t string")


def rename(spark, path, template="", counter=1, **settings):
    rows = spark.createDataFrame([(path, NOON)], "full_path string, mtime timestamp")
    moment = F.lit(NOON)
    r = rows.select(renamed(Rename(template=template, **settings), counter=F.lit(counter), today=moment).alias("r")).first()["r"]
    return r["err"] or (r["new_path"] and r["new_path"].rsplit("/", 1)[1])


@pytest.mark.parametrize(
    "name,expected",
    [
        ("01-08-2026.jpg", (1, 8, 2026)), ("IMG_01_08_2026_x.png", (1, 8, 2026)), ("٠١-٠٨-٢٠٢٦.jpg", (1, 8, 2026)),
        ("31.02.2025.jpg", (31, 2, 2025)), ("2026-08-01.jpg", None), ("01-08-12026.jpg", None),
        ("99-08-2026 01-08-2026.jpg", None), ("201-08-2026 02-09-2027", (2, 9, 2027)),
    ],
)
def test_date_in_name(spark, name, expected):
    d = texts(spark, [name]).select(date_in_name("t").alias("d")).first()["d"]
    assert (tuple(d) if d else None) == expected


def test_natural_order(spark):
    names = ["b", "a10", "a2", "10", "2", "A1", "a", "a-", "a1b", "a1", "007", "x99999999999999999999999999999999999999999999", "x1"]
    got = [r.t for r in texts(spark, names).orderBy(natural_key("t"), "t").collect()]

    def key(s):
        import re

        return [int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", s)]

    assert [key(a) for a in got] == sorted(key(a) for a in names)


def test_paths(spark):
    names = [".bashrc", "a.tar.gz", "..a.b", "a.", "noext", ".a.jpg"]
    import os.path

    got = texts(spark, names).select(P.stem("t"), P.extension("t")).collect()
    assert [tuple(r) for r in got] == [os.path.splitext(n) for n in names]


def test_scope_and_climb(spark):
    rows = texts(spark, ["/a/b/x", "/a/b/../c/x", "/a/./b/x", "/ab/x", "/a/../../a/b/x"])
    assert [r[0] for r in rows.select(P.in_scope("t", "/a/b")).collect()] == [True, False, True, False, True]
    rows = texts(spark, ["/w/08-2026/01-08-2026", "/w/x", "/w/08-2026/x", "/08-2026"])
    assert [r[0] for r in rows.select(P.climb_out_of_dates("t")).collect()] == ["/w", "/w/x", "/w/08-2026/x", "/08-2026"]


def test_human_size(spark):
    sizes = [0, 1023, 1024, 1280, 1048576, 1310720, 5 * 1024**4]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "n bigint").select(human_size("n")).collect()]
    assert got == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.0 MB", "1.2 MB", "5120.0 GB"]


@pytest.mark.parametrize(
    "path,settings,expected",
    [
        ("/f/scan.pdf", dict(template="xx-09-2026", typed="invoice-ali"), "invoice-ali-09-2026.pdf"),
        ("/f/IMG_0042.jpg", dict(template="{orig}-checked"), "IMG_0042-checked.jpg"),
        ("/f/a.jpg", dict(template="{n:03}-xx", typed="sunset"), "001-sunset.jpg"),
        ("/f/a.pdf", dict(template="xx_{date:%Y%m%d}", typed="receipt"), "receipt_20261002.pdf"),
        ("/f/a.pdf", dict(template="{mtime:%H.%M}-{MTIME}"), "09.05-2026-10-02.pdf"),
        ("/f/IMG_0042.jpg", dict(template="{orig}", find=r"IMG_(\d+)", replace=r"photo-\1"), "photo-0042.jpg"),
        ("/f/a b  c.jpg", dict(template="{orig}", find=r"\s+", replace="_"), "a_b_c.jpg"),
        ("/f/20261002_scan.jpg", dict(template="{orig}", find=r"^(\d{4})(\d{2})(\d{2})", replace=r"\1-\2-\3"), "2026-10-02_scan.jpg"),
        ("/f/a(1).jpg", dict(template="{orig}", find="[()]", replace=""), "a1.jpg"),
        ("/f/a.jpg", dict(template="{orig}", find="(", replace=""), "Regex error: missing ), unterminated subpattern at position 0"),
        ("/f/a.jpg", dict(template="xx"), None),
        ("/f/a.jpg", dict(template="xx", extension="jpeg"), "a.jpeg"),
        ("/f/a.jpg", dict(template="xx", extension="j p"), "Invalid extension “j p”"),
        ("/f/a.jpg", dict(template="xx", typed="name.JPG"), "name.jpg"),
        ("/f/a.jpg", dict(template="xx", typed="a:b?"), "a_b_.jpg"),
        ("/f/a.jpg", dict(template="xx", typed=" .. "), EMPTY_NAME),
        ("/f/a.jpg", dict(template="boxx {xx}", typed="q"), "boxx q.jpg"),
        ("/f/a.jpg", dict(template="{exif_date}"), NO_EXIF_DATE),
        ("/f/a.jpg", dict(template="{n:x}"), "Template error: format 'x' of the counter"),
    ],
)
def test_rename(spark, path, settings, expected):
    assert rename(spark, path, **settings) == expected


def test_bare_xx_next_to_a_date():
    assert parse_template("{exif_date}xx").parts[-1] == ("text", "xx")
    assert parse_template("{exif_date}_xx").parts[-1] == ("typed", "")
    assert parse_template("{orig}xx").parts[-1] == ("typed", "")


def test_java_pattern():
    assert java_pattern(r"(?P<a_b>x)", r"\g<a_b>0$", False) == ("(?U)(?<g1>x)", r"${g1}0\$")
    assert java_pattern("(x)", r"\g<1>0", False)[1] == r"$1\0"
    with pytest.raises(TemplateError):
        java_pattern("x", r"\3", False)


def test_metadata(spark):
    files = spark.createDataFrame([(".pdf", "", "x"), (".png", "T", "x"), (".gif", "", "")], "ext string, title string, comment string")
    got = metadata.merge_fields(files, {"title": "T", "comment": "c", "author": " "}).collect()
    assert [(r.title, r.comment, r.status) for r in got] == [("T", "x", "done"), ("T", "c", "done"), ("", "", "skipped")]
    with pytest.raises(ValueError):
        metadata.merge_fields(files, {"title": " "})
