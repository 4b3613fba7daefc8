"""Roots with and without slashes at their end, and paths of several stores."""

import os

from pyspark.sql import functions as F

from shelf.functions import paths as P
from shelf.sources.listing import distinct_paths, image_scan, index_scan, read_listing
from shelf.sources.walk import FolderFiles


def listing(spark, paths):
    return spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "id long, full_path string")


def test_root_forms(spark):
    files = listing(spark, ["/photos/a/x.jpg", "/photos/b/_y.png", "/photosets/z.jpg", "/photos/x.jpg"])
    for scan in (image_scan, index_scan):
        plain = sorted(r.full_path for r in scan(files, "/photos").collect())
        assert plain and all(p.startswith("/photos/") for p in plain)
        for root in ("/photos/", "/photos//", F.lit("/photos/")):
            assert sorted(r.full_path for r in scan(files, root).collect()) == plain
    assert image_scan(files, "/").count() == 4
    assert [r.full_path for r in image_scan(files, "/photos/", recursive=False).collect()] == ["/photos/x.jpg"]


def test_two_buckets(spark):
    read = ["s3a://one/p/x.jpg", "s3a://two/p/x.jpg", "file:/p/x.jpg", "file:///p/y.jpg"]
    files = listing(spark, read).withColumn("full_path", P.path_from_scheme("full_path"))
    assert distinct_paths(files).count() == 4
    assert sorted(r.full_path for r in files.collect()) == ["/p/x.jpg", "/p/y.jpg", "s3a://one/p/x.jpg", "s3a://two/p/x.jpg"]
    assert [r.full_path for r in image_scan(files, "s3a://two/").collect()] == ["s3a://two/p/x.jpg"]
    uri = spark.createDataFrame([("hdfs://n:1/p/a%20+b.png",), ("file:///p/a%20b.png",)], "u string").select(P.path_from_uri("u").alias("p"))
    assert sorted(r.p for r in uri.collect()) == ["/p/a b.png", "hdfs://n:1/p/a +b.png"]


def test_many_folders(spark, tmp_path):
    """Folders are rows: one job per level, whatever their number."""
    names = [f"_{k % 7}/d{k % 90}/e{k}/_f.jpg" for k in range(2000)]
    for name in names:
        os.makedirs((tmp_path / name).parent)
        (tmp_path / name).write_bytes(b"x")
    os.symlink(tmp_path / "gone", tmp_path / "_0/dangling.jpg")
    os.symlink(tmp_path / "_1", tmp_path / "_0/again")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("walk", "walk")
    found = {os.path.relpath(r.full_path, tmp_path): r.length for r in read_listing(spark, str(tmp_path)).collect()}
    n = len(jobs.getJobIdsForGroup("walk"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {**dict.fromkeys(names, 1), "_0/dangling.jpg": None} and n < 40
    spark.dataSource.register(FolderFiles)
    direct = spark.read.format("folder_files").load(str(tmp_path))
    assert {os.path.relpath(r.full_path, tmp_path) for r in direct.collect()} == set(names) and direct.rdd.getNumPartitions() >= 64


def test_stored_index(spark, folder):
    """Ten inserts and a compaction: known paths never shuffle, a repeated insert adds nothing."""
    from shelf.operators.stored_index import StoredIndex

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = StoredIndex(spark, f"{folder}/index", 4)
        batches = [spark.createDataFrame([(f"/p/{(k * 7 + j) % 90}.jpg", j) for j in range(30)], "full_path string, mtime long") for k in range(10)]
        assert index.known() is None
        for b in batches:
            index.insert(b)
        want = {r.full_path for b in batches for r in b.collect()}
        rows = [r.full_path for r in index.known().collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want and index.files() > 4
        plan = index.missing(batches[3])._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        at = next(k for k, line in enumerate(lines) if "Bucketed: true" in line)
        depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
        above = []  # what stands above the scan of the known paths, up to the join
        for k in range(at - 1, -1, -1):
            if depth[k] < depth[at]:
                at, above = k, [*above, lines[k]]
                if "Join" in lines[k]:
                    break
        assert above and "LeftAnti" in above[-1] and not any("Exchange" in line for line in above)
        index.insert(batches[2])
        assert index.known().count() == len(want)
        index.compact()
        assert index.files() == 4 and {r.full_path for r in index.known().collect()} == want
        again = StoredIndex(spark, f"{folder}/index", 4)
        again.insert(spark.createDataFrame([("/p/new.jpg", 1), ("/p/1.jpg", 2)], "full_path string, mtime long"))
        assert again.known().count() == len(want) + 1 and again.missing(batches[0]).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
