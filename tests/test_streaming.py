import os
import time

from pyspark.sql import functions as F

from shelf.fixtures import Tables
from shelf.operators import folds
from shelf.sources.listing import index_scan
from shelf.streaming.folds import follow_feedback, read_state
from shelf.streaming.index import follow_index, read_index


def test_index_from_a_stream(spark, data, folder):
    files = Tables(spark, data).files().select("full_path", "mtime", "length")
    source = os.path.join(folder, "in")
    files.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 2).parquet(source)
    for _ in range(2):  # a second start finds nothing new
        follow_index(stream, os.path.join(folder, "index"), "/lake", os.path.join(folder, "check")).awaitTermination()
    found = read_index(spark, os.path.join(folder, "index"))
    assert found.select("batch").distinct().count() >= 2
    want = index_scan(files, "/lake").select("full_path").distinct()
    assert found.count() == want.count() and found.join(want, "full_path", "left_anti").isEmpty()


def test_feedback_from_a_stream(spark, data, folder):
    answers = Tables(spark, data).feedback().select("id", "profile", "kind", "spread")
    source = os.path.join(folder, "in")
    for i, half in enumerate(("id < 500", "id >= 500")):
        answers.filter(half).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(answers.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
    query = follow_feedback(stream, os.path.join(folder, "state"), os.path.join(folder, "check"))
    query.awaitTermination()
    got = {r.profile: (r.margin, r.threshold) for r in read_state(spark, os.path.join(folder, "state"), 1).collect()}
    margin = {r.profile: r.value for r in folds.fold(answers, ["profile"], F.lit(1.0), folds.margin_effect()).collect()}
    threshold = {r.profile: r.value for r in folds.fold(answers, ["profile"], F.lit(10), folds.threshold_effect()).collect()}
    assert got == {p: (margin[p], threshold[p]) for p in margin}


def test_files_that_appear(spark, tmp_path, write_png):
    from shelf.streaming.index import watch_files

    root, pixels = tmp_path / "photos", [[(1, 2, 3)] * 4] * 4
    for name in ("_a/_x.jpg", "b/_y.png", "_z.png"):
        os.makedirs((root / name).parent, exist_ok=True)
        write_png(root / name, pixels)

    def run():
        time.sleep(0.3)
        follow_index(watch_files(spark, str(root)), str(tmp_path / "index"), str(root), str(tmp_path / "progress")).awaitTermination()
        return {os.path.relpath(r.full_path, root): r.batch for r in read_index(spark, str(tmp_path / "index")).collect()}

    first = run()
    assert set(first) == {"_a/_x.jpg", "b/_y.png"}  # the root's own files are not indexed
    os.makedirs(root / "c/.hidden")
    write_png(root / "c/_new.png", pixels)
    write_png(root / "c/.hidden/_h.png", pixels)
    os.utime(root / "c/_new.png", (1, 1))  # moved in with an old date
    second = run()
    assert set(second) == {*first, "c/_new.png"} and second["c/_new.png"] > max(first.values())
    assert run() == second


def test_answers_one_by_one():
    """The plain step agrees with the composed effects on every kind of answer."""
    from shelf.streaming.online import learned

    assert learned(1.0, 10, "crop_too_tight", 3) == (1.5, 10) and learned(8.0, 10, "crop_too_tight", None) == (8.0, 10)
    assert learned(0.0, 10, "crop_too_loose", 3) == (0.0, 10) and learned(3.0, 7, "reset", 0) == (1.0, 10)
    assert learned(1.0, 10, "similar_yes", 7) == (1.0, 10) and learned(1.0, 10, "similar_yes", 8) == (1.0, 11) and learned(1.0, 20, "similar_yes", None) == (1.0, 20)
    assert learned(1.0, 10, "similar_no", 9) == (1.0, 7) and learned(1.0, 10, "similar_no", 30) == (1.0, 9) and learned(1.0, 4, "similar_no", None) == (1.0, 4)
    assert learned(1.0, 10, None, None) == learned(1.0, 10, "crop_good", 2) == (1.0, 10)
