"""Queries that run a stream over the tables to its end, and queries over image bytes."""

import os
import uuid

from pyspark.sql import functions as F

from shelf.catalog.files import EXT, ROOT
from shelf.catalog.logs import WALK
from shelf.fixtures import Tables, query, with_views
from shelf.operators.stored_index import StoredIndex
from shelf.plans.auto_crop import auto_crop
from shelf.session import shared_dir
from shelf.sources import images, orientation
from shelf.sources.listing import index_scan
from shelf.streaming.folds import follow_feedback, read_state
from shelf.streaming.index import follow_index, read_index
from shelf.streaming.online import follow_online, read_online


def _run_folder(t: Tables) -> str:
    return os.path.join(shared_dir(t.spark), f"stream-{uuid.uuid4().hex}")


def _stream(t: Tables, name: str):
    """A table of the data folder as a stream of files."""
    return (
        t.spark.readStream.schema(t.table(name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)
    )


class _Streamed(Tables):
    """The same views with streams in place of tables."""

    def table(self, name: str):
        return _stream(Tables(self.spark, self.folder), name)


@query(
    "A11_streamed_index",
    with_views("files_v", body=f"""select distinct full_path, filename, folder_name, {EXT} as extension from files_v
where {EXT} in ('.jpeg','.jpg','.png','.pdf') and folder_name not like '.%' and folder_name not in ('export_output','pdf','similar_review','auto_cropped')"""),
)
def a11(t):
    at = _run_folder(t)
    listing = _Streamed(t.spark, t.folder).files().select("full_path", "mtime", "length")
    follow_index(listing, os.path.join(at, "index"), ROOT, os.path.join(at, "progress")).awaitTermination()
    return read_index(t.spark, os.path.join(at, "index")).select("full_path", "filename", "folder_name", "extension")


@query(
    "A11_stored_index",
    with_views("files_v", body=f"""select distinct full_path, filename, folder_name, {EXT} as extension from files_v
where {EXT} in ('.jpeg','.jpg','.png','.pdf') and folder_name not like '.%' and folder_name not in ('export_output','pdf','similar_review','auto_cropped')"""),
)
def a11_stored(t):
    """Ten listings are inserted one after the other, the buckets are compacted after the sixth."""
    index = StoredIndex(t.spark, os.path.join(_run_folder(t), "index"), 8)
    files = index_scan(t.files().select("id", "full_path", "mtime", "length"), ROOT)
    for k in range(10):
        index.insert(files.filter(F.pmod(F.xxhash64("id"), F.lit(10)) == k).drop("id"))
        if k == 5:
            index.compact()
    return index.known().select("full_path", "filename", "folder_name", "extension")


@query("E5_streamed_parameters", with_views("feedback_v", ctes=WALK, body="select profile, m as margin, t as threshold from state"))
def e5(t):
    at = _run_folder(t)
    answers = _Streamed(t.spark, t.folder).feedback()
    follow_feedback(answers, os.path.join(at, "state"), os.path.join(at, "progress")).awaitTermination()
    return read_state(t.spark, os.path.join(at, "state"), 0)


@query("E5_online_parameters", with_views("feedback_v", ctes=WALK, body="select profile, m as margin, t as threshold from state"))
def e5_online(t):
    """The answers arrive in four files, each a batch of its own; the stream stops after two and starts again."""
    at = _run_folder(t)
    answers = t.feedback().select("id", "profile", "kind", "spread")
    source, most = os.path.join(at, "answers"), answers.agg(F.max("id")).first()[0] or 0
    for half in (0, 2):
        for k in (half, half + 1):
            part = answers.filter((F.col("id") * 4 > most * k) | F.lit(k == 0)).filter((F.col("id") * 4 <= most * (k + 1)))
            part.coalesce(1).write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(answers.schema).option("maxFilesPerTrigger", 1).parquet(source)
        follow_online(stream, os.path.join(at, "parameters"), os.path.join(at, "online")).awaitTermination()
    return read_online(t.spark, os.path.join(at, "parameters"))


def _bytes(t: Tables):
    """Each vector as the bytes of an 8 x 8 grey image, in the columns of the image reader."""
    levels = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128 + 400 * v.cast("double"))).cast("int"))
    text = F.array_join(F.transform(levels, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    return t.table("embeddings").select(
        F.col("vec_id").cast("string").alias("full_path"), F.lit(8).alias("width"), F.lit(8).alias("height"),
        F.lit(1).alias("nChannels"), F.unhex(text).alias("data"),
    )


@query(
    "G0_image_grid",
    with_views("pixels_v", body="select image_id, y // 2 as y, x // 2 as x, avg(trunc(lum)) as r, avg(trunc(lum)) as b from pixels_v group by image_id, y // 2, x // 2"),
)
def g0(t):
    cells = images.to_cells(images.to_grids(_bytes(t), 4, 4))
    return cells.select(F.col("full_path").cast("bigint").alias("image_id"), "y", "x", "r", "b")


def _turned_bytes(t: Tables):
    """Each vector as a 16 x 4 grey image whose file says, in either byte order, how it is to be turned; every 13th file is none."""
    levels = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128 + 400 * v.cast("double"))).cast("int"))
    text = F.array_join(F.transform(levels, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    value = F.lpad(F.hex(F.pmod("vec_id", F.lit(8)) + 1), 2, "0")
    # start, a comment segment, then the header: byte order, first directory, two entries, of which the second is the orientation
    little = F.concat(F.lit("49492A0008000000" "0200" "0F01020001000000580000001201030001000000"), value, F.lit("000000" "00000000"))
    big = F.concat(F.lit("4D4D002A00000008" "0002" "010F00020000000158000000011200030000000100"), value, F.lit("0000" "00000000"))
    header = F.concat(F.lit("FFD8" "FFFE00044142" "FFE1002E" "457869660000"), F.when(F.col("vec_id") % 2 == 0, little).otherwise(big), F.lit("FFDA"))
    content = F.when(F.col("vec_id") % 13 == 0, F.encode(F.lit("no image"), "utf-8")).otherwise(F.unhex(header))
    rows = t.table("embeddings").select(
        F.col("vec_id").cast("string").alias("full_path"), F.lit(16).alias("width"), F.lit(4).alias("height"), F.lit(1).alias("nChannels"), F.unhex(text).alias("data"),
        orientation.content_orientation(content).alias("orientation"),
    )
    broken = F.col("orientation").isNull()
    return rows.withColumns({"status": F.when(broken, "error").otherwise("ok"), "height": F.when(broken, -1).otherwise(F.col("height"))})


@query(
    "A7_upright_grid",
    """with p as (select vec_id, pos // 16 as y, pos % 16 as x, trunc(greatest(0, least(255, 128 + 400 * v::double)))::double as r, vec_id % 8 + 1 as o
  from (select vec_id, unnest(embedding) as v, unnest(range(0, 64)) as pos from embeddings) where vec_id % 13 <> 0)
select vec_id as image_id, 'ok' as status, case when o >= 5 then 4 else 16 end as w, case when o >= 5 then 16 else 4 end as h,
  case o when 1 then y when 2 then y when 3 then 3 - y when 4 then 3 - y when 5 then x when 6 then x when 7 then 15 - x else 15 - x end as y,
  case o when 1 then x when 2 then 15 - x when 3 then 15 - x when 4 then x when 5 then y when 6 then 3 - y when 7 then 3 - y else y end as x, r from p
union all select vec_id, 'error', null, null, null, null, null from embeddings where vec_id % 13 = 0""",
)
def a7(t):
    photos = _turned_bytes(t)
    grids = images.to_grids(photos, 16)
    cells = images.to_cells(grids).join(grids.select("full_path", "w", "h"), "full_path")
    broken = photos.filter("status = 'error'").select("full_path", "status", *[F.lit(None).cast(k).alias(c) for c, k in (("w", "int"), ("h", "int"), ("y", "int"), ("x", "int"), ("r", "double"))])
    every = cells.select("full_path", F.lit("ok").alias("status"), "w", "h", "y", "x", "r").unionByName(broken)
    return every.select(F.col("full_path").cast("bigint").alias("image_id"), "status", "w", "h", "y", "x", "r")


def _photo_bytes(t: Tables):
    """Each vector as a 32 x 24 grey photo with a sheet whose place, paper and table follow from it, as the image reader gives
    it; some lie on their side, some have too few bytes or could not be read, some show no sheet. el to eb: where it is."""
    v = F.col("vec_id")
    bare = v % 17 == 2
    l, t_, r, b = 5 + v % 4, 4 + v % 3, 27 - v % 3, 20 - v % 2
    paper = F.when(bare, F.lit(60)).otherwise(190 + v % 40)
    table = F.when(bare, F.lit(60)).otherwise(40 + F.coalesce("label", F.lit(0)) * 3)
    dark, light = (F.lpad(F.hex(x.cast("int")), 2, "0") for x in (table, paper))
    rows = t.table("embeddings").select("vec_id", *[x.cast("int").alias(k) for k, x in (("l", l), ("t", t_), ("r", r), ("b", b))], dark.alias("dark"), light.alias("light"))
    text = F.expr("repeat(repeat(dark, 32), t) || repeat(repeat(dark, l) || repeat(light, r - l) || repeat(dark, 32 - r), b - t) || repeat(repeat(dark, 32), 24 - b)")
    lying, short, lost = v % 5 == 1, v % 13 == 0, v % 23 == 4
    turned = {"el": (24 - F.col("b"), "l"), "et": (F.col("l"), "t"), "er": (24 - F.col("t"), "r"), "eb": (F.col("r"), "b")}
    return rows.select(
        F.concat(F.lit("/lake/in/d"), (v % 40).cast("string"), F.lit("/p"), v.cast("string"), F.lit(".jpg")).alias("full_path"),
        F.lit(32).alias("width"), F.when(lost, F.lit(-1)).otherwise(F.lit(24)).alias("height"), F.lit(1).alias("nChannels"),
        F.unhex(F.when(short, F.substring(text, 1, 100)).otherwise(text)).alias("data"), F.when(lying, F.lit(6)).otherwise(F.lit(1)).alias("orientation"),
        *[F.when(lying, on_side).otherwise(F.col(c)).alias(k) for k, (on_side, c) in turned.items()],
    )


@query(
    "F10_auto_crop",
    """select '/lake/in/d' || (vec_id % 40) || '/p' || vec_id || '.jpg' as full_path, case when broken then 'error' when vec_id % 17 = 2 then 'skipped' else 'pending' end as status,
  broken as failed_to_decode, case when broken then null when vec_id % 5 = 1 then 24 else 32 end as w, case when broken then null when vec_id % 5 = 1 then 32 else 24 end as h,
  not broken and vec_id % 17 <> 2 as at_sheet, case when not broken and vec_id % 17 <> 2 then '/lake/auto_cropped/in/d' || (vec_id % 40) || '/p' || vec_id || '.jpg' end as destination
from (select vec_id, vec_id % 13 = 0 or vec_id % 23 = 4 as broken from embeddings)""",
)
def f10(t):
    """Sides are as sharp as smoothing leaves them: within three cells of the sheet counts as at it."""
    photos = _photo_bytes(t)
    found = auto_crop(photos, photos.select("full_path"), "/lake", "/lake/auto_cropped", "run")
    near = [F.abs(F.col(f"box.{s}") - F.col(f"e{s}")) <= 3 for s in "ltrb"]
    return found.join(photos.select("full_path", "el", "et", "er", "eb"), "full_path").select(
        "full_path", "status", ((F.col("status") == "error") & (F.col("stage") == "decode")).alias("failed_to_decode"), "w", "h",
        F.coalesce((F.col("status") == "pending") & near[0] & near[1] & near[2] & near[3], F.lit(False)).alias("at_sheet"), "destination",
    )


@query(
    "D1_perceptual_hashes",
    """with p as (select vec_id, pos // 8 as y, pos % 8 as x, trunc(greatest(0, least(255, 128 + 400 * v::double))) as g
  from (select vec_id, unnest(embedding) as v, unnest(range(0, 64)) as pos from embeddings)),
c as (select u, y, sum(cos(pi() * (2 * (4 * y + k) + 1) * u / 64)) as c from range(0, 8) a(u), range(0, 8) b(y), range(0, 4) d(k) group by u, y),
f as (select vec_id, a.u as u, b.u as v, sum(g * a.c * b.c) as low from p join c a on a.y = p.y join c b on b.y = p.x group by all),
m as (select vec_id, median(low) as m from f group by vec_id),
ph as (select vec_id, sum(case when low > m then (1::hugeint << (63 - (u * 8 + v))::int) else 0 end) as h from f join m using (vec_id) group by vec_id),
w as (select vec_id, y, i, g from p join (select i, floor((i + 0.5) * 8 / 9)::int as x from range(0, 9) t(i)) using (x)),
dh as (select a.vec_id, sum(case when b.g > a.g then (1::hugeint << (63 - (a.y * 8 + a.i))::int) else 0 end) as h from w a join w b on b.vec_id = a.vec_id and b.y = a.y and b.i = a.i + 1 group by a.vec_id)
select vec_id::varchar as full_path, (ph.h - case when ph.h >= 9223372036854775808::hugeint then 18446744073709551616::hugeint else 0 end)::bigint as phash,
  (dh.h - case when dh.h >= 9223372036854775808::hugeint then 18446744073709551616::hugeint else 0 end)::bigint as dhash from ph join dh using (vec_id)""",
)
def d1(t):
    return images.perceptual_hashes(_bytes(t))
