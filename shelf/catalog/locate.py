"""Queries over the learned locator, accuracy figures and box imports."""

from pyspark.sql import functions as F

from shelf.catalog.raster import _tiles
from shelf.fixtures import Tables, query, with_views
from shelf.functions import geometry as G
from shelf.operators import crop, locate, metrics, raster
from shelf.sources import boxes

TILE = """tile as (select image_id // 4 as image_id, y + case when image_id % 4 >= 2 then 8 else 0 end as y, x + (image_id % 2) * 8 as x, lum from pixels_v)"""


def _taught(t: Tables):
    """A box per 16 x 16 image, as fractions, from the labels of its four vectors."""
    return t.table("embeddings").groupBy(F.floor(F.col("vec_id") / 4).alias("image_id")).agg(
        F.min("label").alias("lo"), F.max("label").alias("hi")
    ).select(
        "image_id", F.concat(F.lit("/lake/in/"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("path"),
        G.box(F.col("lo") / 40, F.col("lo") / 30, 1 - (9 - F.col("hi")) / 40, 1 - (9 - F.col("hi")) / 50).alias("box"),
    )


TAUGHT = """taught as (select vec_id // 4 as image_id, '/lake/in/' || (vec_id // 4) || '.jpg' as path, min(label) / 40 as l, min(label) / 30 as t, 1 - (9 - max(label)) / 40 as r, 1 - (9 - max(label)) / 50 as b
from embeddings group by vec_id // 4)"""


@query(
    "L1_cell_features",
    with_views("pixels_v", ctes=TILE + """,
step as (select *, abs(lum - coalesce(lag(lum) over (partition by image_id, y order by x), lum)) as gx from tile),
cell as (select image_id, y // 2 as y, x // 2 as x, avg(lum) as lum, sqrt(greatest(0, avg(lum * lum) - avg(lum) * avg(lum))) as std, avg(gx) as gx from step group by all),
wide as (select a.image_id, a.y, a.x, sum(b.lum) / 25 as lum5 from cell a, (select unnest(range(-2, 3)) as dx) dx, (select unnest(range(-2, 3)) as dy) dy, cell b
  where b.image_id = a.image_id and b.x = greatest(0, least(7, a.x + dx)) and b.y = greatest(0, least(7, a.y + dy)) group by a.image_id, a.y, a.x),
mid as (select image_id, median(lum) as m from cell group by image_id)""",
        body="select image_id, y, x, 38 as n, round(lum, 6) as lum, round(lum5, 6) as lum5, round(std, 6) as std, round(gx, 6) as gx, round(lum - m, 6) as lum_to_median, x / 7 as px from cell join wide using (image_id, y, x) join mid using (image_id)"),
)
def l1(t):
    f = F.col("features")
    at = {name: i * 3 for i, name in enumerate(locate.FEATURES)}
    return locate.cell_features(_tiles(t), cell=2).select(
        "image_id", "y", "x", F.size(f).alias("n"), F.round(f[at["lum"]], 6).alias("lum"), F.round(f[at["lum"] + 1], 6).alias("lum5"),
        F.round(f[at["std"]], 6).alias("std"), F.round(f[at["gx"]], 6).alias("gx"), F.round(f[33], 6).alias("lum_to_median"), f[36].alias("px"),
    )


@query(
    "L2_cell_labels",
    with_views("pixels_v", ctes=TILE + ",\n" + TAUGHT + """,
cover as (select image_id, y, x, greatest(0, least((x + 1) / 16, r) - greatest(x / 16, l)) * 16 * greatest(0, least((y + 1) / 16, b) - greatest(y / 16, t)) * 16 as c from tile join taught using (image_id))""",
        body="select image_id, y, x, case when c > 0.8 then 1.0 else 0.0 end::double as label from cover where c > 0.8 or c < 0.2"),
)
def l2(t):
    cells = _tiles(t).select("image_id", "y", "x")
    sized = cells.join(raster.grid_sizes(cells), "image_id")
    return locate.cell_labels(sized, _taught(t)).select("image_id", "y", "x", "label")


def _learned(t: Tables):
    """Cell probabilities of a forest trained on all taught boxes."""
    cells = locate.cell_features(_tiles(t), cell=2)
    cells = locate.write_down(cells.join(raster.grid_sizes(cells), "image_id"), "cells")
    taught = _taught(t)
    model = locate.train(locate.cell_labels(cells, taught), taught.count())
    return locate.cell_probabilities(model, cells)


@query("L3_trained_locator")
def l3(t):
    found = locate.predictions(_learned(t)).join(_taught(t), "image_id")
    return found.select("image_id", F.round(G.iou(F.col("pred_box"), F.col("box")), 3).alias("iou"))


@query("L4_cell_probabilities")
def l4(t):
    return _learned(t).select("image_id", "y", "x", F.round("p", 6).alias("p"))


@query(
    "L5_best_rectangle",
    with_views("pixels_v", ctes="""score as (select image_id, y, x, lum / 255 - 0.5 as v from pixels_v),
pre as (select image_id, y, x, sum(v) over (partition by image_id, y order by x) as p from score),
seg as (select a.image_id, a.y, l.l, a.x + 1 as r, a.p - coalesce(b.p, 0) as s from pre a join (select unnest(range(0, 8)) as l) l on l.l <= a.x
  left join pre b on b.image_id = a.image_id and b.y = a.y and b.x = l.l - 1),
rect as (select a.image_id, a.l, a.r, a.y as t, b.y + 1 as b, sum(c.s) as gain from seg a join seg b on b.image_id = a.image_id and b.l = a.l and b.r = a.r and b.y >= a.y
  join seg c on c.image_id = a.image_id and c.l = a.l and c.r = a.r and c.y between a.y and b.y group by all)""",
        body="select image_id, l, t, r, b, round(gain, 6) as gain from rect qualify row_number() over (partition by image_id order by round(gain, 9) desc, l, r, b, t) = 1"),
)
def l5(t):
    scored = t.pixels().select("image_id", "y", "x", (F.col("lum") / 255 - 0.5).alias("score"))
    return locate.best_rectangles(scored).withColumn("gain", F.round("gain", 6))


@query("L6_predictions")
def l6(t):
    grey = t.pixels().select("image_id", "y", "x", (F.col("lum") / 255).alias("p"))
    found = locate.predictions(grey)
    return found.select("image_id", *[F.round(f"pred_box.{s}", 6).alias(s) for s in "ltrb"], F.round("pred_conf", 6).alias("conf"))


SIGNATURE = """sample as (select source_path || '|' || printf('%.4f,%.4f,%.4f,%.4f', box_l, box_t, box_r, box_b) || '|' || id as text from examples_v where low_quality = 0
  qualify row_number() over (partition by source_path order by id desc) = 1),
sums as (select count(*) as n, sum(('0x' || substr(md5(text), 1, 12))::hugeint) as a, sum(('0x' || substr(md5(text), 13, 12))::hugeint) as b from sample)"""


@query(
    "L7_model_status",
    with_views("images_v", "examples_v", ctes=SIGNATURE, body="select n, 3 as needed, true as trained, 0.5::double as cv_iou, md5('3:' || n || ':' || a || ':' || b) as signature from sums"),
)
def l7(t):
    samples = crop.latest_examples(t.examples()).select(
        F.col("source_path").alias("path"), *[f"box_{s}" for s in "ltrb"], F.col("id").alias("mtime")
    )
    saved = locate.examples_signature(samples).select("signature", F.lit(0.5).alias("cv_iou"))
    return locate.model_status(samples, saved).join(locate.examples_signature(samples), "n")


def _quads(t: Tables):
    found = t.images().filter("det_conf is not null")
    w, h = F.col("w"), F.col("h")
    a = G.box_quad(G.box(F.col("det_l") * w, F.col("det_t") * h, F.col("det_r") * w, F.col("det_b") * h))
    slant = F.array(*[G.point(x * w, y * h) for x, y in ((0.1, 0.2), (0.9, 0.1), (0.85, 0.9), (0.15, 0.8))])
    return found.select(F.col("image_id").alias("case_id"), "w", "h", a.alias("a"), F.transform(slant, lambda p: p).alias("b"))


SLANT = [(0.1, 0.2), (0.9, 0.1), (0.85, 0.9), (0.15, 0.8)]
CROSSED = ", ".join(
    f"case when ({a[1]} * h::double > py) <> ({b[1]} * h::double > py) then {a[0]} * w::double + (py - {a[1]} * h::double)"
    f" * ({b[0]} * w::double - {a[0]} * w::double) / ({b[1]} * h::double - {a[1]} * h::double) end"
    for a, b in zip(SLANT, SLANT[1:] + SLANT[:1])
)


@query(
    "I1_quad_iou",
    with_views("images_v", ctes=f"""line as (select *, greatest(1, w // 4) as cols, (cy + 0.5::double) * 4 as py
  from images_v, lateral (select unnest(range(0, greatest(1, h // 4))) as cy) where det_conf is not null),
cut as (select image_id, cols, py >= det_t * h and py < det_b * h as inside, det_l * w as l, det_r * w as r, list_filter([{CROSSED}], lambda x: x is not null) as x from line),
cell as (select image_id, case when inside then least(cols, greatest(0, ceil(l / 4 - 0.5))) else 0 end as al, case when inside then least(cols, greatest(0, ceil(r / 4 - 0.5))) else 0 end as ar,
  coalesce(least(cols, greatest(0, ceil(list_min(x) / 4 - 0.5))), 0) as bl, coalesce(least(cols, greatest(0, ceil(list_max(x) / 4 - 0.5))), 0) as br from cut),
area as (select image_id, sum(greatest(0, least(ar, br) - greatest(al, bl))) as common, sum(ar - al) + sum(br - bl) as parts from cell group by image_id)""",
        body="select image_id as case_id, round(common / (parts - common), 9) as iou from area"),
)
def i1(t):
    return metrics.quad_iou(_quads(t)).withColumn("iou", F.round("iou", 9))


def _cases(t: Tables):
    a = G.box(*[F.col(f"det_{s}") for s in "ltrb"])
    b = G.box(*[F.col(f"box_{s}") for s in "ltrb"])
    return t.examples().select(
        F.col("id").alias("case_id"), F.col("type").alias("kind"), F.coalesce("det_conf", F.lit(0.0)).alias("conf"),
        F.coalesce(G.iou(a, b), F.lit(0.0)).alias("iou"),
    )


CASES = """cases as (select id as case_id, type as kind, coalesce(det_conf, 0) as conf, case when det_l is null then 0 else i / ((det_r - det_l) * (det_b - det_t) + (box_r - box_l) * (box_b - box_t) - i) end as iou
from (select *, greatest(0, least(det_r, box_r) - greatest(det_l, box_l)) * greatest(0, least(det_b, box_b) - greatest(det_t, box_t)) as i from examples_v))"""


@query(
    "I2_accuracy_summary",
    with_views("images_v", "examples_v", ctes=CASES, body="""select count(*) as cases, round(avg(iou), 9) as mean_iou, round(median(iou), 9) as median_iou, round(avg((iou >= 0.93)::int), 9) as good,
round(avg((iou >= 0.9)::int), 9) as "right", round(avg((iou < 0.85)::int), 9) as bad, count(*) filter (iou < 0.9) as wrong, count(*) filter (iou < 0.9 and conf < 0.7) as wrong_flagged,
count(*) filter (iou >= 0.9 and conf < 0.7) as right_flagged from cases"""),
)
def i2(t):
    figures = metrics.accuracy_summary(_cases(t))
    return figures.withColumns({c: F.round(c, 9) for c in ("mean_iou", "median_iou", "good", "right", "bad")})


@query(
    "I2_accuracy_by_kind",
    with_views("images_v", "examples_v", ctes=CASES, body="select kind, count(*) as n, round(avg(iou), 9) as mean_iou, round(min(iou), 9) as min_iou from cases group by kind"),
)
def i2_kind(t):
    return metrics.accuracy_by_kind(_cases(t)).withColumns({c: F.round(c, 9) for c in ("mean_iou", "min_iou")})


@query(
    "I2_worst_cases",
    with_views("images_v", "examples_v", ctes=CASES, body="select case_id, kind, round(iou, 9) as iou, case when iou >= 0.93 then 'OK' when iou >= 0.85 then '~' else 'BAD' end as grade from cases order by cases.iou, case_id limit 12"),
)
def i2_worst(t):
    return metrics.worst_cases(_cases(t)).select("case_id", "kind", F.round("iou", 9).alias("iou"), metrics.grade("iou").alias("grade"))


@query("I3_fold_evaluation")
def i3(t):
    cells = locate.cell_features(_tiles(t), cell=2)
    return locate.evaluate_folds(cells, _taught(t)).select("image_id", "fold", F.round("iou", 3).alias("iou"))


@query(
    "A8_import_boxes",
    with_views("images_v", "files_v", ctes="""box as (select distinct filename as name, (length(filename) * 10)::int as l from files_v ),
img as (select filename as name, min(full_path) as full_path from files_v where filename not like '%.pdf' group by filename)""",
        body="""select name, 'receipt' as type, full_path, l * 2.0::double as l, 40 * 1.5::double as t, 400 * 2.0::double as r, 500 * 1.5::double as b from box join img using (name)
union all select name, 'receipt', null, null, null, null, null from box where name not in (select name from img)"""),
)
def a8(t):
    files = t.files()
    # one box file per listed file, as a table of its JSON objects
    raw = files.select(
        F.array(F.lit(899), F.lit(1600)).alias("image_size"), F.lit("receipt").alias("type"),
        F.create_map("filename", F.array((F.length("filename") * 10).cast("int"), F.lit(40), F.lit(400), F.lit(500))).alias("boxes"),
    )
    images = files.filter("filename not like '%.pdf'").select("full_path", F.lit(1798).alias("w"), F.lit(2400).alias("h")).distinct()
    return boxes.import_boxes(boxes.box_rows(raw).distinct(), images).select("name", "type", "full_path", "l", "t", "r", "b")
