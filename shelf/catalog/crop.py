"""Queries over crop decisions."""

from pyspark.sql import functions as F

from shelf.fixtures import Tables, query, with_views
from shelf.functions import geometry as G
from shelf.operators import crop as C

SIDES = "ltrb"


def _text(box):
    return F.concat_ws(",", *[box[s].cast("string") for s in SIDES])


def _detected(t: Tables):
    """Photos with their detection and, for some, the model's prediction."""
    events = t.table("events").select(F.col("event_id").alias("image_id"), "value")
    images = t.images().join(events, "image_id")
    w, h = F.col("w"), F.col("h")
    box = G.box(F.col("det_l") * w, F.col("det_t") * h, F.col("det_r") * w, F.col("det_b") * h)
    flags = F.array(
        F.when(F.col("det_conf").isNull(), "nothing_found"),
        F.when(F.col("det_conf") < 0.7, "low_confidence"),
        F.when(F.col("det_conf") > 0.97, "full_frame"),
        F.when(F.abs("angle") > 1.5, "tilted"),
    )
    predicted = F.col("value") > 100
    v = F.col("value")
    return images.select(
        "image_id", F.concat(F.lit("/lake/in/"), (F.col("image_id") % 900).cast("string"), F.lit(".jpg")).alias("full_path"),
        "w", "h", F.when(F.col("det_conf").isNotNull(), G.box_quad(box)).alias("quad"), "det_conf", "angle",
        F.array_compact(flags).alias("warnings"),
        F.when(predicted, G.box(v / 10000, v / 8000, 1 - v / 9000, 1 - v / 7000)).alias("pred_box"),
        F.when(predicted, F.least(F.lit(1.0), v / 250)).alias("pred_conf"),
    )


def _plans(t: Tables, offsets=True):
    examples = t.examples()
    images = _detected(t)
    priors = C.taught_priors(_agreeing(examples), images)
    learned = C.learned_offsets(examples) if offsets else None
    return C.plan_sizes(C.plan_crops(images, priors, learned, margin_pct=1.5, deskew=True, taught_type="invoice"))


def _agreeing(examples):
    """All examples; those of square photos agree closely, so their prior is strong and the others stay weak."""
    square = F.col("img_w") == F.col("img_h")
    fixed = {"l": 0.12, "t": 0.15, "r": 0.9, "b": 0.88}
    return examples.withColumns(
        {f"box_{s}": F.when(square, F.lit(v)).otherwise(F.col(f"box_{s}")) for s, v in fixed.items()}
    )


PRIOR = """shape as (select distinct w, h from images_v),
near as (select s.w, s.h, e.* from shape s join {examples} e on (s.w >= s.h) = (e.img_w >= e.img_h)
  and abs(ln((s.w / s.h) / (e.img_w / e.img_h))) < 0.03 where low_quality = 0),
kinds as (select w, h, type, count(*) as n from near group by w, h, type),
prior as (select w, h, round_even(avg(box_l) * w, 0)::int as pl, round_even(avg(box_t) * h, 0)::int as pt, round_even(avg(box_r) * w, 0)::int as pr,
  round_even(avg(box_b) * h, 0)::int as pb, count(*) as n,
  case when count(*) > 1 then greatest(stddev_pop(box_l), stddev_pop(box_t), stddev_pop(box_r), stddev_pop(box_b)) else 1.0 end as spread,
  (select k.type from kinds k where k.w = near.w and k.h = near.h order by k.n desc, k.type limit 1) as type from near group by w, h)"""

OFFSETS = """offs as (select least(0.10, greatest(-0.06, median((det_l - box_l) * img_w / least(img_w, img_h)))) as ol,
  least(0.10, greatest(-0.06, median((det_t - box_t) * img_h / least(img_w, img_h)))) as ot,
  least(0.10, greatest(-0.06, median((box_r - det_r) * img_w / least(img_w, img_h)))) as orr,
  least(0.10, greatest(-0.06, median((box_b - det_b) * img_h / least(img_w, img_h)))) as ob
  from examples_v where low_quality = 0 and det_conf >= 0.7)"""

PLAN = """agree as (select * replace (case when img_w = img_h then 0.12 else box_l end as box_l, case when img_w = img_h then 0.15 else box_t end as box_t,
  case when img_w = img_h then 0.9 else box_r end as box_r, case when img_w = img_h then 0.88 else box_b end as box_b)
  from examples_v),
""" + PRIOR.format(examples="agree") + ",\n" + OFFSETS + """,
i as (select *, least(w, h) as side, det_conf is not null as found, coalesce(det_conf, 0) as c,
  det_l * w as ql, det_t * h as qt, det_r * w as qr, det_b * h as qb,
  list_filter([case when det_conf is null then 'nothing_found' end, case when det_conf < 0.7 then 'low_confidence' end,
    case when det_conf > 0.97 then 'full_frame' end, case when abs(angle) > 1.5 then 'tilted' end], lambda x: x is not null) as warn,
  case when value > 100 then least(1.0, value / 250) end as pc
  from images_v join (select event_id as image_id, value from events) using (image_id)),
b as (select *, greatest(0, floor(ql))::int as bl, greatest(0, floor(qt))::int as bt, least(w, ceil(qr))::int as br, least(h, ceil(qb))::int as bb from i),
p as (select b.*, pl, pt, pr, pb, n, spread, type as ptype, coalesce(n >= 3 and spread < 0.012, false) as strong, n is not null as has_prior,
  ol * side as ml, ot * side as mt, orr * side as mr, ob * side as mb,
  greatest(0, least(br, pr) - greatest(bl, pl))::double * greatest(0, least(bb, pb) - greatest(bt, pt)) as inter
  from b left join prior using (w, h) cross join offs),
q as (select *, coalesce(strong and found and c >= 0.75 and inter / ((pr - pl) * (pb - pt) + (br - bl) * (bb - bt) - inter) < 0.7, false) as dis from p),
way as (select *, case when pc is not null and (pc >= 0.6 or c < 0.7) then 'learned' when strong and not dis then 'taught'
  when has_prior and not strong and (not found or c < 0.3) then 'prior' when not found or c < 0.3 then 'none' else 'calibrated' end as method from q),
turn as (select *, method = 'calibrated' and abs(angle) >= 0.7 and not list_contains(warn, 'full_frame') as deskewed,
  coalesce(list_filter(range(0, 7), lambda k: ql - ml * pow(0.5, k) >= -1 and qt - mt * pow(0.5, k) >= -1 and qr + mr * pow(0.5, k) <= w + 1 and qb + mb * pow(0.5, k) <= h + 1)[1], 99) as k from way),
grown as (select *, case when k = 99 then 0 else pow(0.5, k) end as f from turn),
boxed as (select *, case method when 'learned' then round_even(value / 10000 * w, 0)::int when 'taught' then pl when 'prior' then pl
    when 'calibrated' then case when deskewed then greatest(0, floor(ql - ml * f))::int else trunc(greatest(0, bl - ml))::int end end as l,
  case method when 'learned' then round_even(value / 8000 * h, 0)::int when 'taught' then pt when 'prior' then pt
    when 'calibrated' then case when deskewed then greatest(0, floor(qt - mt * f))::int else trunc(greatest(0, bt - mt))::int end end as t,
  case method when 'learned' then round_even((1 - value / 9000) * w, 0)::int when 'taught' then pr when 'prior' then pr
    when 'calibrated' then case when deskewed then least(w, ceil(qr + mr * f))::int else trunc(least(w, br + mr))::int end end as r,
  case method when 'learned' then round_even((1 - value / 7000) * h, 0)::int when 'taught' then pb when 'prior' then pb
    when 'calibrated' then case when deskewed then least(h, ceil(qb + mb * f))::int else trunc(least(h, bb + mb))::int end end as b from grown),
plan as (select *, case method when 'learned' then pc when 'taught' then 0.9 when 'prior' then 0.45 else c end as conf,
  case method when 'learned' then 'invoice' when 'taught' then ptype when 'prior' then ptype end as kind,
  case method when 'learned' then list_filter([case when pc < 0.7 then 'low_confidence' end, case when l <= 0 or t <= 0 or r >= w or b >= h then 'touches_edge' end], lambda x: x is not null)
    when 'taught' then list_filter(warn, lambda x: x not in ('low_confidence', 'nothing_found'))
    when 'prior' then list_concat(list_filter(warn, lambda x: x <> 'nothing_found'), ['weak_prior'])
    else case when dis then list_concat(warn, ['prior_disagree']) else warn end end as warnings,
  case when l is null then case when not found then 'لم يُعثر على ورقة' else 'ثقة منخفضة — راجع القص' end end as reason,
  case when deskewed then round_even(qr - ql + (ml + mr) * f, 0)::int else r - l end as ow,
  case when deskewed then round_even(qb - qt + (mt + mb) * f, 0)::int else b - t end as oh from boxed),
sized as (select *, case when ow is null then 0.0 else greatest(0.0, (1 - (ow::bigint * oh) / (w::bigint * h)) * 100) end as gain,
  conf < 0.7 or list_contains(warnings, 'weak_prior') or list_contains(warnings, 'prior_disagree') as needs_review from plan),
result as (select *, case when l is null or gain < 5 then 'skipped' else 'pending' end as status from sized)"""
VIEWS = ("images_v", "examples_v")


@query(
    "F1_latest_examples",
    with_views(*VIEWS, body="select source_path, max(id) as id from examples_v where low_quality = 0 group by source_path"),
)
def f1(t):
    listing = t.images().select(F.concat(F.lit("/lake/in/"), (F.col("image_id") % 700).cast("string"), F.lit(".jpg")).alias("full_path"))
    return C.latest_examples(t.examples(), listing).select("source_path", "id")


@query(
    "F2_taught_prior",
    with_views(*VIEWS, ctes=PRIOR.format(examples="examples_v"), body="""select w, h, pl || ',' || pt || ',' || pr || ',' || pb as box, n, round(spread, 6) as spread,
n >= 3 and spread < 0.012 as strong, type from prior"""),
)
def f2(t):
    priors = C.taught_priors(t.examples(), t.images())
    return priors.select("w", "h", _text(F.col("box")).alias("box"), "n", F.round("spread", 6).alias("spread"), "strong", "type")


@query(
    "F3_learned_offsets",
    with_views(*VIEWS, ctes=OFFSETS, body="select round(ol, 9) as l, round(ot, 9) as t, round(orr, 9) as r, round(ob, 9) as b from offs"),
)
def f3(t):
    examples = t.examples()
    found = C.learned_offsets(examples)
    # the medians as one row beside the table they come from
    return examples.agg(F.count("*")).select(*[F.round(F.lit(found[s]), 9).alias(s) for s in SIDES])


@query(
    "F4_box_iou",
    with_views(*VIEWS, body="""select id, round(case when det_l is null then 0 else greatest(0, least(det_r, box_r) - greatest(det_l, box_l)) * greatest(0, least(det_b, box_b) - greatest(det_t, box_t))
/ ((det_r - det_l) * (det_b - det_t) + (box_r - box_l) * (box_b - box_t) - greatest(0, least(det_r, box_r) - greatest(det_l, box_l)) * greatest(0, least(det_b, box_b) - greatest(det_t, box_t))) end, 9) as iou from examples_v"""),
)
def f4(t):
    a = G.box(*[F.col(f"det_{s}") for s in SIDES])
    b = G.box(*[F.col(f"box_{s}") for s in SIDES])
    return t.examples().select("id", F.round(F.coalesce(G.iou(a, b), F.lit(0.0)), 9).alias("iou"))


@query(
    "F5_quad_bounds",
    with_views("images_v", body="""select image_id, greatest(0, floor(det_l * w - 3))::int as l, greatest(0, floor(det_t * h - 5))::int as t,
least(w, ceil(det_r * w + 7))::int as r, least(h, ceil(det_b * h + 9))::int as b from images_v where det_conf is not null"""),
)
def f5(t):
    found = _detected(t).filter("quad is not null")
    grown = G.expand_quad(F.col("quad"), *[F.lit(float(m)) for m in (3, 5, 7, 9)])
    return found.withColumn("b", G.quad_bounds(grown, F.col("w"), F.col("h"))).select("image_id", "b.*")


@query(
    "F6_fit_inside",
    with_views("images_v", body="""select image_id, round(ql - 60 * f, 6) as l, round(qt - 80 * f, 6) as t, round(qr + 300 * f, 6) as r, round(qb + 90 * f, 6) as b from (select *, case when k is null then 0 else pow(0.5, k) end as f from (select *,
list_filter(range(0, 7), lambda k: ql - 60 * pow(0.5, k) >= -1 and qt - 80 * pow(0.5, k) >= -1 and qr + 300 * pow(0.5, k) <= w + 1 and qb + 90 * pow(0.5, k) <= h + 1)[1] as k
from (select *, det_l * w as ql, det_t * h as qt, det_r * w as qr, det_b * h as qb from images_v where det_conf is not null)))"""),
)
def f6(t):
    found = _detected(t).filter("quad is not null")
    margins = G.box(*[F.lit(float(m)) for m in (60, 80, 300, 90)])
    q = G.fit_inside(F.col("quad"), F.col("w"), F.col("h"), margins)
    return found.withColumn("q", q).select(
        "image_id", F.round(F.col("q")[0]["x"], 6).alias("l"), F.round(F.col("q")[0]["y"], 6).alias("t"),
        F.round(F.col("q")[2]["x"], 6).alias("r"), F.round(F.col("q")[2]["y"], 6).alias("b"),
    )


@query(
    "F7_crop_plan",
    with_views(*VIEWS, ctes=PLAN, body="select image_id, l, t, r, b, method, deskewed, round(conf, 9) as conf, kind as type, array_to_string(warnings, ',') as warnings, reason from result"),
)
def f7(t):
    return _plans(t).select(
        "image_id", "box.*", "method", "deskewed", F.round("conf", 9).alias("conf"), "type",
        F.array_join("plan_warnings", ",").alias("warnings"), "reason",
    )


@query(
    "F8_plan_sizes",
    with_views(*VIEWS, ctes=PLAN, body="select image_id, ow as out_w, oh as out_h, round(gain, 6) as gain, needs_review from result"),
)
def f8(t):
    return _plans(t).select(
        "image_id", F.col("out_size.w").alias("out_w"), F.col("out_size.h").alias("out_h"), F.round("gain", 6).alias("gain"), "needs_review"
    )


@query(
    "F9_detail_roundtrip",
    with_views(*VIEWS, ctes=PLAN, body="select image_id, method, coalesce(kind, 'unknown') as type, round(conf, 3) as conf, array_to_string(warnings, ',') as warnings, deskewed as deskew, l || ',' || t || ',' || r || ',' || b as box from result"),
)
def f9(t):
    plans = _plans(t)
    d = plans.select("image_id", C.parse_detail(C.detail_json()).alias("d"))
    return d.select(
        "image_id", "d.method", "d.type", F.round("d.conf", 3).alias("conf"), F.array_join("d.warnings", ",").alias("warnings"),
        "d.deskew", F.array_join(F.col("d.box").cast("array<string>"), ",").alias("box"),
    )


@query(
    "F9_legacy_details",
    with_views("log_v", body="select id, 'legacy' as method, 'similar group ' || run_id as note, 0 as warnings, null::double as conf from log_v"),
)
def f9_legacy(t):
    d = t.log().select("id", C.parse_detail(F.concat(F.lit("similar group "), "run_id")).alias("d"))
    return d.select("id", "d.method", "d.note", F.size("d.warnings").alias("warnings"), "d.conf")


@query(
    "F10_crop_results",
    with_views(*VIEWS, ctes=PLAN, body="""select image_id, status, case when l is null then reason when gain < 5 then 'لا حاجة للقص (يوفّر ' || printf('%.1f', round_even(gain, 1)) || '% فقط)' end as skip_reason from result"""),
)
def f10(t):
    return C.crop_results(_plans(t)).select("image_id", "status", "skip_reason")


@query(
    "F10_crop_counts",
    with_views(*VIEWS, ctes=PLAN, body="select status, count(*) as images, count(*) filter (needs_review) as to_review from result group by status"),
)
def f10_counts(t):
    return C.result_counts(C.crop_results(_plans(t)))


@query(
    "F10_crop_log",
    with_views(*VIEWS, ctes=PLAN, body="""select source, destination from (select source, '/lake/auto_cropped/in/' || stem || case when k = 1 then '' else ' (' || (k - 1) || ')' end || '.jpg' as destination
from (select '/lake/in/' || (image_id % 900) || '.jpg' as source, (image_id % 900)::varchar as stem, row_number() over (partition by image_id % 900 order by image_id) as k from result where status = 'pending'))"""),
)
def f10_log(t):
    listing = _detected(t).select("full_path").distinct()
    log = C.crop_log(C.crop_results(_plans(t)), listing, "/lake", "/lake/auto_cropped", "run")
    return log.select("source", "destination")


@query(
    "F11_review_report",
    with_views(*VIEWS, ctes=PLAN, body="""select image_id, row_number() over (order by needs_review desc, conf, image_id) as position,
replace(replace(replace(replace(replace(replace(array_to_string(warnings, '|'), 'low_confidence', 'ثقة منخفضة — راجع القص'), 'full_frame', 'الورقة تملأ الصورة (لا حاجة للقص)'),
 'touches_edge', 'الورقة قريبة من حافة الصورة / قد تكون مقطوعة'), 'tilted', 'الورقة مائلة'), 'weak_prior', 'اعتمد على مثال معلَّم فقط (لم تُكشف الورقة)'), 'prior_disagree', 'القص المعلَّم يخالف الكشف التلقائي') as labels
from result where status = 'pending'"""),
)
def f11(t):
    return C.review_report(C.crop_results(_plans(t))).select("image_id", "position", F.array_join("labels", "|").alias("labels"))


@query(
    "F12_save_example",
    with_views(*VIEWS, body="""select image_id, type, l / w as box_l, t / h as box_t, greatest(l + 1, least(w, round_even(w * 1.1::double - value * 9, 0)::int)) / w as box_r,
greatest(t + 1, least(h, round_even(h - value / 2, 0)::int)) / h as box_b from (select *, greatest(0, least(w - 1, round_even(value * 3 - 20, 0)::int)) as l,
greatest(0, least(h - 1, round_even(value - 40, 0)::int)) as t, case when event_type in ('click', 'view') then 'receipt' else 'other' end as type
from images_v join (select event_id as image_id, value, event_type from events) using (image_id))"""),
)
def f12(t):
    v = F.col("value")
    events = t.table("events").select(F.col("event_id").alias("image_id"), "value", "event_type")
    drawn = t.images().join(events, "image_id").select(
        "image_id", F.lit("/lake/in/x.jpg").alias("source_path"), F.col("w").alias("img_w"), F.col("h").alias("img_h"),
        F.when(F.col("event_type").isin("click", "view"), "receipt").otherwise(F.col("event_type")).alias("type"),
        (v * 3 - 20).alias("l"), (v - 40).alias("t"), (F.col("w") * 1.1 - v * 9).alias("r"), (F.col("h") - v / 2).alias("b"),
        *[f"det_{s}" for s in SIDES], "det_conf",
    )
    return C.save_example(drawn).select("image_id", "type", *[f"box_{s}" for s in SIDES])


@query(
    "F13_box_or_reason",
    with_views(*VIEWS, ctes=PLAN, body="select image_id, l || ',' || t || ',' || r || ',' || b as box, case when l is null then reason else method end as method, case when l is not null then kind end as type from result"),
)
def f13(t):
    found = C.box_or_reason(_plans(t))
    return found.select("image_id", F.when(F.col("box").isNotNull(), _text(F.col("box"))).alias("box"), "method", "type")
