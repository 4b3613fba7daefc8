"""Queries over feedback and operation logs."""

from pyspark.sql import functions as F

from shelf.fixtures import Tables, query, with_views
from shelf.operators import folds, logs
from shelf.operators.numbering import row_numbers
from shelf.plans import undo

STEPS = """step as (select *, row_number() over (partition by profile order by id) as k from feedback_v)"""
WALK = STEPS + """,
walked as (select * from (with recursive walk(profile, k, id, old_m, m, old_t, t) as (
  select distinct profile, 0::bigint, null::bigint, 1.0::double, 1.0::double, 10, 10 from step
  union all select s.profile, s.k, s.id, w.m,
    case s.kind when 'crop_too_tight' then least(8.0, w.m + 0.5) when 'crop_too_loose' then greatest(0.0, w.m - 0.5) else w.m end,
    w.t, case s.kind when 'similar_yes' then case when s.spread < w.t - 2 then w.t else least(20, w.t + 1) end
      when 'similar_no' then greatest(4, least(w.t - 1, greatest(4, s.spread - 2))) else w.t end
  from walk w join step s on s.profile = w.profile and s.k = w.k + 1) select * from walk)),
state as (select profile, m, t from walked qualify k = max(k) over (partition by profile))"""


def _state(t: Tables):
    """Learned values, and two more keys whose text does not always fit the type."""
    feedback = t.feedback()
    learned = logs.learned_state(feedback)
    extra = feedback.groupBy("profile").agg(F.max("spread").alias("s")).select(
        "profile",
        F.explode(F.array(
            F.struct(F.lit("crop_tolerance").alias("key"), F.when(F.col("profile") % 2 == 0, F.concat(F.col("s").cast("string"), F.lit(".0"))).otherwise(F.col("s").cast("string")).alias("value")),
            F.struct(F.lit("crop_min_gain").alias("key"), F.concat(F.col("s").cast("string"), F.lit(".5")).alias("value")),
        )).alias("e"),
    ).select("profile", "e.key", "e.value")
    return learned.unionByName(extra)


E1 = WALK + """,
top as (select profile, max(spread) as s from feedback_v group by profile),
p as (select profile, 'similarity_threshold' as key, t::double as value, 10.0::double as d, 4.0::double as low, 20.0::double as high from state
 union all select profile, 'crop_margin_pct', m, 1.0, 0.0, 8.0 from state
 union all select profile, 'crop_tolerance', case when profile % 2 = 0 then 28 else s end, 28.0, 5.0, 90.0 from top
 union all select profile, 'crop_deskew', 0.0, 0.0, 0.0, 1.0 from top
 union all select profile, 'crop_min_gain', s + 0.5, 5.0, 1.0, 30.0 from top)"""


@query("E1_effective_parameters", with_views("feedback_v", ctes=E1, body="select profile, key, value, value = d as is_default, low, high from p"))
def e1(t):
    return logs.effective_parameters(t.feedback(), _state(t))


@query(
    "E2_parameter_changes",
    with_views("feedback_v", ctes=WALK, body="""select profile, id, 'crop_margin_pct' as key, old_m as old_value, m as new_value from walked where old_m <> m
union all select profile, id, 'similarity_threshold', old_t::double, t::double from walked where old_t <> t"""),
)
def e2(t):
    return logs.parameter_changes(t.feedback())


@query("E3_margin_fold", with_views("feedback_v", ctes=WALK, body="select profile, m as value from state"))
def e3(t):
    return folds.fold(t.feedback(), ["profile"], F.lit(1.0), folds.margin_effect())


@query("E4_threshold_fold", with_views("feedback_v", ctes=WALK, body="select profile, t as value from state"))
def e4(t):
    return folds.fold(t.feedback(), ["profile"], F.lit(10), folds.threshold_effect())


@query(
    "E6_fold_with_resets",
    with_views("feedback_v", ctes=WALK.replace("from feedback_v)", "from (select * replace (case when spread = 20 and kind = 'crop_good' then 'reset' else kind end as kind) from feedback_v))")
        .replace("when 'crop_too_loose' then greatest(0.0, w.m - 0.5) else", "when 'crop_too_loose' then greatest(0.0, w.m - 0.5) when 'reset' then 1.0 else")
        .replace("greatest(4, s.spread - 2))) else", "greatest(4, s.spread - 2))) when 'reset' then 10 else"),
        body="select profile, m as margin, t as threshold from state"),
)
def e6(t):
    answers = t.feedback().withColumn(
        "kind", F.when((F.col("spread") == 20) & (F.col("kind") == "crop_good"), "reset").otherwise(F.col("kind"))
    )
    margin = folds.fold(answers, ["profile"], F.lit(1.0), folds.margin_effect()).withColumnRenamed("value", "margin")
    threshold = folds.fold(answers, ["profile"], F.lit(10), folds.threshold_effect()).withColumnRenamed("value", "threshold")
    return margin.join(threshold, "profile")


@query("E7_feedback_counts", with_views("feedback_v", body="select kind, count(*) as notes from feedback_v group by rollup (kind)"))
def e7(t):
    return logs.feedback_counts(t.feedback())


@query(
    "E8_learning_status",
    with_views("feedback_v", "examples_v", ctes=E1, body="""select profile, key, value, value <> d as learned, low, high,
(select count(*) from examples_v) as examples, (select count(*) from feedback_v f where f.profile = p.profile) as notes from p"""),
)
def e8(t):
    feedback = t.feedback()
    notes = feedback.groupBy("profile").agg(F.count("*").alias("notes"))
    return (
        logs.effective_parameters(feedback, _state(t))
        .join(notes, "profile")
        .select("profile", "key", "value", (~F.col("is_default")).alias("learned"), "low", "high",
                t.examples().agg(F.count("*")).scalar().alias("examples"), "notes")
    )


LAST = "last as (select * from log_v where run_id = (select max_by(run_id, id) from log_v))"


@query("E9_latest_run", with_views("log_v", ctes=LAST, body="select run_id, op, count(*) as operations from last group by run_id, op"))
def e9(t):
    return logs.run_summary(logs.latest_run(t.log()))


def _undo_listing(t: Tables):
    """Copies that still exist, and sources that were never moved away."""
    log = t.log()
    return (
        log.filter("status <> 'rejected'").select(F.col("destination").alias("full_path"))
        .unionByName(log.filter("status = 'rejected' or op = 'crop'").select(F.col("source").alias("full_path")))
        .distinct()
    )


THERE = LAST + """,
there as (select destination as full_path from log_v where status <> 'rejected' union select source from log_v where status = 'rejected' or op = 'crop')"""
TARGET = """case when source in (select full_path from there) then replace(source, '.jpg', ' (1).jpg') else source end"""


@query(
    "E10_undo_latest",
    with_views("log_v", ctes=THERE, body=f"""select id, action, case when action = 'restore' then {TARGET} end as target from (select *,
case when destination not in (select full_path from there) or row_number() over (partition by destination order by id) > 1 then 'gone'
 when op = 'crop' then 'delete' else 'restore' end as action from last)"""),
)
def e10(t):
    return undo.undo_latest(t.log(), _undo_listing(t)).select("id", "action", "target")


@query("E10_log_after_undo", with_views("log_v", ctes=LAST, body="select id, run_id from log_v where id not in (select id from last)"))
def e10_log(t):
    log = t.log()
    return undo.log_after(log, undo.undo_latest(log, _undo_listing(t))).select("id", "run_id")


@query(
    "E11_undo_batch",
    with_views("log_v", ctes=THERE, body=f"""select id, action, case when action = 'restore' then {TARGET} end as target from (select *,
case when destination not in (select full_path from there) or row_number() over (partition by destination order by id desc) > 1 then 'gone'
 else 'restore' end as action from last where op = 'move')"""),
)
def e11(t):
    return undo.undo_batch(t.log(), _undo_listing(t)).select("id", "action", "target")


@query("E12_pending", with_views("log_v", body="select id, op, source, destination from log_v where status = 'pending' order by id"))
def e12(t):
    return logs.pending(t.log()).select("id", "op", "source", "destination")


def _decisions(t: Tables):
    """Two reviewers: one refuses middling values, one approves high ones; they overlap."""
    events = t.table("events")
    return events.filter("value between 20 and 80").select(F.col("event_id").alias("id"), F.lit(False).alias("approve")).unionByName(
        events.filter("value > 60").select(F.col("event_id").alias("id"), F.lit(True).alias("approve"))
    )


@query(
    "E13_review_status",
    with_views("log_v", body="""select l.id, case when e.value > 60 then 'approved' when e.value between 20 and 80 then 'rejected' else l.status end as status
from log_v l join events e on e.event_id = l.id"""),
)
def e13(t):
    return logs.review_decisions(t.log(), _decisions(t))["log"].select("id", "status")


@query(
    "E13_review_feedback",
    with_views("log_v", body="""select l.id, 'crop_rejected' as kind from log_v l join events e on e.event_id = l.id where op = 'crop' and value between 20 and 80
union all select l.id, 'crop_approved' from log_v l join events e on e.event_id = l.id where op = 'crop' and value > 60"""),
)
def e13_feedback(t):
    return logs.review_decisions(t.log(), _decisions(t))["feedback"]


@query(
    "E13_removed_copies",
    with_views("log_v", body="select distinct destination from log_v l join events e on e.event_id = l.id where op = 'crop' and value between 20 and 80"),
)
def e13_removed(t):
    return logs.review_decisions(t.log(), _decisions(t))["removed"]


@query(
    "E13_removed_existing_copies",
    with_views("log_v", body="select distinct destination from log_v l join events e on e.event_id = l.id where op = 'crop' and value between 20 and 80 and event_id % 3 = 0 and destination in (select destination from log_v where id % 5 < 3)"),
)
def e13_existing(t):
    """Only copies that a listing still has can be removed."""
    listing = t.log().filter(F.col("id") % 5 < 3).select(F.col("destination").alias("full_path"))
    return logs.review_decisions(t.log(), _decisions(t).filter(F.col("id") % 3 == 0), listing)["removed"]


@query(
    "E14_state_snapshot",
    with_views("images_v", "examples_v", "log_v", body="""select (select count(*) from images_v) as images, (select count(*) from examples_v) as examples,
count(*) filter (status = 'pending') as pending, count(*) filter (status = 'approved') as approved, count(*) filter (status = 'rejected') as rejected from log_v"""),
)
def e14(t):
    return logs.state_snapshot(t.images(), t.examples(), t.log())


@query(
    "E15_review_order",
    with_views("images_v", body="""select image_id, review, row_number() over (order by review desc, coalesce(det_conf, 1), image_id) as position
from (select image_id, det_conf, det_conf is not null and (det_conf < 0.7 or w = h) as review from images_v)"""),
)
def e15(t):
    warnings = F.when(F.col("w") == F.col("h"), F.array(F.lit("tilted"), F.lit("weak_prior"))).otherwise(F.array(F.lit("tilted")))
    rows = t.images().select("image_id", "det_conf", logs.needs_review("det_conf", warnings).alias("review"))
    return row_numbers(rows, [], [F.desc("review"), F.coalesce("det_conf", F.lit(1.0)), F.col("image_id")], "position").drop("det_conf")


@query(
    "E15_approve_confident",
    with_views("images_v", body="select image_id from images_v where not (det_conf is not null and (det_conf < 0.7 or w = h))"),
)
def e15_confident(t):
    warnings = F.when(F.col("w") == F.col("h"), F.array(F.lit("weak_prior"))).otherwise(F.array(F.lit("tilted")))
    return t.images().filter(~logs.needs_review("det_conf", warnings)).select("image_id")


@query("E16_example_summary", with_views("examples_v", body="select type, img_w, img_h, count(*) as examples from examples_v group by all"))
def e16(t):
    return logs.example_summary(t.examples())


@query(
    "E17_run_log",
    with_views("files_v", body="select id, 1::bigint as runs, 12 as id_length from files_v"),
)
def e17(t):
    rows = t.files().select("id", F.lit(logs.new_run_id()).alias("run_id"))
    runs = rows.agg(F.countDistinct("run_id")).scalar()
    return rows.select("id", runs.alias("runs"), F.length("run_id").alias("id_length"))
