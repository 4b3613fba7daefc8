"""Queries over perceptual hashes."""

from pyspark.sql import functions as F

from shelf.fixtures import Tables, query, with_views
from shelf.functions import bits
from shelf.functions.names import natural_key
from shelf.operators import similar as S
from shelf.plans import review as R

CLOSE = 20  # the most the learned threshold may reach; the default finds nothing in these tables


def _images(t: Tables):
    path = F.concat(
        F.lit("/lake/p"), (F.col("vec_id") % 7).cast("string"), F.lit("/img_"),
        (F.col("vec_id") % 50).cast("string"), F.lit("_"), F.col("vec_id").cast("string"), F.lit(".jpg"),
    )
    return t.hashes().select("vec_id", path.alias("full_path"), "h")


PAIRS = """img as (select vec_id, b, '/lake/p' || (vec_id % 7) || '/img_' || (vec_id % 50) || '_' || vec_id || '.jpg' as full_path from bits_v),
pair as (select * from (select x.vec_id as a, y.vec_id as b, x.full_path as pa, y.full_path as pb,
  list_sum(list_transform(list_zip(x.b, y.b), lambda z: case when z[1] <> z[2] then 1 else 0 end))::int as distance
  from img x join img y on x.vec_id < y.vec_id) where distance <= 20)"""


@query(
    "D1b_median_hash",
    with_views("bits_v", body="select vec_id, array_to_string(list_transform(b, lambda x: case when x then '1' else '0' end), '') as bits from bits_v"),
)
def d1b(t):
    return t.hashes().select("vec_id", F.reverse(F.lpad(F.bin("h"), 64, "0")).alias("bits"))


@query(
    "D2_hash_from_hex",
    """select page_id, hex, case when u >= 9223372036854775808 then (u::hugeint - 18446744073709551616)::bigint else u::bigint end as h,
bit_count(u)::int as bits from (select page_id, substr(md5(url), 1, 16) as hex, ('0x' || substr(md5(url), 1, 16))::ubigint as u from pages)""",
)
def d2(t):
    pages = t.table("pages").select("page_id", F.substring(F.md5("url"), 1, 16).alias("hex"))
    return pages.select(
        "page_id", bits.hash_to_hex(bits.hash_from_hex("hex")).alias("hex"),
        bits.hash_from_hex("hex").alias("h"), bits.distance(bits.hash_from_hex("hex"), F.expr("0L")).alias("bits"),
    )


@query("D3_similar_pairs", with_views("bits_v", ctes=PAIRS, body="select a, b, distance from pair"))
def d3(t):
    return S.image_pairs(_images(t), CLOSE, "vec_id")


@query(
    "D4_components",
    with_views("bits_v", ctes=PAIRS, body="""select * from (with recursive edge as (select a, b from pair union all select b, a from pair),
reach(node, other) as (select vec_id, vec_id from img union select r.node, e.b from reach r join edge e on e.a = r.other)
select node as vec_id, min(other) as component from reach group by node)"""),
)
def d4(t):
    images = _images(t)
    hashes = S.distinct_hashes(images, "vec_id")
    placed = images.join(S.components(hashes, S.linked(hashes.select("h"), CLOSE)), "h")
    lowest = placed.groupBy("component").agg(F.min("vec_id").alias("lowest"))
    return placed.join(lowest, "component").select("vec_id", F.col("lowest").alias("component"))


_FITS = "list_position(list_transform(acc.cl, lambda c: len(list_filter(c, lambda m: bit_count(xor(m, e.h)) > 20)) = 0), true)"
GROUPS = f"""img as (select vec_id, list_sum(list_transform(b, lambda x, i: case when x then pow(2::double, i - 1)::hugeint else 0::hugeint end))::ubigint as h,
  '/lake/p' || (vec_id % 7) || '/img_' || (vec_id % 50) || '_' || vec_id || '.jpg' as full_path from bits_v),
hash as (select h, min(full_path) as first, count(*) as copies from img group by h),
folded as (select list_reduce(list({{'h': h, 'cl': []::ubigint[][]}} order by first), lambda acc, e: {{'h': e.h, 'cl': case when {_FITS} is null then list_append(acc.cl, [e.h])
  else list_transform(acc.cl, lambda c, i: case when i = {_FITS} then list_append(c, e.h) else c end) end}}, {{'h': 0::ubigint, 'cl': []::ubigint[][]}}) as acc from hash),
member as (select unnest(m) as h, c from (select unnest(acc.cl) as m, generate_subscripts(acc.cl, 1) as c from folded)),
big as (select c, min(first) as first from member join hash using (h) group by c having sum(copies) > 1),
apart as (select a.c, max(bit_count(xor(a.h, b.h)))::int as spread from member a join member b using (c) group by a.c),
groups as (select row_number() over (order by first) as group_no, c, spread from big join apart using (c)),
grouped as (select group_no, full_path, spread from img join member using (h) join groups using (c)),
moves as (select group_no, spread, full_path as source, '/lake/similar_review/group_' || case when k < 10 then '0' else '' end || k as dest_dir
  from (select *, group_no + (select max(p_size) from part) as k from grouped))"""


@query("D5_similar_groups", with_views("bits_v", ctes=GROUPS, body="select group_no, full_path, spread from grouped"))
def d5(t):
    return S.similar_groups(_images(t), CLOSE).select("group_no", "full_path", "spread")


NAT = r"""list_transform(regexp_extract_all(lower({0}), '(\d+|\D+)'), lambda r: {{'t': not regexp_matches(r, '^\d'),
  'n': case when regexp_matches(r, '^\d') then r::hugeint else 0 end, 's': case when regexp_matches(r, '^\d') then '' else r end}})"""


@query(
    "D6_nearest_duplicate",
    with_views("bits_v", ctes=PAIRS, body=f"""select full_path, other, distance from (
  select pa as full_path, pb as other, distance from pair union all select pb, pa, distance from pair)
qualify row_number() over (partition by full_path order by distance, {NAT.format('other')}) = 1"""),
)
def d6(t):
    return S.nearest_duplicate(_images(t), CLOSE, [natural_key("full_path")])


def _review_listing(t: Tables):
    """The images, and some already sorted into review folders."""
    images = _images(t).select("full_path")
    done = t.table("part").select(
        F.concat(F.lit("/lake/similar_review/group_"), F.col("p_size").cast("string"), F.lit("/x.jpg")).alias("full_path")
    )
    return images.unionByName(done)


@query("D7_review_moves", with_views("bits_v", ctes=GROUPS, body="select group_no, source, dest_dir || '/' || regexp_extract(source, '[^/]*$') as destination from moves"))
def d7(t):
    groups = S.similar_groups(_images(t), CLOSE)
    return R.review_moves(groups, _review_listing(t), "/lake/similar_review").select("group_no", "source", "destination")


@query("D8_selected_groups", with_views("bits_v", ctes=GROUPS, body="select group_no, full_path, spread from grouped where group_no in (1, 3, 4, 5)"))
def d8(t):
    return R.select_groups(S.similar_groups(_images(t), CLOSE), "1,3-5").select("group_no", "full_path", "spread")


@query("D9_similarity_report", with_views("bits_v", ctes=GROUPS, body="select group_no, spread, dest_dir, count(*) as images, min(source) as first from moves group by all"))
def d9(t):
    return R.similarity_report(_images(t), _review_listing(t), CLOSE, "/lake/similar_review")
