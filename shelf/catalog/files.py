"""Queries over file listings: scans, index, folder plans."""

from pyspark.sql import functions as F

from shelf.fixtures import Tables, query, with_views
from shelf.functions import paths as P
from shelf.functions.names import date_in_name
from shelf.operators import index as I
from shelf.operators.slots import free_destinations
from shelf.plans import folders as B
from shelf.plans import months as M
from shelf.sources import listing as L

ROOT = "/lake"


# the second path part is one of three top folders; each is the root of its own tree
def top_folder():
    return F.regexp_extract("full_path", r"^(/[^/]*/[^/]*)", 1)


def _index(t: Tables):
    """Index of all files: one row per path, with the fixture's ids."""
    return L.distinct_paths(L.index_scan(t.files(), ROOT))


EXT = r"lower(regexp_extract(filename, '(\.[^.]*)$', 1))"
DIR = r"regexp_extract(full_path, '^(.*)/[^/]*$', 1)"
TOP_SQL = r"regexp_extract(full_path, '^(/[^/]*/[^/]*)', 1)"
NATURAL = (
    r"list_transform(regexp_extract_all(lower({0}), '(\d+|\D+)'), "
    r"lambda r: {{'t': not regexp_matches(r, '^\d'), 'n': case when regexp_matches(r, '^\d') then r::hugeint else 0 end, "
    r"'s': case when regexp_matches(r, '^\d') then '' else r end}})"
)
INDEX = f"""scan as (select *, {EXT} as extension from files_v),
index_v as (select id, full_path, folder_name, filename, mtime, length, extension from scan
  where extension in ('.jpeg','.jpg','.png','.pdf') and folder_name not like '.%'
  and folder_name not in ('export_output','pdf','similar_review','auto_cropped')
  qualify row_number() over (partition by full_path order by id) = 1)"""
DATE = r"'(^|[^0-9])([0-9]{2})[-._]([0-9]{2})[-._]([0-9]{4})($|[^0-9])'"
MOVES = f"""dated as (select *, {TOP_SQL} as top,
  try_cast(regexp_extract(filename, {DATE}, 2) as int) as d, try_cast(regexp_extract(filename, {DATE}, 3) as int) as m,
  try_cast(regexp_extract(filename, {DATE}, 4) as int) as y
  from (select * from files_v qualify row_number() over (partition by full_path order by id) = 1)),
moves as (select full_path as source, filename, top || '/' || printf('%02d-%04d', m, y) as dest_dir, d, m, y, top
  from dated where d between 1 and 31 and m between 1 and 12 and full_path not like '%/.cache/%'
  and full_path not like '%/export_output/%'
  and {DIR} <> top || '/' || printf('%02d-%04d', m, y))"""


@query(
    "A1_index_scan",
    with_views("files_v", body=f"""select id, filename, folder_name, full_path, {EXT} as extension from files_v
where {EXT} in ('.jpeg','.jpg','.png','.pdf') and folder_name not like '.%'
and folder_name not in ('export_output','pdf','similar_review','auto_cropped')"""),
)
def a1(t):
    return L.index_scan(t.files(), ROOT).select("id", "filename", "folder_name", "full_path", "extension")


@query(
    "A2_image_scan",
    with_views("files_v", body=f"""select id, full_path from files_v
where {EXT} in ('.jpg','.jpeg','.png','.webp','.bmp','.tiff') and filename not like '.%'
and full_path not like '%/.%' and not regexp_matches(full_path, '/(export_output|pdf|similar_review|auto_cropped)/')"""),
)
def a2(t):
    return L.image_scan(t.files(), ROOT).select("id", "full_path")


@query(
    "A3_insert_if_absent",
    with_views("files_v", ctes=INDEX, body="""select full_path, min(id) as id from files_v
where full_path not in (select full_path from index_v where mtime < timestamp '1998-01-01') group by full_path"""),
)
def a3(t):
    known = _index(t).filter("mtime < timestamp_ntz'1998-01-01'")
    return I.insert_if_absent(known, t.files()).select("full_path", "id")


def _hash_tables(t):
    """Files with their time in seconds; a cache of the older ones, some of it outdated or gone."""
    files = L.distinct_paths(t.files()).select(
        "full_path", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', mtime)").cast("double").alias("mtime"), "length"
    )
    old = files.filter("length < 250000")
    cache = old.select(
        F.when(F.col("length") < 20000, F.concat("full_path", F.lit(".gone"))).otherwise(F.col("full_path")).alias("full_path"),
        F.when(F.col("length") > 200000, F.col("mtime") - 60).otherwise(F.col("mtime")).alias("mtime"),
        F.length("full_path").cast("long").alias("phash"),
    )
    return files.select("full_path", "mtime"), cache


HASH_TABLES = """f as (select full_path, epoch(mtime)::double as mtime, length from files_v qualify row_number() over (partition by full_path order by id) = 1),
cache as (select case when length < 20000 then full_path || '.gone' else full_path end as full_path,
  case when length > 200000 then mtime - 60 else mtime end as mtime, length(full_path)::bigint as phash from f where length < 250000)"""


@query(
    "A4_hash_refresh",
    with_views("files_v", ctes=HASH_TABLES, body="""select coalesce(f.full_path, c.full_path) as full_path,
case when f.full_path is null then 'stale' when abs(f.mtime - c.mtime) < 1e-6 then 'reuse' else 'compute' end as status
from f full join cache c on f.full_path = c.full_path"""),
)
def a4(t):
    return I.refresh_hashes(*_hash_tables(t)).select("full_path", "status")


@query(
    "A4_cache_after_refresh",
    with_views("files_v", ctes=HASH_TABLES, body="""select f.full_path, f.mtime,
case when abs(f.mtime - c.mtime) < 1e-6 then c.phash else 0 end as phash
from f left join cache c on f.full_path = c.full_path"""),
)
def a4_cache(t):
    files, cache = _hash_tables(t)
    statuses = I.refresh_hashes(files, cache)
    computed = statuses.filter("status = 'compute'").select(
        "full_path", F.col("file_mtime").alias("mtime"), F.lit(0).cast("long").alias("phash")
    )
    return I.refreshed_cache(cache, statuses, computed)


@query(
    "A5_rename_listing",
    with_views("files_v", body=f"""select id, full_path, row_number() over (order by {NATURAL.format('filename')}, full_path, id) as position
from files_v where {EXT} in ('.jpg','.jpeg','.png','.webp','.tif','.tiff','.bmp','.gif','.pdf')
qualify row_number() over (partition by full_path order by id) = 1""".replace("from files_v where", "from (select * from files_v qualify row_number() over (partition by full_path order by id) = 1) where").replace("\nqualify row_number() over (partition by full_path order by id) = 1", "")),
)
def a5(t):
    return L.rename_listing(L.distinct_paths(t.files()), ROOT, True).select("id", "full_path", "position")


@query(
    "A6_file_payload",
    with_views("files_v", body=f"""select full_path as path, filename as name, substr(full_path, 7) as rel, {EXT} as ext,
case when length < 1024 then length::varchar || ' B'
  when length < 1048576 then printf('%.1f KB', round_even(length / 1024.0::double, 1))
  else printf('%.1f MB', round_even(length / 1048576.0::double, 1)) end as size,
strftime(mtime, '%Y-%m-%d %H:%M') as mtime, {EXT} = '.pdf' as is_pdf,
{EXT} in ('.jpg','.jpeg','.png','.webp','.tif','.tiff','.bmp','.gif') as is_image from files_v"""),
)
def a6(t):
    return L.file_payload(t.files(), ROOT)


@query(
    "A9_export_selection",
    with_views("files_v", ctes=INDEX, body=r"""select folder_name || '_0' as export_name, max_by(full_path, id) as full_path, count(*) - 1 as overwritten
from index_v where extension = '.jpeg' and (filename = '0.jpeg' or regexp_full_match(filename, '[0-9]{2}-[0-9]{2}-[0-9]{4}\.jpeg')) group by 1"""),
)
def a9(t):
    return B.export_selection(_index(t))


@query(
    "A10_day_coverage",
    with_views("files_v", ctes=INDEX, body="""select m.month, m.year, d.day::int as day, printf('%02d-%02d-%d', d.day, m.month, m.year) as folder_name,
(select count(*) from index_v i where i.folder_name = printf('%02d-%02d-%d', d.day, m.month, m.year)) as files
from (select distinct month(mtime)::int as month, year(mtime)::int as year from files_v) m, (select unnest(range(1, 32)) as day) d"""),
)
def a10(t):
    months = t.files().select(F.month("mtime").alias("month"), F.year("mtime").alias("year")).distinct()
    return B.day_coverage(months, _index(t)).select("month", "year", "day", "folder_name", "files")


@query(
    "A12_path_scope",
    with_views("files_v", body="""select id, full_path like '/lake/c1/%' as inside from files_v"""),
)
def a12(t):
    winding = F.concat(P.dirname("full_path"), F.lit("/./x/../"), P.basename("full_path"))
    return t.files().select("id", P.in_scope(winding, "/lake/c1").alias("inside"))


@query(
    "A13_climb_out_of_dates",
    with_views("files_v", body=rf"""select id, regexp_replace({DIR}, '(/([0-9]{{2}}-[0-9]{{4}}|[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}))+$', '') as work_folder from files_v"""),
)
def a13(t):
    return t.files().select("id", P.climb_out_of_dates(P.dirname("full_path")).alias("work_folder"))


@query(
    "B1_date_in_name",
    with_views("files_v", body=f"""select id, case when ok then d end as day, case when ok then m end as month, case when ok then y end as year
from (select *, d between 1 and 31 and m between 1 and 12 as ok from (select id,
  try_cast(regexp_extract(filename, {DATE}, 2) as int) as d, try_cast(regexp_extract(filename, {DATE}, 3) as int) as m,
  try_cast(regexp_extract(filename, {DATE}, 4) as int) as y from files_v))"""),
)
def b1(t):
    return t.files().select("id", date_in_name("filename").alias("d")).select("id", "d.day", "d.month", "d.year")


@query("B2_month_moves", with_views("files_v", ctes=MOVES, body="select source, dest_dir from moves"))
def b2(t):
    return M.month_moves(L.distinct_paths(t.files()), top_folder()).select("source", "dest_dir")


@query(
    "B2_day_moves",
    with_views("files_v", ctes=MOVES, body=f"""select full_path as source, top || '/' || printf('%02d-%04d/%02d-%02d-%d', m, y, d, m, y) as dest_dir
from dated where d between 1 and 31 and m between 1 and 12 and full_path not like '%/.cache/%' and full_path not like '%/export_output/%'"""),
)
def b2_day(t):
    return M.month_moves(L.distinct_paths(t.files()), top_folder(), by_day=True).select("source", "dest_dir")


FREE = rf"""parts as (select source, dest_dir, regexp_extract(filename, '^(.*?)(\.[^.]*)?$', 1) as stem, regexp_extract(filename, '(\.[^.]*)$', 1) as ext from moves),
arrive as (select *, row_number() over (partition by dest_dir, stem, ext order by source) as k, count(*) over (partition by dest_dir, stem, ext) as n from parts),
have as (select distinct full_path from files_v),
slot as (select g.dest_dir, g.stem, g.ext, s, g.dest_dir || '/' || g.stem || case when s = 0 then '' else ' (' || s || ')' end || g.ext as path
  from (select distinct dest_dir, stem, ext, n from arrive) g, lateral (select unnest(range({{first}}, 2 * g.n + 2)) as s)),
free as (select dest_dir, stem, ext, path, row_number() over (partition by dest_dir, stem, ext order by s) as k from slot where path not in (select full_path from have)),
dest as (select a.source, a.dest_dir, f.path as destination, a.stem || a.ext as filename from arrive a join free f using (dest_dir, stem, ext, k))"""


@query(
    "B3_free_destination",
    with_views("files_v", ctes=MOVES + ",\n" + FREE.format(first=0), body="select source, destination from dest"),
)
def b3(t):
    files = L.distinct_paths(t.files())
    return M.month_destinations(M.month_moves(files, top_folder()), files).select("source", "destination")


@query(
    "B4_keep_both_name",
    with_views("files_v", ctes=MOVES + ",\n" + FREE.format(first=1), body="select source, destination from dest"),
)
def b4(t):
    files = L.distinct_paths(t.files())
    moves = M.month_moves(files, top_folder())
    return free_destinations(moves, files, ["source"], first_slot=1).select("source", "destination")


MANIFEST = INDEX + f""",
books as (select *, lower(filename) as low from index_v where lower(folder_name) not like 'export_output' and folder_name <> '?'),
manifest as (select *, row_number() over (partition by folder_name order by {NATURAL.format('filename')}, id) as page_no
  from books where extension in ('.jpg','.jpeg','.png','.webp','.bmp','.tiff','.pdf')
  and not (extension = '.pdf' and low in (select lower(replace(folder_name, '.', '-')) || '.pdf' from books)))"""


@query(
    "B5_page_manifest",
    with_views("files_v", ctes=MANIFEST, body="select folder_name, page_no, full_path, extension = '.pdf' as is_pdf from manifest"),
)
def b5(t):
    return B.page_manifest(_index(t)).select("folder_name", "page_no", "full_path", "is_pdf")


@query(
    "B5_book_path",
    with_views("files_v", ctes=MANIFEST, body=f"select folder_name, {DIR} || '/' || replace(folder_name, '.', '-') || '.pdf' as pdf_path from manifest where page_no = 1"),
)
def b5_path(t):
    return B.book_paths(B.page_manifest(_index(t)))


@query(
    "B6_book_summary",
    with_views("files_v", ctes=MANIFEST, body="""select b.folder_name, count(m.id) as pages, count(*) filter (m.extension = '.pdf') as pdfs,
coalesce(sum(m.length), 0)::bigint as bytes, count(m.id) = 0 as skipped
from (select distinct folder_name from books) b left join manifest m on m.folder_name = b.folder_name group by b.folder_name"""),
)
def b6(t):
    index = _index(t)
    return B.book_summary(index, B.page_manifest(index))


LINKS = rf"""first as (select folder_name, {DIR} as dir from books qualify row_number() over (partition by folder_name order by {NATURAL.format('filename')}, id) = 1),
link as (select folder_name, dir || '/' || replace(folder_name, '.', '-') || '.pdf' as pdf_path, '/lake/c0/inbox/' || replace(folder_name, '.', '-') || '.pdf' as link_path from first)"""


@query(
    "B7_link_report",
    with_views("files_v", ctes=MANIFEST + "," + LINKS, body="""select folder_name, pdf_path, link_path,
case when pdf_path in (select full_path from files_v) then 'linked' else 'missing' end as status,
pdf_path in (select full_path from files_v) and link_path in (select full_path from files_v) as replaced from link"""),
)
def b7(t):
    return B.link_report(_index(t), t.files(), "/lake/c0/inbox")


@query(
    "B8_one_click",
    with_views("files_v", ctes=MANIFEST + "," + LINKS + f""",
built as (select {DIR} || '/' || replace(folder_name, '.', '-') || '.pdf' as full_path from manifest where page_no = 1),
there as (select full_path from files_v union select full_path from built)""",
        body="""select folder_name, pdf_path, link_path,
case when pdf_path in (select full_path from there) then 'linked' else 'missing' end as status,
pdf_path in (select full_path from there) and link_path in (select full_path from there) as replaced,
(select count(*) from manifest m where m.folder_name = link.folder_name) as pages from link"""),
)
def b8(t):
    known = _index(t).filter("mtime < timestamp_ntz'1998-01-01'")
    return B.one_click(known, t.files(), ROOT, "/lake/c0/inbox")


@query(
    "B8b_month_report",
    with_views("files_v", ctes=MOVES + ",\n" + FREE.format(first=0), body="""select dest_dir, count(*) as moved,
count(*) filter (destination <> dest_dir || '/' || filename) as renamed from dest group by dest_dir"""),
)
def b8b(t):
    files = L.distinct_paths(t.files())
    return M.month_report(M.month_destinations(M.month_moves(files, top_folder()), files))


@query(
    "B9_apply_moves",
    with_views("files_v", ctes=MOVES + ",\n" + FREE.format(first=0), body="""select f.id, coalesce(d.destination, f.full_path) as full_path
from (select * from files_v qualify row_number() over (partition by full_path order by id) = 1) f left join dest d on d.source = f.full_path"""),
)
def b9(t):
    files = L.distinct_paths(t.files())
    moves = M.month_destinations(M.month_moves(files, top_folder()), files)
    return I.apply_moves(files, moves).select("id", "full_path")
