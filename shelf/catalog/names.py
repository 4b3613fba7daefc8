"""Queries over names, templates, batch renames and metadata."""

from pyspark.sql import functions as F

from shelf.catalog.files import DIR, NATURAL
from shelf.catalog.similar import NAT, PAIRS, _images, CLOSE
from shelf.fixtures import Tables, query, with_views
from shelf.functions import metadata as meta
from shelf.functions import paths as P
from shelf.functions.names import human_size, natural_key
from shelf.functions.templates import Rename, exif_date, renamed
from shelf.operators.similar import nearest_duplicate
from shelf.plans import rename as R
from shelf.sources import listing as L

ONCE = "f as (select * from files_v qualify row_number() over (partition by full_path order by id) = 1)"
STEM = r"regexp_extract(filename, '^(.*?)(\.[^.]*)?$', 1)"
SUFFIX = r"regexp_extract(filename, '(\.[^.]*)$', 1)"


def _files(t: Tables):
    return L.distinct_paths(t.files())


def _renames(t: Tables, settings: Rename, **more):
    rows = t.files().withColumn("r", renamed(settings, **more))
    return rows.select("id", "r.new_path", "r.err")


@query(
    "C1_path_parts",
    r"""select page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) as dirname, regexp_extract(url, '([^/]*)$', 1) as basename,
regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^\.*[^.].*?(\.[^.]*)$', 1) as ext from pages""",
)
def c1(t):
    name = P.basename("url")
    return t.table("pages").select(
        "page_id", P.dirname("url").alias("dirname"), name.alias("basename"), P.extension(name).alias("ext")
    )


@query("C1_stem_of_names", with_views("files_v", body=f"select id, {STEM} as stem, {SUFFIX} as ext from files_v"))
def c1_stem(t):
    return t.files().select("id", P.stem("filename").alias("stem"), P.extension("filename").alias("ext"))


@query(
    "C2_natural_order",
    with_views("files_v", ctes=ONCE, body=f"select id, row_number() over (partition by folder_name order by {NATURAL.format('filename')}, id) as place from f"),
)
def c2(t):
    from shelf.operators.numbering import row_numbers

    keyed = _files(t).withColumn("natural", natural_key("filename"))
    return row_numbers(keyed, ["folder_name"], ["natural", "id"], "place").select("id", "place")


@query(
    "C3_human_size",
    """select o_orderkey as id, case when n < 1024 then n::bigint::varchar || ' B' when n < 1048576 then printf('%.1f KB', round_even(n / 1024, 1))
when n < 1073741824 then printf('%.1f MB', round_even(n / 1048576, 1)) else printf('%.1f GB', round_even(n / 1073741824, 1)) end as size
from (select o_orderkey, floor(o_totalprice * o_totalprice / case o_orderkey % 3 when 0 then 1 when 1 then 1000 else 100000000 end)::double as n from orders)""",
)
def c3(t):
    n = F.floor(
        F.col("o_totalprice") * F.col("o_totalprice")
        / F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 1000).otherwise(100000000)
    )
    return t.table("orders").select(F.col("o_orderkey").alias("id"), human_size(n).alias("size"))


@query(
    "C4_template",
    with_views("files_v", body=f"select id, {DIR} || '/doc-' || strftime(mtime, '%m-%Y') || '_' || {STEM} || '_doc xxl' || {SUFFIX} as new_path, null::varchar as err from files_v"),
)
def c4(t):
    return _renames(t, Rename(template="xx-{mtime:%m-%Y}_{orig}_{XX} xxl", typed="doc"))


@query(
    "C5_name_rules",
    with_views("files_v", body=f"""select id, case when {STEM} = '0' then null else {DIR} || '/a_b__' || {STEM} || {SUFFIX} end as new_path,
case when {STEM} = '0' then 'The new name is empty' end as err from files_v"""),
)
def c5(t):
    # a bare number leaves nothing behind; the typed name carries bad signs and a second extension
    typed = F.when(P.stem("filename") == "0", F.lit(" . ")).otherwise(F.concat(F.lit(" a:b?*"), "filename", F.lit(". ")))
    return _renames(t, Rename(template="xx", typed=typed))


@query(
    "C6_regex",
    with_views("files_v", body=rf"select id, case when n = filename then null else {DIR} || '/' || n end as new_path, null::varchar as err from (select *, regexp_replace({STEM}, '(?i)img_([0-9]+)_([0-9]+)', '\2$\1', 'g') || {SUFFIX} as n from files_v)"),
)
def c6(t):
    return _renames(t, Rename(template="{orig}", find=r"img_(\d+)_(?P<month>\d+)", replace=r"\g<month>$\1", ignore_case=True))


@query(
    "C7_extension_change",
    with_views("files_v", body=f"select id, case when {SUFFIX} = '.jpeg' then null else {DIR} || '/' || {STEM} || '.jpeg' end as new_path, null::varchar as err from files_v"),
)
def c7(t):
    return _renames(t, Rename(extension="jpeg"))


def _dates(t: Tables):
    """Capture dates of some events, change dates of others, unreadable or no text for the rest."""
    stamp = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    kind = F.col("event_type")
    return t.table("events").select(
        F.concat(F.lit("/lake/in/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("full_path"),
        F.col("ts").alias("mtime"),
        F.when(kind == "click", stamp).when(kind == "view", F.lit(" ")).alias("taken"),
        F.when(kind.isin("view", "error"), F.concat(stamp, F.lit(" "))).when(kind == "signup", F.lit("yesterday")).alias("changed"),
    )


@query(
    "C8_exif_date",
    """select '/lake/in/' || event_id || '.jpg' as full_path, case when event_type in ('click', 'view', 'error') then '/lake/in/' || strftime(ts, '%Y%m%d') || '-' || event_id || '.jpg' end as new_path,
case when event_type not in ('click', 'view', 'error') then 'no EXIF date' end as err from events""",
)
def c8(t):
    rows = _dates(t).withColumn("r", renamed(Rename(template="{exif_date:%Y%m%d}-{orig}"), taken_at=exif_date("taken", "changed")))
    return rows.select("full_path", "r.new_path", "r.err")


def _numbered_files(t: Tables):
    """Dated files plus invoices that carry a number already, in the same folders."""
    files = _files(t).select("full_path", "mtime")
    done = files.filter("full_path like '%/scan_%'").select(
        F.concat(P.dirname("full_path"), F.lit("/Fatura-"), F.regexp_extract("full_path", r"scan_(\d+)", 1), F.lit(".pdf")).alias("full_path"),
        "mtime",
    )
    return L.first_per(files.unionByName(done), ["full_path"], ["mtime"])


NUMBERED = ONCE + f""",
g as (select full_path, min(mtime) as mtime from (select full_path, mtime from f union all
  select {DIR} || '/Fatura-' || regexp_extract(full_path, 'scan_([0-9]+)', 1) || '.pdf', mtime from f where full_path like '%/scan_%') group by full_path),
n as (select *, regexp_extract(full_path, '([^/]*)$', 1) as filename from g),
ordered as (select *, row_number() over (order by {NATURAL.format('filename')}, full_path) as position from n),
split as (select *, {DIR} as dir, {STEM} as stem, {SUFFIX} as ext from ordered)"""


@query(
    "C9_invoice_numbers",
    with_views("files_v", ctes=NUMBERED + """,
event as (select *, try_cast(regexp_extract(stem, '^Fatura-([0-9]+)$', 1) as bigint) as own,
  (select max(try_cast(regexp_extract(x.stem, '^Fatura-([0-9]+)$', 1) as bigint)) from split x where x.dir = split.dir) as high from split),
turn as (select *, coalesce(sum(case when own is null then 1 else 0 end) over (order by position rows between unbounded preceding and 1 preceding), 0) as j from event),
given as (select *, j + 1 + greatest(0, max(case when own is null then coalesce(high, 0) - j else own - j end) over (order by position)) as k from turn)""",
        body="select position, full_path, dir || '/' || case when own is null then 'Fatura-' || k else stem end || ext as new_path from given"),
)
def c9(t):
    plan = R.rename_plan(_numbered_files(t), Rename(template="xx", typed="Fatura"), invoice=True)
    # a kept name is the file's own path and reported as unchanged
    return plan.select("position", "full_path", "new_path")


@query(
    "C10_batch_plan",
    with_views("files_v", ctes=NUMBERED.replace("/Fatura-", "/Page-"), body="""select position, full_path, new_path, new_path in (select full_path from g) as conflict
from (select position, full_path, dir || '/Page-' || (position + 6) || ext as new_path from split)"""),
)
def c10(t):
    files = _numbered_files(t)
    files = files.withColumn("full_path", F.replace("full_path", F.lit("/Fatura-"), F.lit("/Page-")))
    return R.rename_plan(files, Rename(template="Page-{n}"), start=7).select("position", "full_path", "new_path", "conflict")


@query(
    "C10_duplicate_names",
    with_views("files_v", ctes=ONCE + f""",
o as (select *, row_number() over (order by {NATURAL.format('filename')}, full_path) as position from f),
p as (select position, full_path, {DIR} || '/' || strftime(mtime, '%Y-%m') || {SUFFIX} as new_path from o)""",
        body="select position, full_path, new_path, row_number() over (partition by new_path order by position) > 1 as conflict from p"),
)
def c10_duplicates(t):
    return R.rename_plan(_files(t), Rename(template="{mtime:%Y-%m}")).select("position", "full_path", "new_path", "conflict")


COMMIT = ONCE + f""",
o as (select *, row_number() over (order by {NATURAL.format('filename')}, full_path) as position from f),
p as (select position, full_path, {DIR} || '/' || strftime(mtime, '%Y-%m') as base, {SUFFIX} as ext from o),
q as (select *, row_number() over (partition by base, ext order by position) as k from p)"""


@query(
    "C11_batch_commit",
    with_views("files_v", ctes=COMMIT, body="select position, full_path, case when k = 1 then base || ext end as destination, case when k = 1 then 'done' else 'skipped' end as status from q"),
)
def c11(t):
    files = _files(t)
    return R.commit_plan(R.rename_plan(files, Rename(template="{mtime:%Y-%m}")), files)


@query(
    "C11_commit_keep_both",
    with_views("files_v", ctes=COMMIT, body="select position, full_path, base || case when k = 1 then '' else ' (' || (k - 1) || ')' end || ext as destination, 'done' as status from q"),
)
def c11_both(t):
    files = _files(t)
    return R.commit_plan(R.rename_plan(files, Rename(template="{mtime:%Y-%m}")), files, keep_both=True)


@query(
    "C11_commit_counts",
    with_views("files_v", ctes=COMMIT, body="select case when k = 1 then 'done' else 'skipped' end as status, count(*) as files from q group by 1"),
)
def c11_counts(t):
    return R.commit_counts(c11(t))


@query(
    "C12_single_plans",
    with_views("bits_v", ctes=PAIRS + f""",
near as (select full_path, other, distance from (select pa as full_path, pb as other, distance from pair union all select pb, pa, distance from pair)
  qualify row_number() over (partition by full_path order by distance, {NAT.format('other')}) = 1)""",
        body="""select i.full_path, regexp_replace(i.full_path, 'img_([0-9]+)_', 'photo \\1-') as new_path, null::varchar as err, false as same, false as conflict,
n.other as dup_path, n.distance as dup_distance from img i left join near n on n.full_path = i.full_path"""),
)
def c12(t):
    images = _images(t)
    duplicates = nearest_duplicate(images, CLOSE, [natural_key("full_path")])
    files = images.select("full_path", F.lit(None).cast("timestamp").alias("mtime"))
    return R.single_plans(files, Rename(template="{orig}", find=r"img_(\d+)_", replace=r"photo \1-"), duplicates)


@query(
    "C12_single_invoices",
    with_views("files_v", ctes="""f as (select full_path, mtime, regexp_extract(full_path, '^(.*)/[^/]*$', 1) as dir, regexp_replace(filename, '[.][^.]*$', '') as stem, regexp_extract(filename, '[.][^.]*$') as ext
  from files_v qualify row_number() over (partition by full_path order by id) = 1),
s as (select *, strftime(mtime, '%d.%m.%Y') as base, regexp_extract(stem, '^(.*)-([0-9]+)$', 1) as of, try_cast(regexp_extract(stem, '^(.*)-([0-9]+)$', 2) as bigint) as n from f),
top as (select dir, of, max(n) as highest from s where n is not null group by all),
num as (select s.*, case when s.of = base and n is not null then n else coalesce(highest, 0) + 1 end as k from s left join top on top.dir = s.dir and top.of = s.base),
out_ as (select full_path, case when full_path like '%.txt' then null else dir || '/' || base || '-' || k || ext end as new_path, k from num)""",
        body="""select full_path, case when new_path is null then null else new_path end as new_path, case when new_path is null then 'no EXIF date' end as err, coalesce(new_path = full_path, false) as same,
coalesce(new_path <> full_path and new_path in (select full_path from f), false) as conflict, case when new_path is not null then k end as invoice_n from out_"""),
)
def c12_invoices(t):
    """Invoices named by their capture date, which text files do not have."""
    files = L.distinct_paths(t.files()).withColumn("taken_at", F.when(~F.col("full_path").endswith(".txt"), F.col("mtime")))
    none = files.select("full_path", F.lit(None).cast("string").alias("other"), F.lit(None).cast("int").alias("distance")).filter("false")
    found = R.single_plans(files, Rename(template="{exif_date:%d.%m.%Y}"), none, invoice=True)
    return found.drop("dup_path", "dup_distance")


@query(
    "C13_metadata_merge",
    with_views("meta_v", body="""select file_id, case when ok then 'Archive' else title end as title, case when ok then 'Brand#13' else author end as author, keywords,
case when ext in ('.jpg', '.png') then 'free' else '' end as comment,
case when (ok and (title <> 'Archive' or author <> 'Brand#13')) or ext in ('.jpg', '.png') then 'done' else 'skipped' end as status
from (select *, ext <> '.webp' as ok from meta_v)"""),
)
def c13(t):
    values = {"title": "Archive", "author": "Brand#13", "keywords": " ", "comment": "free"}
    return meta.merge_fields(t.meta(), values).select("file_id", "title", "author", "keywords", "comment", "status")


@query(
    "C14_supported_fields",
    with_views("meta_v", body="""select file_id, case ext when '.pdf' then 'title,description,author,keywords' when '.webp' then ''
else 'title,description,author,keywords,copyright,comment' end as fields from meta_v"""),
)
def c14(t):
    return t.meta().select("file_id", F.array_join(meta.supported_fields("ext"), ",").alias("fields"))


@query(
    "C15_tag_tables",
    """select p_partkey as file_id, p_name as title, p_type as description, case when p_size % 2 = 0 then p_brand else p_type end as author,
'' as keywords, '' as copyright, p_name || '؟' as comment from part""",
)
def c15(t):
    def tag(name, text, encoding):
        return F.struct(F.lit(name).alias("tag"), F.encode(text, encoding).alias("bytes"))

    end = F.lit("\0")
    tags = t.table("part").select("p_partkey", F.inline(F.array(
        tag("XPTitle", F.concat("p_name", end), "UTF-16LE"),
        tag("ImageDescription", F.concat("p_type", end), "UTF-8"),
        tag("Artist", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit("")), "UTF-8"),
        tag("XPAuthor", F.col("p_type"), "UTF-16LE"),
        tag("XPComment", F.concat("p_name", F.lit("؟"), end), "UTF-16LE"),
    )))
    return meta.fields_from_tags(tags, "p_partkey").withColumnRenamed("p_partkey", "file_id")


@query(
    "C16_child_folders",
    with_views("files_v", body=f"""select child, row_number() over (order by {NATURAL.format('child')}, child) as position
from (select distinct split_part(full_path, '/', 4) as child from files_v where full_path like '/lake/c1/%' and split_part(full_path, '/', 4) not like '.%')"""),
)
def c16(t):
    return L.child_folders(t.files(), "/lake/c1")
