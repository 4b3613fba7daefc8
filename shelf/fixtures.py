"""Views over the driver's tables: file listings, logs, detections, taught boxes, grids.

Each view exists twice, as Spark DataFrame and as DuckDB text, with equal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_FILES = """
select id, dir || '/' || name as full_path, {last_dir} as folder_name, name as filename, mtime, length
from (select o_orderkey as id,
  '/lake/c' || cast(o_custkey % 3 as string) || '/' || case o_orderkey % 7 when 0 then 'inbox' when 1 then '.cache'
    when 2 then 'export_output' when 3 then {fmt}(o_orderdate,{my}) else {fmt}(o_orderdate,{dmy}) end as dir,
  case o_orderkey % 5 when 0 then {fmt}(o_orderdate,{dmy}) when 1 then 'scan_' || cast(o_orderkey % 97 as string)
    when 2 then {fmt}(o_orderdate,{dotted}) || '-' || cast(o_orderkey % 4 as string) when 3 then '0'
    else 'IMG_' || {fmt}(o_orderdate,{under}) || '_x' end
  || case o_orderkey % 6 when 0 then '.jpeg' when 1 then '.JPG' when 2 then '.png' when 3 then '.pdf'
    when 4 then '.webp' else '.txt' end as name,
  o_orderdate as mtime, cast(floor(o_totalprice) as bigint) as length from {orders}) t
"""

_FEEDBACK = """
select event_id as id, ts, cast(user_id % 5 as int) as profile,
  case event_type when 'error' then 'crop_too_tight' when 'click' then 'crop_too_loose'
    when 'purchase' then 'similar_yes' when 'signup' then 'similar_no' else 'crop_good' end as kind,
  cast(event_id % 21 as int) as spread from {events}
"""

_LOG = """
select event_id as id, ts, 'u' || cast(user_id as string) || '-' || {fmt}(ts,{day}) as run_id,
  case when event_type in ('click','view') then 'move' else 'crop' end as op,
  '/lake/in/' || cast(event_id as string) || '.jpg' as source,
  '/lake/out/' || cast(event_id % 400 as string) || '.jpg' as destination,
  case event_type when 'error' then 'rejected' when 'signup' then 'pending' when 'purchase' then 'pending'
    else 'approved' end as status
from {events}
"""

# every image; where nothing was detected (signup events) the detection columns are null
_IMAGES = """
select event_id as image_id,
  cast(case event_id % 4 when 0 then 899 when 1 then 1600 when 2 then 4000 else 1200 end as int) as w,
  cast(case event_id % 4 when 0 then 1599 when 1 then 1200 when 2 then 3000 else 1200 end as int) as h,
  case when event_type <> 'signup' then cast(event_id % 100 as double)/400 end as det_l,
  case when event_type <> 'signup' then cast(event_id % 90 as double)/300 end as det_t,
  case when event_type <> 'signup' then 1 - cast(event_id % 80 as double)/400 end as det_r,
  case when event_type <> 'signup' then 1 - cast(event_id % 70 as double)/300 end as det_b,
  case when event_type <> 'signup' then cast(event_id % 101 as double)/100 end as det_conf,
  case when event_type <> 'signup' then cast(event_id % 41 as double)/10 - 2 end as angle
from {events}
"""

_EXAMPLES = """
select image_id as id, '/lake/in/' || cast(image_id % 700 as string) || '.jpg' as source_path, w as img_w, h as img_h,
  case image_id % 3 when 0 then 'invoice' when 1 then 'income' else 'receipt' end as type,
  coalesce(det_l, 0.1) - cast(image_id % 7 as double)/1000 as box_l,
  coalesce(det_t, 0.1) - cast(image_id % 5 as double)/1000 as box_t,
  coalesce(det_r, 0.9) + cast(image_id % 6 as double)/1000 as box_r,
  coalesce(det_b, 0.9) + cast(image_id % 4 as double)/1000 as box_b,
  cast(case when image_id % 13 = 0 then 1 else 0 end as int) as low_quality,
  det_l, det_t, det_r, det_b, det_conf from {images}
"""

_PIXELS_SPARK = """
select vec_id as image_id, cast(pos div 8 as int) as y, cast(pos % 8 as int) as x,
  greatest(0.0D, least(255.0D, 128 + 400*cast(v as double))) as lum
from (select vec_id, posexplode(embedding) as (pos, v) from {embeddings}) t
"""
_PIXELS_DUCK = """
select vec_id as image_id, cast((pos-1)//8 as int) as y, cast((pos-1)%8 as int) as x,
  greatest(0.0, least(255.0, 128 + 400*cast(v as double))) as lum
from (select vec_id, unnest(embedding) as v, unnest(range(1,65)) as pos from embeddings) t
"""

_META = """
select p_partkey as file_id, case p_partkey % 4 when 0 then '.jpg' when 1 then '.pdf' when 2 then '.png' else '.webp' end as ext,
  case when p_size % 3 = 0 then '' else p_name end as title, p_brand as author,
  case when p_size % 2 = 0 then '' else p_type end as keywords from {part}
"""

_BITS_DUCK = """
select vec_id, list_transform(embedding, lambda x: x::double > (list_sort(embedding)[32]::double + list_sort(embedding)[33]::double)/2) as b
from embeddings
"""

_SPARK_WORDS = dict(
    fmt="date_format", my="'MM-yyyy'", dmy="'dd-MM-yyyy'", dotted="'dd.MM.yyyy'", under="'dd_MM_yyyy'",
    day="'yyyyMMdd'", last_dir="element_at(split(dir,'/'),-1)",
)
_DUCK_WORDS = dict(
    fmt="strftime", my="'%m-%Y'", dmy="'%d-%m-%Y'", dotted="'%d.%m.%Y'", under="'%d_%m_%Y'",
    day="'%Y%m%d'", last_dir="split_part(dir,'/',-1)",
)


class Tables:
    """The fixture views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, text: str, **tables: DataFrame) -> DataFrame:
        slots = {k: "{" + k + "}" for k in tables}
        return self.spark.sql(text.format(**_SPARK_WORDS, **slots), **tables)

    def files(self) -> DataFrame:
        return self._view(_FILES, orders=self.table("orders"))

    def feedback(self) -> DataFrame:
        return self._view(_FEEDBACK, events=self.table("events"))

    def log(self) -> DataFrame:
        return self._view(_LOG, events=self.table("events"))

    def images(self) -> DataFrame:
        return self._view(_IMAGES, events=self.table("events"))

    def examples(self) -> DataFrame:
        return self._view(_EXAMPLES, images=self.images())

    def pixels(self) -> DataFrame:
        return self._view(_PIXELS_SPARK, embeddings=self.table("embeddings"))

    def meta(self) -> DataFrame:
        return self._view(_META, part=self.table("part"))

    def hashes(self) -> DataFrame:
        from shelf.functions.bits import median_hash

        return self.table("embeddings").select("vec_id", median_hash("embedding").alias("h"))


DUCK_VIEWS = {
    "files_v": _FILES.format(**_DUCK_WORDS, orders="orders"),
    "feedback_v": _FEEDBACK.format(events="events"),
    "log_v": _LOG.format(**_DUCK_WORDS, events="events"),
    "images_v": _IMAGES.format(events="events"),
    "examples_v": _EXAMPLES.format(images="images_v"),
    "pixels_v": _PIXELS_DUCK,
    "meta_v": _META.format(part="part"),
    "bits_v": _BITS_DUCK,
}


def with_views(*names: str, ctes: str = "", body: str) -> str:
    """DuckDB text: the named fixture views, further CTEs, then the query."""
    needed = list(names)
    if "examples_v" in needed and "images_v" not in needed:
        needed.insert(0, "images_v")
    parts = [f"{n} as ({DUCK_VIEWS[n]})" for n in needed]
    text = "with " + ",\n".join(parts)
    if ctes.strip():
        text += (",\n" if parts else "") + ctes.strip()
    return text + "\n" + body


QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name`` with the SQL text that must give the same rows."""

    def register(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register
