"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelf.llm import (
    decontamination, exact_dedup, language_mix, lexical_search, license_scan, mixing, near_dedup, page_templates, resample, run_index, shard_index, token_lengths, vector_codes,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resampled(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", (F.size("spans") > 0).alias("contaminated"), F.size("spans").cast("long").alias("n_spans"),
        F.array_sort(F.array_distinct("spans.item_id")).alias("item_ids"), F.array_min("spans.edits").alias("least_edits"), "spans",
    )


def op4(spark: SparkSession, folder: str) -> DataFrame:
    return token_lengths.suffix_sums(token_lengths.length_histogram(token_lengths.encoded_lengths(_table(spark, folder, "documents"))))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = language_mix.identify_languages(docs, *language_mix.learn_languages(docs))
    return found.select("doc_id", language_mix.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.map_entries("proportions").alias("proportions"))


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return page_templates.extract_main_text(_table(spark, folder, "pages"))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_components(_table(spark, folder, "documents"))


def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = run_index.remove_repeats(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, folder, "documents")).drop("spans")


def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs).select("doc_id", "source", mixing.n_words(F.col("text")).alias("tokens"), "block", "place")


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return shard_index.remove_shared_windows(_table(spark, folder, "documents")).drop("removed")


def op13(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress_vectors(_table(spark, folder, "embeddings")).drop("label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": op1,
    "op2_bloom_exact_dedup": op2,
    "op3_qgram_decontamination": op3,
    "op4_token_length_histogram": op4,
    "op5_language_mixture": op5,
    "op6_template_extraction": op6,
    "op7_sketch_near_dedup": op7,
    "op8_run_index_dedup": op8,
    "op9_template_licenses": op9,
    "op10_temperature_mixing": op10,
    "op11_bit_sliced_search": op11,
    "op12_shard_index_dedup": op12,
    "op13_dual_tree_codes": op13,
}

_OP2 = """
with t as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by 1)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from t join g using (text_sha256)
"""


def mix_sql(table: str = "documents", columns: str = "doc_id, source, tokens") -> str:
    """DuckDB text of the default mixture: repetition at most 2, every source read at least once."""
    rounds = "".join(
        f""",
m{r} as (select b.lo, b.hi, b.lo + i * ((b.hi - b.lo) / 64) as a,
    max((b.lo + i * ((b.hi - b.lo) / 64) - 1) * ln(share)) - min((b.lo + i * ((b.hi - b.lo) / 64) - 1) * ln(share)) as spread
  from b{r} b, range(0, 65) t(i), shares group by b.lo, b.hi, i),
f{r} as (select min(a) as hi from m{r} where spread <= ln(2.0::double) + 1e-9),
b{r + 1} as (select coalesce((select max(a) from m{r} where a < f{r}.hi), f{r}.hi) as lo, f{r}.hi as hi from f{r})"""
        for r in range(4)
    )
    return f"""
with sized as (
  select *, coalesce(source, '') as src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as tokens from {table}),
totals as (select src, sum(tokens)::bigint as t from sized group by 1 having sum(tokens) > 0),
shares as (select src, t, t / (select sum(t) from totals)::double as share from totals),
b0 as (select 0.0::double as lo, 1.0::double as hi){rounds},
raised as (select src, t, exp((select hi from b4) * ln(share)) as u from shares),
scaled as (select max(t / u) * sum(u) as total, sum(u) as z from raised),
budgets as (select src, t, cast(floor(u / z * total + 1e-6) as bigint) as budget from raised, scaled),
plan as (select src, budget // t as whole, budget % t as rest from budgets),
planned as (select sized.*, coalesce(whole, 1) as whole, coalesce(rest, 0) as rest from sized left join plan using (src)),
rows as (select *, unnest(range(1, whole + 2)) as block from planned),
placed as (select *, md5('mix:' || block || ':' || coalesce(cast(doc_id as varchar), '')) as place from rows),
running as (select *, sum(tokens) over (partition by src, block order by place) as upto from placed)
select {columns}, block, place from running where block <= whole or (rest > 0 and upto <= rest)
"""


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OP11 = rf"""
with dterms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}')) as term from documents),
iterms as (
  select item_id, term, count(*) as q from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}')) as term from benchmark) group by all),
sizes as (select doc_id, count(*) as n from dterms group by 1),
whole as (select count(*) as docs, sum(n)::bigint as l from sizes),
norms as (select doc_id, 25 + (75 * n * docs) // l as m from sizes, whole),
tfs as (select doc_id, term, count(*) as tf from dterms where term in (select term from iterms) group by all),
weights as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from tfs, whole group by term),
scores as (
  select item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from iterms join weights using (term) join tfs using (term) join norms using (doc_id) group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from scores where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""

_OP12 = r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from t)),
f as (select win, min(doc_id) as first from g group by 1),
h as (select distinct doc_id, i + k as p from g join f using (win), range(0, 13) r(k) where first < doc_id),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from t),
marked as (select words.*, h.p is not null as gone from words left join h using (doc_id, p)),
kept as (select doc_id, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by p) filter (where not gone) as kept from marked group by 1)
select t.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from t left join kept using (doc_id)
"""


def codes_sql(width: int = 64, rounds: int = 6) -> str:
    """DuckDB text of the vector codes for vectors of ``width`` components: every round is a step of its own."""
    size = width // 8
    off = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, size + 1))
    mean = ", ".join(f"cast((sum(x[{i}]) - ((sum(x[{i}]) % count(*)) + count(*)) % count(*)) // count(*) as bigint)" for i in range(1, size + 1))

    def step(r: int) -> str:
        return f""",
a{r} as materialized (select vec_id, p, any_value(x) as x, min(d * 16 + e) % 16 as e, min(d * 16 + e) // 16 as d
  from (select vec_id, p, x, e, {off} as d from parts join b{r} using (p)) group by vec_id, p)"""

    text = f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * x::double) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select vec_id, p, v[p * {size} + 1:p * {size} + {size}] as x from kept, range(0, 8) t(p)),
b0 as (select p, e, x as c from parts join (select vec_id, row_number() over (order by vec_id) - 1 as e from kept) using (vec_id) where e < 16)"""
    for r in range(rounds):
        text += step(r) + f""",
b{r + 1} as materialized (select b.p, b.e, coalesce(m.c, b.c) as c from b{r} b left join (select p, e, [{mean}] as c from a{r} group by p, e) m on b.p = m.p and b.e = m.e)"""
    return text + step(rounds) + f""",
coded as (select vec_id, string_agg(lpad(printf('%x', e), 2, '0'), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by vec_id),
books as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from b{rounds})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from coded join kept using (vec_id), books
"""


ORACLES = {
    "op2_bloom_exact_dedup": _OP2, "op10_temperature_mixing": mix_sql(), "op11_bit_sliced_search": _OP11, "op12_shard_index_dedup": _OP12, "op13_dual_tree_codes": codes_sql(),
}
