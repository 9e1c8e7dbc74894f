"""Registered queries of the training-data operators, with DuckDB texts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm.common import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


MIX_SQL = r"""
with base as (
  select doc_id, coalesce('s' || source, 't') src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from {documents}),
named as (select *, length(bin(size + 1)) bits from base),
cells as (select *, bits * 8 + ((size + 1) * 8 >> (bits - 1)::int) cls, coalesce(('0x' || substr(md5(doc_id::varchar), 1, 4))::int % 64, 0) slice from named),
per as (select src, sum(size)::bigint source_size from base group by src),
weighed as (select *, case (row_number() over (order by encode(src)) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end w from per),
filled as (
  select *, sum(source_size) over () total, sum(w) over () all_w,
    coalesce(sum(source_size) over (order by source_size / w, encode(src) rows between unbounded preceding and 1 preceding), 0) full_size,
    coalesce(sum(w) over (order by source_size / w, encode(src) rows between unbounded preceding and 1 preceding), 0) used from weighed),
leveled as (select *, (total::double * 1.5 - full_size * 2) / (all_w - used)::double lvl from filled),
level as (select arg_min(lvl, full_size + used) lvl from leveled where lvl * w <= source_size * 2),
targets as (select src, source_size, least(coalesce((select lvl from level) * w, (source_size * 2)::double), (source_size * 2)::double) target from leveled),
ranked as (select *, row_number() over (partition by src order by cls, slice, size, doc_id) r from cells),
stepped as (
  select doc_id, size, source_size, target, r, case when source_size > 0 then target / source_size else 0.0::double end step,
    ('0x' || substr(md5('mix' || src), 1, 8))::bigint / 4294967296.0::double u
  from ranked join targets using (src))
select doc_id, size, source_size::bigint source_size, target,
  (least(floor(r * step + u) - floor((r - 1) * step + u), 2) * size)::bigint taken,
  least(floor(r * step + u) - floor((r - 1) * step + u), 2)::int copies from stepped
"""


@query("op2_mix_sources", MIX_SQL.format(documents="documents"))
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.mixing import mix_sources
    return mix_sources(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark),
items as (select item_id, w, least(len(w), 10) n from b where len(w) > 0),
wins as (select distinct item_id, n, list_slice(w, p, p + n - 1) g from (select *, unnest(range(1, len(w) - n + 2)) p from items)),
sizes as (select distinct n from wins),
spots as (select doc_id, n, p, list_slice(w, p, p + n - 1) g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) p from d, sizes where len(w) >= n)),
found as (select doc_id, item_id, p, n from spots join wins using (n, g)),
hit as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from found) group by doc_id),
named as (select doc_id, count(*) n_items, string_agg(k, ',' order by k) ids from (select distinct doc_id, item_id::varchar k from found) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (doc_id) left join named using (doc_id)
"""


@query("op6_decontaminate", OP6_SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.decontaminate import find_contamination
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest")


@query("op8_token_records")
def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from llm.tokens import write_tokens
    index = write_tokens(table(spark, sf_dir, "documents"), shared_dir(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op9_exact_groups", """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') norm from documents)
select doc_id, max(doc_id) over (partition by norm) keep_id, count(*) over (partition by norm) group_size,
  doc_id = max(doc_id) over (partition by norm) kept, sha256(norm) text_sha256 from t
""")
def op9_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.exact import exact_groups
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.toxicity import fit_toxicity, score_toxicity
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.language import identify, language_samples
    docs = table(spark, sf_dir, "documents")
    return identify(docs, language_samples(docs))


@query("op5_substrings")
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.substrings import dedup_substrings
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept_text")


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.near import near_components
    return near_components(table(spark, sf_dir, "documents"))


@query("op7_main_text")
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.pages import main_text
    return main_text(table(spark, sf_dir, "pages"))


@query("op10_personal_data")
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.pii import personal_data
    return personal_data(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op12_quality_rules")
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.quality import fit_quality, quality_rules
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


OP13_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
sized as (select doc_id, w, len(w)::bigint n from d where len(w) > 0),
total as (select count(*)::bigint nn, sum(n)::bigint ll from sized),
q as (select item_id, t, count(*)::bigint times from (select item_id, unnest(list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) t from benchmark)
      group by all),
tf as (select doc_id, n, t, count(*)::bigint tf from (select doc_id, n, unnest(w) t from sized) where t in (select t from q) group by all),
weight as (select t, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint w from tf, total group by t, nn),
scored as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::bigint score
           from q join weight using (t) join tf using (t), total group by item_id, doc_id),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int rank, doc_id, score from scored where score > 0)
select * from ranked where rank <= 20
"""


@query("op13_ranked_search", OP13_SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.search import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
