"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_pack, op2_repeats, op3_quality, op4_jaccard, op5_tokens, op6_secrets, op7_decontaminate, op8_pii, op9_search, op10_toxicity
from .shared import table


def held_out(mod: int, rest: int) -> Column:
    """Rows kept from training: crc32 of the id as text leaves ``rest`` modulo ``mod``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def op1_pack_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pack.pack(table(spark, sf_dir, "documents"))


def op2_repeats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op2_repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", (F.length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def op3_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = op3_quality.train(docs, table(spark, sf_dir, "labels"), learn=~held_out(4, 2))
    out = op3_quality.scored(docs, model)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def _listed(spans: str) -> Column:
    kinds = F.array(*map(F.lit, op8_pii.KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"], x["end"])), ",")


def op8_pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op8_pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(k: int) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{op8_pii.KINDS[k]}")

    counts = [count(k) for k in range(len(op8_pii.KINDS))]
    return out.select("doc_id", *counts, F.sha2(_listed("base_spans"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def op9_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_search.search(table(spark, sf_dir, "documents"), is_query=F.col("doc_id") % 20 == 0)


def op10_toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = op10_toxicity.train(docs, table(spark, sf_dir, "labels"), learn=~held_out(5, 0))
    out = op10_toxicity.scored(docs, model)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_tokens.count_tokens(table(spark, sf_dir, "documents"))


def op6_secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_secrets.scan(table(spark, sf_dir, "documents"))


def op7_decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op7_decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return op7_decontaminate.report(rows.select("doc_id", "n_words", "runs", "items")).drop("items")


def pipeline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pack": op1_pack_query,
        "op2_repeats": op2_repeats_query,
        "op3_quality": op3_quality_query,
        "op4_jaccard": op4_jaccard_query,
        "op5_tokens": op5_tokens_query,
        "op6_secrets": op6_secrets_query,
        "op7_decontaminate": op7_decontaminate_query,
        "op8_pii": op8_pii_query,
        "op9_search": op9_search_query,
        "op10_toxicity": op10_toxicity_query,
        "pipeline": pipeline_query,
    }


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATE = f"""
with d as (select row_number() over () as r, doc_id, {_SPLIT} as w from documents),
i as (select coalesce(item_id::varchar, '') as item, {_SPLIT} as w from benchmark),
v as (select item, least(len(w), 13) as k, w from i where len(w) > 0),
item_windows as (select distinct item, k, list_slice(w, s, s + k - 1) as win from (select *, unnest(range(1, len(w) - k + 2)) as s from v)),
sizes as (select distinct k from v),
doc_windows as (select r, s, k, list_slice(w, s, s + k - 1) as win from (select r, w, k, unnest(range(1, len(w) - k + 2)) as s from d cross join sizes)),
hits as (select r, s, k, item from doc_windows join item_windows using (k, win)),
hit_words as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + k)) as p from hits) group by r),
hit_items as (select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct r, item from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit_words using (r) left join hit_items using (r)"""


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_JACCARD = rf"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select r, doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda p: array_to_string(list_slice(w, p, p + 4), ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as x from d),
t as (select r, len(x) as n, unnest(x) as t from s),
links as (select a.r as a, b.r as b from t a join t b on a.t = b.t and a.r <> b.r group by 1, 2 having 100 * count(*) >= 75 * (max(a.n) + max(b.n) - count(*))),
reach(r, other) as (select r, r from s union select reach.r, links.b from reach join links on links.a = reach.other)
select s.doc_id, len(any_value(s.x))::bigint as n_shingles, min(o.doc_id) as component_id from s join reach using (r) join s o on o.r = reach.other group by s.r, s.doc_id"""

_SEARCH = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
size as (select count(*) as n, avg(len(w)) as mean from d),
tf as (select r, doc_id, len(w) as l, term, count(*) as tf from (select *, unnest(w) as term from d) group by all),
df as (select term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as weight from tf, size group by term),
hits as (select q.query_id, tf.r, tf.doc_id, round(sum(weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 5) as score from (select distinct doc_id as query_id, term from tf where doc_id % 20 = 0) q join df using (term) join tf using (term), size group by all)
select query_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from hits where score > 0) where rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard": _JACCARD, "op7_decontaminate": _DECONTAMINATE, "op9_search": _SEARCH}
