"""One production query for each operator, and DuckDB SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storepulse.llm.exact_dedup import exact_dedup
    return exact_dedup(_documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storepulse.llm.sharding import shard_by_bytes
    return shard_by_bytes(_documents(spark, sf_dir), shards=24)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storepulse.llm.jaccard_join import jaccard_components
    return jaccard_components(_documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storepulse.llm.pii import detect
    return detect(_documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from storepulse.llm.bpe import encode
    return encode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                  public_tokenizers.PATTERN, digest=True)


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storepulse.llm.topk import exact_top_k
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storepulse.llm.substrings import remove_repeats
    return remove_repeats(_documents(spark, sf_dir), digest=True)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from storepulse.llm.packing import pack_documents
    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storepulse.llm.quality import classify
    return classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storepulse.llm.html_text import extract
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storepulse.llm.neighbour_graph import nearest
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storepulse.llm.centroids import cluster
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storepulse.llm.spelling import variants
    return variants(_documents(spark, sf_dir))


OP1_SQL = r"""
with n as (
  select doc_id, coalesce(text, '') as t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents),
r as (
  select doc_id, norm,
         row_number() over (partition by norm order by length(t) desc, doc_id) as rn,
         first_value(doc_id) over (partition by norm order by length(t) desc, doc_id) as keep_id,
         count(*) over (partition by norm) as group_size
  from n)
select doc_id, keep_id, group_size, rn = 1 as kept, sha256(norm) as text_sha256 from r
"""

OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda c: floor(256 * c::double)::hugeint) as x
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = len(embedding)),
q as (select vec_id as query_id, unnest(x) as qc, generate_subscripts(x, 1) as d from v where vec_id % 50 = 0),
c as (select vec_id, unnest(x) as cc, generate_subscripts(x, 1) as d from v),
s as (select query_id, vec_id, sum(qc * cc) as score from q join c using (d) where query_id <> vec_id group by all)
select query_id, rank::int as rank, vec_id, try_cast(score as bigint) as score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""

_OP12_START = """
with v as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda c: floor(1024 * c::double)::bigint) as x
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = 64),
c0 as materialized (
  select (row_number() over (order by sha256('3:' || coalesce(vec_id::varchar, '')), vec_id nulls first, x) - 1)::int as cluster, x as center
  from v qualify cluster < 8)"""

#: One round: the assignment to centroids c{r}, and the centroids c{s} that follow; empty ones stay.
_OP12_ROUND = """,
a{r} as materialized (
  select row, cluster, distance from (
    select row, cluster, list_sum(list_transform(list_zip(x, center), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance
    from v, c{r}) qualify row_number() over (partition by row order by distance, cluster) = 1)"""
_OP12_MOVE = """,
c{s} as materialized (
  select cluster, coalesce(moved, center) as center from c{r} left join (
    select cluster, list((total - ((total % n) + n) % n) // n order by d) as moved from (
      select cluster, d, sum(component)::bigint as total, count(*) as n
      from (select cluster, unnest(x) as component, generate_subscripts(x, 1) as d from a{r} join v using (row)) group by all)
    group by cluster) using (cluster))"""
_OP12_END = """
select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia,
       sum(distance) over ()::bigint as inertia, sha256(array_to_string(center, ',')) as centroid_sha256
from a10 join c10 using (cluster) join v using (row)
"""
OP12_SQL = _OP12_START + "".join(_OP12_ROUND.format(r=r) + _OP12_MOVE.format(r=r, s=r + 1) for r in range(10)) + \
    _OP12_ROUND.format(r=10) + _OP12_END


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_dedup, op2_sharding, op3_jaccard_join, op4_pii, op5_byte_bpe, op6_topk_search, op7_suffix_array_dedup, op8_packing, op9_quality_classifier,
                                    op10_html_extraction, op11_nearest_neighbours, op12_centroid_clusters, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op6_topk_search": OP6_SQL, "op12_centroid_clusters": OP12_SQL}
