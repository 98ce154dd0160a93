"""Named queries on further gates, scores and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.current import current_rows
from tessera.plans.registry import Registry
from tessera.sources.tables import read_table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

_WORDS = "list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"


@register("FLT-17", "SELECT p_partkey, CASE WHEN p_size < 4 THEN 'tiny' WHEN p_size * p_retailprice < 8000 THEN 'small_area' WHEN greatest(p_size * 20, p_retailprice) / least(p_size * 20, p_retailprice) >= 12 THEN 'strip' END AS reason FROM part")
def excluded_dimensions(spark, sf):
    w, h = F.col("p_size") * 20, F.col("p_retailprice")
    return read_table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") < 4, "tiny").when(F.col("p_size") * h < 8000, "small_area").when(F.greatest(w.cast("double"), h) / F.least(w.cast("double"), h) >= 12, "strip").alias("reason"))


@register("FLT-19", "SELECT vec_id, list_aggregate(embedding::DOUBLE[], 'avg') < 0.0 AND len(list_filter(embedding, lambda x: x < 0)) >= 34 AS dark FROM embeddings")
def dark_samples(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size("embedding")
    return read_table(spark, sf, "embeddings").select("vec_id", ((mean < 0.0) & (F.size(F.filter("embedding", lambda x: x < 0)) >= 34)).alias("dark"))


_TERMS = ("carcinoma", "necrosis", "margin")


@register("RNK-09", "SELECT tag_id, CASE WHEN starts_with(primary_tag, 'GI::Colon') THEN 0.2 WHEN starts_with(primary_tag, 'GI::') THEN round(0.2 * (1 - 0.12), 6) WHEN starts_with(primary_tag, 'HN::') THEN round(0.2 * (1 - 0.24), 6) ELSE 0.0 END::DOUBLE AS bonus FROM canonical_tags")
def prior_bonus(spark, sf):
    tag, bonus = F.col("primary_tag"), F.lit(0.0)
    for j, prefix in reversed(list(enumerate(("GI::Colon", "GI::", "HN::")))):
        bonus = F.when(tag.startswith(prefix), round(0.2 * (1 - 0.12 * j), 6)).otherwise(bonus)
    return read_table(spark, sf, "canonical_tags").select("tag_id", bonus.alias("bonus"))


@register(
    "ORC-03",
    """WITH s AS (SELECT package_id, count(*) AS segments, min(video_url) AS video FROM segments_indexable GROUP BY 1)
       SELECT coalesce(nullif(string_split(package_id, '_')[1], ''), 'none') AS series, count(*) AS packages, sum(segments)::BIGINT AS segments, count(*) FILTER (WHERE video IS NULL) AS missing FROM s GROUP BY 1""",
)
def series_index(spark, sf):
    per = read_table(spark, sf, "segments_indexable").groupBy("package_id").agg(F.count("*").alias("segments"), F.min("video_url").alias("video"))
    series = F.coalesce(F.nullif(F.split("package_id", "_")[0], F.lit("")), F.lit("none"))
    return per.groupBy(series.alias("series")).agg(F.count("*").alias("packages"), F.sum("segments").alias("segments"), F.count_if(F.col("video").isNull()).alias("missing"))


@register("ORC-04", "SELECT package_id, count(*) AS segments, count(DISTINCT primary_tag) AS tags, array_to_string(list_slice(list_sort(list(DISTINCT primary_tag)), 1, 10), ',') AS first_tags FROM segments_indexable GROUP BY 1")
def package_summary(spark, sf):
    tags = F.array_sort(F.collect_set("primary_tag"))
    return read_table(spark, sf, "segments_indexable").groupBy("package_id").agg(F.count("*").alias("segments"), F.countDistinct("primary_tag").alias("tags"), F.array_join(F.slice(tags, 1, 10), ",").alias("first_tags"))


@register("ORC-06", "SELECT source, variant, count(*) AS n FROM (SELECT source, 'off' AS variant FROM documents UNION ALL SELECT source, 'on' FROM documents WHERE root IS NULL OR root = 'GI') GROUP BY ALL")
def flag_comparison(spark, sf):
    kept = F.when(F.col("root").isNull() | (F.col("root") == "GI"), F.array(F.lit("off"), F.lit("on"))).otherwise(F.array(F.lit("off")))
    return read_table(spark, sf, "documents").select("source", F.explode(kept).alias("variant")).groupBy("source", "variant").agg(F.count("*").alias("n"))


@register("TOP-11", "SELECT kind, id FROM (SELECT 'chunk' AS kind, chunk_id AS id FROM chunks UNION SELECT 'journal', chunk_id FROM journal_virchows UNION SELECT 'entity', record_id FROM gi_crc_standalone) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY id) <= CASE kind WHEN 'chunk' THEN 120 WHEN 'journal' THEN 10 ELSE 40 END")
def caps(spark, sf):
    part = lambda t, c, k, n: read_table(spark, sf, t).select(F.col(c).alias("id")).distinct().orderBy("id").limit(n).select(F.lit(k).alias("kind"), "id")
    return part("chunks", "chunk_id", "chunk", 120).unionByName(part("journal_virchows", "chunk_id", "journal", 10)).unionByName(part("gi_crc_standalone", "record_id", "entity", 40))
