"""Named queries on aggregates, orders and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.joins import first_per_key
from tessera.plans.registry import Registry
from tessera.sources.tables import read_table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


@register("AGG-01", "SELECT source, tag_root, count(*) AS n FROM records GROUP BY ALL")
def counts(spark, sf):
    return read_table(spark, sf, "records").groupBy("source", "tag_root").agg(F.count("*").alias("n"))


@register("AGG-02", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL")
def sums(spark, sf):
    rows = read_table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(net), 2).alias("net"), F.count("*").alias("n"))


@register("AGG-03", "SELECT primary_tag, tag_root, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n FROM records WHERE primary_tag IS NOT NULL GROUP BY ALL")
def catalogue(spark, sf):
    return read_table(spark, sf, "records").where("primary_tag is not null").groupBy("primary_tag", "tag_root").agg(F.nullif(F.array_join(F.sort_array(F.collect_set("source")), ","), F.lit("")).alias("sources"), F.count("*").alias("n"))


@register("AGG-04", "SELECT count(*) AS n, count(DISTINCT source_family) AS families, count(DISTINCT nullif(tag_root, '')) AS roots FROM records")
def totals(spark, sf):
    return read_table(spark, sf, "records").agg(F.count("*").alias("n"), F.countDistinct("source_family").alias("families"), F.countDistinct(F.nullif("tag_root", F.lit(""))).alias("roots"))


@register("AGG-05", "SELECT event_type, min(value) AS lo, max(value) AS hi, round(avg(value), 3) AS mean, count(*) AS n FROM events GROUP BY event_type")
def spreads(spark, sf):
    return read_table(spark, sf, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 3).alias("mean"), F.count("*").alias("n"))


@register("AGG-06", "SELECT event_type, round(median(value), 6) AS median, list(value ORDER BY value)[count(*) // 2 + 1] AS upper_median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def medians(spark, sf):
    rows = read_table(spark, sf, "events").where("value is not null")
    # the middle elements by counting values, so no group is gathered
    per_value = rows.groupBy("event_type", "value").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("event_type").orderBy("value"))
    total = F.sum("c").over(Window.partitionBy("event_type"))
    placed = per_value.withColumn("u", upto).withColumn("t", total)
    lower, upper = F.min(F.when(F.col("u") >= F.floor((F.col("t") + 1) / 2), F.col("value"))), F.min(F.when(F.col("u") > F.floor(F.col("t") / 2), F.col("value")))
    return placed.groupBy("event_type").agg(F.round((lower + upper) / 2, 6).alias("median"), upper.alias("upper_median"))


@register("AGG-07", "SELECT source_title, count(*) AS n FROM chunks GROUP BY 1 ORDER BY n DESC, source_title NULLS LAST LIMIT 10")
def most_common(spark, sf):
    return read_table(spark, sf, "chunks").groupBy("source_title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("source_title")).limit(10)


@register("AGG-08", "SELECT count(*) AS rows, count(*) FILTER (WHERE text IS NULL) AS no_text, count(*) FILTER (WHERE trim(text) = '') AS blank, count(*) FILTER (WHERE length(text) < 20) AS short, count(*) FILTER (WHERE image_path IS NOT NULL) AS with_image, count(*) FILTER (WHERE source_id IS NULL) AS no_source FROM chunks")
def conditional(spark, sf):
    c = lambda e, n: F.count_if(F.expr(e)).alias(n)
    return read_table(spark, sf, "chunks").agg(
        F.count("*").alias("rows"), c("text is null", "no_text"), c("trim(text) = ''", "blank"), c("char_length(text) < 20", "short"), c("image_path is not null", "with_image"), c("source_id is null", "no_source")
    )


@register("AGG-09", "SELECT l_shipmode_kind, l_returnflag, count(*) AS n FROM (SELECT CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'small' END AS l_shipmode_kind, l_returnflag FROM lineitem) GROUP BY GROUPING SETS ((l_shipmode_kind, l_returnflag), (l_shipmode_kind), ())")
def breakdowns(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(F.when(F.col("l_quantity") > 25, "bulk").otherwise("small").alias("l_shipmode_kind"), "l_returnflag")
    return rows.rollup("l_shipmode_kind", "l_returnflag").agg(F.count("*").alias("n"))


@register("AGG-10", "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup(spark, sf):
    place = read_table(spark, sf, "nation").join(read_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read_table(spark, sf, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@register("AGG-11", "SELECT source, round(100.0 * count(*) FILTER (WHERE doi IS NOT NULL) / nullif(count(*) FILTER (WHERE pub_year <> ''), 0), 2) AS rate FROM journal_virchows GROUP BY source")
def rates(spark, sf):
    return read_table(spark, sf, "journal_virchows").groupBy("source").agg(F.round(F.try_divide(100.0 * F.count_if(F.col("doi").isNotNull()), F.count_if(F.col("pub_year") != "")), 2).alias("rate"))


@register("AGG-12", "WITH r AS (SELECT primary_tag, record_id, ingested_at, row_number() OVER (PARTITION BY primary_tag ORDER BY record_id, ingested_at) AS n FROM records WHERE primary_tag IS NOT NULL) SELECT primary_tag, count(*) AS n, string_agg(record_id, ',' ORDER BY record_id, ingested_at) FILTER (WHERE n <= 3) AS examples FROM r GROUP BY 1")
def bounded_collect(spark, sf):
    rows = read_table(spark, sf, "records").where("primary_tag is not null")
    n = F.row_number().over(Window.partitionBy("primary_tag").orderBy("record_id", "ingested_at"))
    some = rows.withColumn("n", n).where("n <= 3").groupBy("primary_tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "record_id"))), lambda x: x["record_id"]), ",").alias("examples"))
    return rows.groupBy("primary_tag").agg(F.count("*").alias("n")).join(some, "primary_tag")


@register("AGG-14", "SELECT tag_root, sum(CASE source WHEN 'textbooks' THEN 5 WHEN 'lectures' THEN 4 WHEN 'pathout' THEN 3 ELSE 1 END)::BIGINT AS weight FROM records GROUP BY 1")
def source_weights(spark, sf):
    w = F.when(F.col("source") == "textbooks", 5).when(F.col("source") == "lectures", 4).when(F.col("source") == "pathout", 3).otherwise(1)
    return read_table(spark, sf, "records").groupBy("tag_root").agg(F.sum(w).alias("weight"))


@register("AGG-15", "SELECT source_family, source, count(*) AS n FROM gi_crc_standalone GROUP BY GROUPING SETS ((source_family), (source), ())")
def grouping_sets(spark, sf):
    rows = read_table(spark, sf, "gi_crc_standalone")
    return rows.groupingSets([["source_family"], ["source"], []], "source_family", "source").agg(F.count("*").alias("n")).select("source_family", "source", "n")


@register("AGG-16", "WITH g AS (SELECT record_id, count(*) AS n FROM records GROUP BY record_id HAVING count(*) > 1) SELECT count(*) AS groups, sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS surplus FROM g")
def duplicates(spark, sf):
    groups = read_table(spark, sf, "records").groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("surplus"))


@register("AGG-17", "SELECT source_id, arg_min(chapter_title, (ingested_at, chunk_id)) AS first_chapter, arg_max(chapter_title, (ingested_at, chunk_id)) AS last_chapter FROM chunks WHERE chapter_title IS NOT NULL GROUP BY source_id")
def first_last(spark, sf):
    rows = read_table(spark, sf, "chunks").where("chapter_title is not null")
    order = F.struct("ingested_at", "chunk_id")
    return rows.groupBy("source_id").agg(F.min_by("chapter_title", order).alias("first_chapter"), F.max_by("chapter_title", order).alias("last_chapter"))


@register("AGG-18", "SELECT source, sum(len(coalesce(try_cast(candidate_tags AS JSON)::VARCHAR[], [])))::BIGINT AS tags FROM (SELECT source_id AS source, candidate_tags FROM chunks) GROUP BY source")
def tag_totals(spark, sf):
    return read_table(spark, sf, "chunks").groupBy(F.col("source_id").alias("source")).agg(F.sum(F.size(T.json_list(F.col("candidate_tags")))).alias("tags"))


@register("AGG-20", "SELECT entity_name, count(DISTINCT volume_code) AS volumes FROM gi_crc_standalone WHERE entity_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT volume_code) > 1")
def several_volumes(spark, sf):
    return read_table(spark, sf, "gi_crc_standalone").where("entity_name is not null").groupBy("entity_name").agg(F.countDistinct("volume_code").alias("volumes")).where("volumes > 1")


@register("AGG-21", "SELECT count(*) AS total, count(primary_tag) AS tagged, count(*) FILTER (WHERE indexable) AS indexable, count(DISTINCT primary_tag) AS tags, count(DISTINCT package_id) AS packages FROM segments_indexable")
def manifest(spark, sf):
    return read_table(spark, sf, "segments_indexable").agg(
        F.count("*").alias("total"), F.count("primary_tag").alias("tagged"), F.count_if("indexable").alias("indexable"), F.countDistinct("primary_tag").alias("tags"), F.countDistinct("package_id").alias("packages")
    )


@register("AGG-22", "SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT title) AS titles FROM documents GROUP BY lang")
def exact_distinct(spark, sf):
    return read_table(spark, sf, "documents").groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.countDistinct("title").alias("titles"))


@register("TOP-03", "SELECT chunk_id, ingested_at, fusion_score FROM journal_virchows ORDER BY fusion_score DESC NULLS LAST, fts_rank NULLS LAST, vector_rank NULLS LAST, chunk_id, ingested_at LIMIT 20")
def fused_order(spark, sf):
    order = [F.desc_nulls_last("fusion_score"), F.asc_nulls_last("fts_rank"), F.asc_nulls_last("vector_rank"), F.col("chunk_id"), F.col("ingested_at")]
    return read_table(spark, sf, "journal_virchows").orderBy(*order).limit(20).select("chunk_id", "ingested_at", "fusion_score")


@register("TOP-04", "SELECT primary_tag, count(*) AS n FROM records WHERE primary_tag IS NOT NULL GROUP BY 1 ORDER BY n DESC, primary_tag DESC LIMIT 10")
def node_order(spark, sf):
    return read_table(spark, sf, "records").where("primary_tag is not null").groupBy("primary_tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("primary_tag")).limit(10)


@register("TOP-05", "SELECT record_id, ingested_at, round(score + CASE WHEN contains(lower(entity_name), 'adenoma') THEN 2 ELSE 0 END, 6) AS combined FROM gi_crc_standalone ORDER BY combined DESC NULLS LAST, record_id, ingested_at LIMIT 15")
def reranked(spark, sf):
    combined = F.round(F.col("score") + F.when(F.contains(F.lower("entity_name"), F.lit("adenoma")), 2).otherwise(0), 6)
    return read_table(spark, sf, "gi_crc_standalone").select("record_id", "ingested_at", combined.alias("combined")).orderBy(F.desc_nulls_last("combined"), "record_id", "ingested_at").limit(15)


@register("TOP-06", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page(spark, sf):
    return read_table(spark, sf, "orders").where("o_orderstatus = 'F'").orderBy("o_orderdate", F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_totalprice")


@register("TOP-08", "SELECT record_id, ingested_at, status FROM curriculum_records ORDER BY CASE status WHEN 'approved' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, fuzzy_score DESC NULLS LAST, record_id, ingested_at LIMIT 40")
def queue(spark, sf):
    rank = F.when(F.col("status") == "approved", 0).when(F.col("status") == "review", 1).otherwise(2)
    return read_table(spark, sf, "curriculum_records").orderBy(rank, F.desc_nulls_last("fuzzy_score"), "record_id", "ingested_at").limit(40).select("record_id", "ingested_at", "status")


@register("TOP-09", "SELECT source, record_id, ingested_at FROM gi_crc_standalone QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC NULLS LAST, record_id, ingested_at) <= 8")
def shown(spark, sf):
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc_nulls_last("score"), "record_id", "ingested_at"))
    return read_table(spark, sf, "gi_crc_standalone").withColumn("n", n).where("n <= 8").select("source", "record_id", "ingested_at")


@register("TOP-10", "WITH w AS (SELECT tag_id, string_split(lower(string_split(primary_tag, '::')[-1]), '_') AS w FROM canonical_tags) SELECT tag_id, array_to_string(list_slice(list_transform(list_sort(list_transform(w, lambda x: {'l': -length(x), 'x': x})), lambda s: s.x), 1, 2), ' ') AS longest FROM w")
def longest_first(spark, sf):
    words = F.split(F.lower(T.tag_part(F.col("primary_tag"), -1)), "_")
    ordered = F.transform(F.array_sort(F.transform(words, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("x")))), lambda s: s["x"])
    return read_table(spark, sf, "canonical_tags").select("tag_id", F.array_join(F.slice(ordered, 1, 2), " ").alias("longest"))


@register("SET-01", "SELECT key, arg_min(title, pass) AS title, min(pass)::INT AS pass FROM (SELECT record_id AS key, min(title) AS title, 1 AS pass FROM records GROUP BY 1 UNION ALL SELECT record_id, min(title), 2 FROM tag_records GROUP BY 1) GROUP BY key")
def preferred_union(spark, sf):
    part = lambda t, p: read_table(spark, sf, t).groupBy(F.col("record_id").alias("key")).agg(F.min("title").alias("title")).withColumn("pass", F.lit(p))
    return part("records", 1).unionByName(part("tag_records", 2)).groupBy("key").agg(F.min_by("title", "pass").alias("title"), F.min("pass").alias("pass"))


@register("SET-02", "SELECT record_id, max(CASE status WHEN 'approved' THEN 3 WHEN 'review' THEN 2 ELSE 1 END)::INT AS precedence, bool_or(visible) AS visible, count(*) AS n FROM curriculum_records GROUP BY 1")
def outcome_union(spark, sf):
    p = F.when(F.col("status") == "approved", 3).when(F.col("status") == "review", 2).otherwise(1)
    return read_table(spark, sf, "curriculum_records").groupBy("record_id").agg(F.max(p).alias("precedence"), F.bool_or("visible").alias("visible"), F.count("*").alias("n"))


@register("SET-03", "SELECT tag, CASE WHEN count(DISTINCT side) > 1 THEN 'both' ELSE min(side) END AS provenance FROM (SELECT primary_tag AS tag, 'list' AS side FROM canonical_tags UNION ALL SELECT primary_tag, 'records' FROM records WHERE primary_tag IS NOT NULL) GROUP BY tag")
def provenance_union(spark, sf):
    a = read_table(spark, sf, "canonical_tags").select(F.col("primary_tag").alias("tag"), F.lit("list").alias("side"))
    b = read_table(spark, sf, "records").where("primary_tag is not null").select(F.col("primary_tag").alias("tag"), F.lit("records").alias("side"))
    return a.unionByName(b).groupBy("tag").agg(F.when(F.min("side") != F.max("side"), "both").otherwise(F.min("side")).alias("provenance"))


@register("SET-04", "SELECT lower(tag) AS key, min(tag) AS tag, count(*) AS n FROM (SELECT primary_tag AS tag FROM canonical_tags UNION ALL SELECT primary_tag FROM tag_records WHERE primary_tag IS NOT NULL) GROUP BY 1")
def case_union(spark, sf):
    tags = read_table(spark, sf, "canonical_tags").select("primary_tag").unionByName(read_table(spark, sf, "tag_records").where("primary_tag is not null").select("primary_tag"))
    return tags.groupBy(F.lower("primary_tag").alias("key")).agg(F.min("primary_tag").alias("tag"), F.count("*").alias("n"))


@register("SET-05", "WITH m AS (SELECT doc_id, regexp_extract_all(text, 'marker [A-Z0-9-]+') AS m FROM documents) SELECT doc_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ',') AS markers FROM m")
def ordered_unique(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.array_join(F.array_distinct(F.regexp_extract_all("text", F.lit("marker [A-Z0-9-]+"), F.lit(0))), ",").alias("markers"))


@register("SET-06", "SELECT key, arg_min(chunk_id, (p, chunk_id, ingested_at)) AS chunk_id FROM (SELECT coalesce(nullif(doi, ''), nullif(lower(trim(title)), '')) AS key, CASE WHEN section = 'abstract' THEN 0 ELSE 1 END AS p, chunk_id, ingested_at FROM journal_virchows) WHERE key IS NOT NULL GROUP BY key")
def article_dedupe(spark, sf):
    key = F.coalesce(F.nullif("doi", F.lit("")), F.nullif(F.lower(F.trim("title")), F.lit("")))
    rows = read_table(spark, sf, "journal_virchows").select(key.alias("key"), F.when(F.col("section") == "abstract", 0).otherwise(1).alias("p"), "chunk_id", "ingested_at").where("key is not null")
    return first_per_key(rows, ["key"], [F.col("p"), F.col("chunk_id"), F.col("ingested_at")]).select("key", "chunk_id")


@register("SET-07", "WITH w AS (SELECT record_id, ingested_at, list_distinct(list_filter(string_split(lower(title), ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(lower(excerpt), ' '), lambda x: x <> '')) AS b FROM tag_records_x) SELECT record_id, ingested_at, len(list_intersect(a, b)) AS common, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a FROM w".replace("tag_records_x", "records WHERE title IS NOT NULL AND excerpt IS NOT NULL"))
def set_algebra(spark, sf):
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda x: x != ""))
    rows = read_table(spark, sf, "records").where("title is not null and excerpt is not null").select("record_id", "ingested_at", words("title").alias("a"), words("excerpt").alias("b"))
    return rows.select("record_id", "ingested_at", F.size(F.array_intersect("a", "b")).cast("bigint").alias("common"), F.size(F.array_except("a", "b")).cast("bigint").alias("only_a"))


@register("SET-08", "SELECT record_id, title, primary_tag, NULL::INT AS fuzzy_score FROM tag_records UNION ALL SELECT record_id, title, NULL, fuzzy_score FROM curriculum_records")
def append(spark, sf):
    a = read_table(spark, sf, "tag_records").select("record_id", "title", "primary_tag")
    return a.unionByName(read_table(spark, sf, "curriculum_records").select("record_id", "title", "fuzzy_score"), allowMissingColumns=True)


@register("SET-11", "SELECT DISTINCT doi FROM journal_virchows WHERE doi IS NOT NULL AND hit_rank > 5 AND doi NOT IN (SELECT doi FROM journal_virchows WHERE hit_rank <= 5 AND doi IS NOT NULL)")
def new_only(spark, sf):
    rows = read_table(spark, sf, "journal_virchows").where("doi is not null").select("doi", "hit_rank")
    return rows.where("hit_rank > 5").select("doi").distinct().join(rows.where("hit_rank <= 5").select("doi"), "doi", "left_anti")


@register("ORC-07", "SELECT coalesce(nullif(journal, ''), source_name, 'unknown') AS journal, count(*) AS n, count(DISTINCT lower(doi)) AS dois, count(DISTINCT lower(title)) AS titles FROM journal_virchows GROUP BY 1")
def inventory(spark, sf):
    name = F.coalesce(F.nullif("journal", F.lit("")), "source_name", F.lit("unknown"))
    return read_table(spark, sf, "journal_virchows").groupBy(name.alias("journal")).agg(F.count("*").alias("n"), F.countDistinct(F.lower("doi")).alias("dois"), F.countDistinct(F.lower("title")).alias("titles"))


@register("ORC-10", "SELECT segment_id, ingested_at, start_sec + greatest(coalesce(end_sec - start_sec, 0), 0.01) AS end_sec FROM segments_indexable WHERE trim(text) <> ''")
def captions(spark, sf):
    span = F.greatest(F.coalesce(F.col("end_sec") - F.col("start_sec"), F.lit(0.0)), F.lit(0.01))
    return read_table(spark, sf, "segments_indexable").where("trim(text) <> ''").select("segment_id", "ingested_at", (F.col("start_sec") + span).alias("end_sec"))


@register("DOC-01", "SELECT tag_root, count(*) AS n_leaves, count(DISTINCT string_split(primary_tag, '::')[2]) AS n_groups, string_agg(primary_tag, ',' ORDER BY primary_tag) AS leaves FROM canonical_tags GROUP BY tag_root")
def tree(spark, sf):
    rows = read_table(spark, sf, "canonical_tags")
    return rows.groupBy("tag_root").agg(F.count("*").alias("n_leaves"), F.countDistinct(T.tag_part(F.col("primary_tag"), 2)).alias("n_groups"), F.array_join(F.array_sort(F.collect_list("primary_tag")), ",").alias("leaves"))


@register("DOC-02", "SELECT path, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '::'))) AS path FROM (SELECT string_split(primary_tag, '::') AS p FROM canonical_tags)) GROUP BY path")
def path_tree(spark, sf):
    return read_table(spark, sf, "canonical_tags").select(F.explode(T.tag_prefixes(F.col("primary_tag"))).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


@register("DOC-03", "SELECT tag_id FROM canonical_tags t WHERE tag_root = 'Cyto' AND NOT EXISTS (SELECT 1 FROM canonical_tags o WHERE o.tag_root <> 'Cyto' AND string_split(o.primary_tag, '::')[-1] = string_split(t.primary_tag, '::')[-1])")
def hide_aliases(spark, sf):
    rows = read_table(spark, sf, "canonical_tags").withColumn("leaf", T.tag_part(F.col("primary_tag"), -1))
    return rows.where("tag_root = 'Cyto'").join(rows.where("tag_root <> 'Cyto'").select("leaf"), "leaf", "left_anti").select("tag_id")


@register("EVL-01", "SELECT e.entity_id, count(*) AS hits FROM canonical_entities e JOIN gi_crc_standalone g ON contains(lower(g.entity_name), lower(e.entity_name)) GROUP BY 1")
def expected_hits(spark, sf):
    entities = read_table(spark, sf, "canonical_entities").select("entity_id", F.lower("entity_name").alias("e"))  # a fixed list
    rows = read_table(spark, sf, "gi_crc_standalone").where("entity_name is not null").groupBy(F.lower("entity_name").alias("v")).agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(entities), F.contains("v", F.col("e"))).groupBy("entity_id").agg(F.sum("n").alias("hits"))


@register("EVL-05", "SELECT record_id, array_to_string(list_sort(list_distinct(list(u))), ',') AS urls FROM (SELECT record_id, url AS u FROM records WHERE url LIKE 'https://%' UNION ALL SELECT record_id, source_url FROM gi_crc_standalone WHERE source_url LIKE 'https://%') GROUP BY record_id")
def url_inventory(spark, sf):
    a = read_table(spark, sf, "records").select("record_id", F.col("url").alias("u"))
    b = read_table(spark, sf, "gi_crc_standalone").select("record_id", F.col("source_url").alias("u"))
    both = a.unionByName(b).where(F.col("u").startswith("https://"))
    return both.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("u")), ",").alias("urls"))
