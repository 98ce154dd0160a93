"""Named queries on joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.joins import fallback_join, first_per_key, inherit_last, merge_sides
from tessera.plans.registry import Registry
from tessera.sources.tables import read_table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


@register("JN-01", "SELECT o_orderkey, o_orderpriority, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45")
def inner(spark, sf):
    lines = read_table(spark, sf, "lineitem").where("l_quantity > 45")
    return read_table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderpriority", "l_linenumber", "l_quantity")


@register(
    "JN-02",
    """WITH a AS (SELECT chunk_id, min(title) AS title, min(bm25_score) AS score FROM journal_virchows WHERE fts_rank IS NOT NULL GROUP BY chunk_id), b AS (SELECT chunk_id, min(title) AS title, max(vector_score) AS score FROM journal_virchows WHERE vector_rank IS NOT NULL GROUP BY chunk_id)
       SELECT chunk_id, coalesce(b.title, a.title) AS title, coalesce(b.score, a.score) AS score, a.chunk_id IS NOT NULL AS in_a, b.chunk_id IS NOT NULL AS in_b FROM a FULL JOIN b USING (chunk_id)""",
)
def merged(spark, sf):
    rows = read_table(spark, sf, "journal_virchows")
    a = rows.where("fts_rank is not null").groupBy("chunk_id").agg(F.min("title").alias("title"), F.min("bm25_score").alias("score"))
    b = rows.where("vector_rank is not null").groupBy("chunk_id").agg(F.min("title").alias("title"), F.max("vector_score").alias("score"))
    return merge_sides(a, b, "chunk_id", ["title", "score"])


_ARTICLE = "coalesce(nullif(doi, ''), nullif(source_url, ''), nullif(lower(title), ''), sha256(coalesce(excerpt, '')))"


@register("JN-03", f"SELECT {_ARTICLE} AS article_key, count(*) AS n, min(journal) AS journal FROM journal_virchows GROUP BY 1")
def article_keys(spark, sf):
    key = F.coalesce(F.nullif("doi", F.lit("")), F.nullif("source_url", F.lit("")), F.nullif(F.lower("title"), F.lit("")), F.sha2(F.coalesce("excerpt", F.lit("")), 256))
    return read_table(spark, sf, "journal_virchows").groupBy(key.alias("article_key")).agg(F.count("*").alias("n"), F.min("journal").alias("journal"))


@register(
    "JN-04",
    """WITH r AS (SELECT *, json_extract_string(locator_json, '$.source_id') AS sid FROM records),
            a AS (SELECT source, tag_root, arg_min(url, (record_id, ingested_at)) AS url FROM r WHERE source IS NOT NULL AND tag_root IS NOT NULL AND url <> '' GROUP BY ALL),
            b AS (SELECT source, arg_min(url, (record_id, ingested_at)) AS url FROM r WHERE source IS NOT NULL AND url <> '' GROUP BY ALL)
       SELECT c.record_id, c.ingested_at, coalesce(a.url, b.url) AS url, CASE WHEN a.url IS NOT NULL THEN 1 WHEN b.url IS NOT NULL THEN 2 END AS matched_by
       FROM curriculum_records c LEFT JOIN a ON a.source = c.source AND a.tag_root = c.root LEFT JOIN b ON b.source = c.source""",
)
def by_fallback(spark, sf):
    right = read_table(spark, sf, "records").where("url <> ''").select("source", "tag_root", "url", "record_id", "ingested_at")
    left = read_table(spark, sf, "curriculum_records").select("record_id", "ingested_at", "source", "root")
    out = fallback_join(left, right, [[("source", "source"), ("root", "tag_root")], [("source", "source")]], ["url"], [F.col("record_id"), F.col("ingested_at")])
    return out.select("record_id", "ingested_at", "url", "matched_by")


@register(
    "JN-05",
    """WITH i AS (SELECT source_id, floor(try_cast(page AS DOUBLE))::BIGINT AS p, min(image_path) AS image FROM chunks WHERE image_path IS NOT NULL AND source_id IS NOT NULL GROUP BY ALL HAVING p IS NOT NULL)
       SELECT c.chunk_id, c.ingested_at, i.image, coalesce(CASE WHEN i.p IS NOT NULL THEN 'audited' END, 'not_audited') AS status FROM chunks c LEFT JOIN i ON c.source_id = i.source_id AND floor(try_cast(c.page AS DOUBLE))::BIGINT = i.p""",
)
def page_images(spark, sf):
    rows = read_table(spark, sf, "chunks").withColumn("p", T.loose_int(F.col("page")))
    images = rows.where("image_path is not null and source_id is not null and p is not null").groupBy("source_id", "p").agg(F.min("image_path").alias("image"))
    return rows.join(images, ["source_id", "p"], "left").select("chunk_id", "ingested_at", "image", F.when(F.col("image").isNotNull(), "audited").otherwise("not_audited").alias("status"))


@register(
    "JN-06",
    """WITH t AS (SELECT source_id, page, arg_min(candidate_tags, (chunk_id, ingested_at)) AS tags FROM chunks WHERE candidate_tags <> '[]' AND source_id IS NOT NULL AND page IS NOT NULL GROUP BY ALL)
       SELECT c.chunk_id, c.ingested_at, coalesce(CASE WHEN c.candidate_tags <> '[]' THEN c.candidate_tags END, t.tags, '__UNMAPPED__') AS tags FROM chunks c LEFT JOIN t ON t.source_id = c.source_id AND t.page = c.page""",
)
def tag_sidecar(spark, sf):
    rows = read_table(spark, sf, "chunks").select("chunk_id", "ingested_at", "source_id", "page", "candidate_tags")
    by_page = first_per_key(rows.where("candidate_tags <> '[]' and source_id is not null and page is not null"), ["source_id", "page"], [F.col("chunk_id"), F.col("ingested_at")])
    joined = rows.join(by_page.select("source_id", "page", F.col("candidate_tags").alias("t")), ["source_id", "page"], "left")
    return joined.select("chunk_id", "ingested_at", F.coalesce(F.when(F.col("candidate_tags") != "[]", F.col("candidate_tags")), "t", F.lit("__UNMAPPED__")).alias("tags"))


@register(
    "JN-07",
    """WITH hits AS (SELECT chunk_id, source_id, page, image_path FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1),
            own AS (SELECT chunk_id, image_path AS img, 1 AS pass FROM hits WHERE image_path IS NOT NULL), page AS (SELECT h.chunk_id, f.image_path AS img, 2 AS pass FROM hits h JOIN hits f ON f.source_id = h.source_id AND f.page = h.page WHERE f.image_path IS NOT NULL),
            u AS (SELECT chunk_id, img, min(pass) AS pass FROM (SELECT * FROM own UNION ALL SELECT * FROM page) GROUP BY ALL)
       SELECT chunk_id, img AS image_path, pass FROM u QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY pass, img) <= 3""",
)
def figures_of_hits(spark, sf):
    from pyspark.sql import Window

    from tessera.operators.current import current_rows

    hits = current_rows(read_table(spark, sf, "chunks"), "chunk_id", ["source_id", "page", "image_path"])
    figures = hits.where("image_path is not null")
    # a hit needs the first three figures of its page besides its own, so a page brings four, however many hits it has
    first = F.row_number().over(Window.partitionBy("source_id", "page").orderBy("img"))
    each = figures.where("source_id is not null and page is not null").select("source_id", "page", F.col("image_path").alias("img")).distinct()
    pages = each.withColumn("n", first).where("n <= 4").groupBy("source_id", "page").agg(F.sort_array(F.collect_list("img")).alias("imgs"))
    own = F.when(F.col("image_path").isNotNull(), F.array("image_path")).otherwise(F.array().cast("array<string>"))
    others = F.array_except(F.coalesce("imgs", F.array().cast("array<string>")), own)
    chosen = hits.join(pages, ["source_id", "page"], "left").select("chunk_id", F.size(own).alias("k"), F.posexplode(F.slice(F.concat(own, others), 1, 3)).alias("n", "image_path"))
    return chosen.select("chunk_id", "image_path", F.when(F.col("n") < F.col("k"), 1).otherwise(2).alias("pass"))


@register("JN-09", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi(spark, sf):
    big = read_table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return read_table(spark, sf, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@register("JN-10", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def two_sidecars(spark, sf):
    nation = read_table(spark, sf, "nation").join(read_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return read_table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@register(
    "JN-12",
    "SELECT 'tag' AS side, primary_tag AS value FROM canonical_tags t WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.primary_tag = t.primary_tag) UNION ALL SELECT DISTINCT 'record', primary_tag FROM records r WHERE primary_tag IS NOT NULL AND NOT EXISTS (SELECT 1 FROM canonical_tags t WHERE r.primary_tag = t.primary_tag)",
)
def both_unmatched(spark, sf):
    known, used = read_table(spark, sf, "canonical_tags").select("primary_tag"), read_table(spark, sf, "records").where("primary_tag is not null").select("primary_tag").distinct()
    side = lambda a, b, name: a.join(b, "primary_tag", "left_anti").select(F.lit(name).alias("side"), F.col("primary_tag").alias("value"))
    return side(known, used, "tag").unionByName(side(used, known, "record"))


@register(
    "JN-13",
    """WITH v AS (SELECT DISTINCT lower(entity_name) AS v, nullif(regexp_extract(lower(entity_name), '[a-z0-9]+'), '') AS b FROM gi_crc_standalone WHERE nullif(trim(entity_name), '') IS NOT NULL),
            e AS (SELECT entity_id, lower(entity_name) AS e, nullif(regexp_extract(lower(entity_name), '[a-z0-9]+'), '') AS b FROM canonical_entities),
            p AS (SELECT v, e, entity_id FROM v JOIN e USING (b) UNION ALL SELECT v, e, entity_id FROM v CROSS JOIN e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.b = v.b)),
            c AS (SELECT v, entity_id, round(1 - levenshtein(v, e) / greatest(length(v), length(e)), 6) AS s FROM p)
       SELECT v AS value, entity_id, s AS similarity FROM c WHERE s >= 0.8 QUALIFY row_number() OVER (PARTITION BY v ORDER BY s DESC, entity_id) = 1""",
)
def blocked_edit_join(spark, sf):
    from tessera.operators.fuzzy import blocked_best

    values = read_table(spark, sf, "gi_crc_standalone").select(F.lower("entity_name").alias("value")).where(T.present(F.col("value")).isNotNull()).distinct()
    entries = read_table(spark, sf, "canonical_entities").select("entity_id", F.lower("entity_name").alias("entry"))
    return blocked_best(values, entries, "value", "entry", "entity_id", lambda c: F.nullif(F.regexp_extract(c, "[a-z0-9]+", 0), F.lit("")), 0.8)


@register("JN-16", "SELECT r.record_id, r.ingested_at, t.tag_id FROM records r LEFT JOIN canonical_tags t ON replace(lower(r.primary_tag), ' ', '_') = lower(t.primary_tag) WHERE r.primary_tag IS NOT NULL")
def distinct_then_back(spark, sf):
    rows = read_table(spark, sf, "records").where("primary_tag is not null").select("record_id", "ingested_at", "primary_tag")
    tags = read_table(spark, sf, "canonical_tags").select("tag_id", F.lower("primary_tag").alias("k"))
    matched = rows.select("primary_tag").distinct().withColumn("k", F.replace(F.lower("primary_tag"), F.lit(" "), F.lit("_"))).join(tags, "k").select("primary_tag", "tag_id")
    return rows.join(matched, "primary_tag", "left").select("record_id", "ingested_at", "tag_id")


@register(
    "JN-20",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label, list_transform(range(1, 65), lambda i: 0.0) AS z, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
            s AS (SELECT e.vec_id, c.label, list_dot_product(e.v, (SELECT v FROM e x WHERE x.vec_id = c.vec_id)) AS s FROM e CROSS JOIN c)
       SELECT vec_id, arg_max(label, (round(s, 6), -label)) AS label, round(max(s), 6) AS score FROM s GROUP BY vec_id""",
)
def windows_by_leaves(spark, sf):
    from tessera.operators.vector import closest_entries

    rows = read_table(spark, sf, "embeddings")
    leaves = first_per_key(rows, ["label"], [F.col("vec_id")]).select("label", "embedding")
    return closest_entries(rows, "vec_id", "embedding", leaves, "label", 1).select("vec_id", "label", "score")


@register("JN-21", "SELECT entity_id, query_type, figures FROM canonical_entities CROSS JOIN (SELECT unnest(['name', 'abbreviation', 'organ']) AS query_type) CROSS JOIN (SELECT unnest([true, false]) AS figures) WHERE query_type <> 'abbreviation' OR abbreviation IS NOT NULL")
def grid(spark, sf):
    rows = read_table(spark, sf, "canonical_entities")
    kinds = F.explode(F.array(*(F.lit(x) for x in ("name", "abbreviation", "organ")))).alias("query_type")
    return rows.select("entity_id", "abbreviation", kinds).where("query_type <> 'abbreviation' or abbreviation is not null").select("entity_id", "query_type", F.explode(F.array(F.lit(True), F.lit(False))).alias("figures"))


@register(
    "JN-22",
    """WITH w AS (SELECT DISTINCT tag_id, tag_root, unnest(string_split(lower(string_split(primary_tag, '::')[-1]), '_')) AS w FROM canonical_tags)
       SELECT a.tag_id, b.w AS word, count(*) AS n FROM (SELECT DISTINCT tag_id, tag_root FROM w) a JOIN w b ON a.tag_root = b.tag_root AND a.tag_id <> b.tag_id WHERE NOT EXISTS (SELECT 1 FROM w o WHERE o.tag_id = a.tag_id AND o.w = b.w) GROUP BY ALL""",
)
def siblings(spark, sf):
    words = read_table(spark, sf, "canonical_tags").select("tag_id", "tag_root", F.explode(F.split(F.lower(T.tag_part(F.col("primary_tag"), -1)), "_")).alias("word")).distinct()
    # words counted per root first, so the self join meets one row per root and word
    per_root = words.groupBy("tag_root", "word").agg(F.count("*").alias("n"))
    pairs = words.select("tag_id", "tag_root").distinct().join(per_root, "tag_root")
    return pairs.join(words.select("tag_id", "word"), ["tag_id", "word"], "left_anti").select("tag_id", "word", "n")


@register(
    "JN-23",
    "SELECT chunk_id, ingested_at, CASE WHEN image_path IN (SELECT DISTINCT image_path FROM chunks WHERE chapter_number = 16 AND image_path IS NOT NULL) THEN NULL ELSE image_path END AS image_path FROM chunks",
)
def repaired(spark, sf):
    rows = read_table(spark, sf, "chunks")
    gone = rows.where("chapter_number = 16 and image_path is not null").select("image_path").distinct().withColumn("gone", F.lit(True))
    return rows.join(gone, "image_path", "left").select("chunk_id", "ingested_at", F.when(F.col("gone").isNull(), F.col("image_path")).alias("image_path"))


@register(
    "JN-24",
    "WITH bad AS (SELECT record_id, url FROM tag_records WHERE primary_tag LIKE 'GI::%') SELECT record_id, ingested_at FROM tag_records t WHERE record_id IN (SELECT record_id FROM bad WHERE record_id IS NOT NULL) OR url IN (SELECT url FROM bad WHERE url IS NOT NULL)",
)
def any_key(spark, sf):
    rows = read_table(spark, sf, "tag_records").select("record_id", "url", "primary_tag", "ingested_at")
    bad = rows.where(F.col("primary_tag").startswith("GI::"))
    ids, urls = bad.select("record_id").dropna().distinct().withColumn("a", F.lit(1)), bad.select("url").dropna().distinct().withColumn("b", F.lit(1))
    return rows.join(ids, "record_id", "left").join(urls, "url", "left").where("a is not null or b is not null").select("record_id", "ingested_at")


@register(
    "JN-26",
    """WITH r AS (SELECT package_id, segment_id, start_sec, ingested_at, nullif(trim(primary_tag), '') AS tag, row_number() OVER (PARTITION BY package_id ORDER BY start_sec, segment_id, ingested_at) AS n FROM segments_indexable),
            l AS (SELECT *, last_value(CASE WHEN tag IS NOT NULL THEN {'v': tag, 'n': n, 'p': start_sec} END IGNORE NULLS) OVER (PARTITION BY package_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM r)
       SELECT segment_id, ingested_at, CASE WHEN tag IS NOT NULL THEN tag WHEN n - x.n <= 12 AND start_sec - x.p <= 600 THEN x.v END AS inherited, CASE WHEN tag IS NOT NULL THEN 'own' WHEN n - x.n <= 12 AND start_sec - x.p <= 600 THEN 'before' END AS inherited_from FROM l""",
)
def as_of(spark, sf):
    rows = read_table(spark, sf, "segments_indexable").select("package_id", "segment_id", "start_sec", "ingested_at", T.present(F.col("primary_tag")).alias("tag"))
    return inherit_last(rows, "package_id", ["start_sec", "segment_id", "ingested_at"], "start_sec", "tag", 12, 600).select("segment_id", "ingested_at", "inherited", "inherited_from")


@register(
    "JN-28",
    """WITH c AS (SELECT tag_root, source, count(*) AS n FROM records WHERE tag_root IN (SELECT tag_root FROM canonical_tags) GROUP BY ALL)
       SELECT t.tag_root, count(DISTINCT t.tag_id) AS n_tags, coalesce((SELECT string_agg(source || '=' || n, ',' ORDER BY source) FROM c WHERE c.tag_root = t.tag_root), '') AS by_source FROM canonical_tags t GROUP BY t.tag_root""",
)
def node_details(spark, sf):
    counts = read_table(spark, sf, "records").groupBy("tag_root", "source").agg(F.count("*").alias("n"))
    by_source = counts.where("source is not null").groupBy("tag_root").agg(F.array_join(F.array_sort(F.collect_list(F.concat("source", F.lit("="), F.col("n").cast("string")))), ",").alias("by_source"))
    nodes = read_table(spark, sf, "canonical_tags").groupBy("tag_root").agg(F.countDistinct("tag_id").alias("n_tags"))
    return nodes.join(by_source, "tag_root", "left").select("tag_root", "n_tags", F.coalesce("by_source", F.lit("")).alias("by_source"))


@register("JN-29", "SELECT t.tag_id, coalesce(min(r.url) FILTER (WHERE r.url <> ''), 'missing') AS page FROM canonical_tags t LEFT JOIN records r ON r.primary_tag = t.primary_tag GROUP BY t.tag_id")
def coverage(spark, sf):
    pages = read_table(spark, sf, "records").where("url <> ''").groupBy("primary_tag").agg(F.min("url").alias("page"))
    return read_table(spark, sf, "canonical_tags").join(pages, "primary_tag", "left").select("tag_id", F.coalesce("page", F.lit("missing")).alias("page"))


@register(
    "JN-30",
    "WITH p AS (SELECT tag_id, unnest(list_distinct(string_split(lower(string_split(primary_tag, '::')[-1]), '_'))) AS w FROM canonical_tags) SELECT a.tag_id AS a, b.tag_id AS b, count(*) AS shared FROM p a JOIN p b ON a.w = b.w AND a.tag_id < b.tag_id GROUP BY ALL HAVING count(*) >= 2",
)
def postings(spark, sf):
    words = read_table(spark, sf, "canonical_tags").select("tag_id", F.explode(F.array_distinct(F.split(F.lower(T.tag_part(F.col("primary_tag"), -1)), "_"))).alias("w"))
    a, b = words.withColumnRenamed("tag_id", "a"), words.withColumnRenamed("tag_id", "b")
    return a.join(b, "w").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where("shared >= 2")
