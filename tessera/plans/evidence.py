"""Named queries on result cards, enrichment, gates and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.similarity import sequence_ratio
from tessera.operators import sampling
from tessera.operators.current import current_rows
from tessera.operators.fuzzy import GENERIC, conservative_best, token_set_best
from tessera.plans.registry import Registry
from tessera.sources.tables import read_table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

_CARDS_SQL = """cards AS (
  SELECT 'textbooks' AS source, chunk_id AS id, coalesce(nullif(trim(section_heading), ''), nullif(trim(chapter_title), ''), 'untitled') AS title, NULL AS url, substr(text, 1, 200) AS excerpt, ingested_at FROM chunks
  UNION ALL SELECT 'journals', chunk_id, coalesce(nullif(trim(title), ''), 'untitled'), nullif(source_url, ''), substr(excerpt, 1, 200), ingested_at FROM journal_virchows
  UNION ALL SELECT 'entities', record_id, coalesce(nullif(trim(entity_name), ''), nullif(trim(title), ''), 'untitled'), nullif(source_url, ''), substr(excerpt, 1, 200), ingested_at FROM gi_crc_standalone)"""


def _cards(spark, sf, letters: int | None = 200):
    def part(table, source, ident, titles, url, text):
        title = F.coalesce(*(T.present(F.col(t)) for t in titles), F.lit("untitled"))
        link = F.nullif(url, F.lit("")) if url else F.lit(None).cast("string")
        return read_table(spark, sf, table).select(F.lit(source).alias("source"), F.col(ident).alias("id"), title.alias("title"), link.alias("url"), (F.substring(text, 1, letters) if letters else F.col(text)).alias("excerpt"), "ingested_at")

    return (
        part("chunks", "textbooks", "chunk_id", ["section_heading", "chapter_title"], None, "text")
        .unionByName(part("journal_virchows", "journals", "chunk_id", ["title"], "source_url", "excerpt"))
        .unionByName(part("gi_crc_standalone", "entities", "record_id", ["entity_name", "title"], "source_url", "excerpt"))
    )


@register("PRJ-01", f"WITH {_CARDS_SQL} SELECT * FROM cards")
def cards(spark, sf):
    return _cards(spark, sf)


@register("PRJ-06", f"WITH {_CARDS_SQL} SELECT source, count(*) AS cards, count(url) AS linked FROM cards GROUP BY source")
def card_counts(spark, sf):
    return _cards(spark, sf).groupBy("source").agg(F.count("*").alias("cards"), F.count("url").alias("linked"))


@register("PRJ-07", f"WITH {_CARDS_SQL}, r AS (SELECT source, id FROM cards QUALIFY row_number() OVER (PARTITION BY source ORDER BY id, ingested_at) <= 5) SELECT source, string_agg(id, ',' ORDER BY id) AS ids FROM r GROUP BY source")
def rebuilt(spark, sf):
    n = F.row_number().over(Window.partitionBy("source").orderBy("id", "ingested_at"))
    some = _cards(spark, sf).withColumn("n", n).where("n <= 5")
    return some.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


@register("PRJ-08", f"WITH {_CARDS_SQL.replace(', 1, 200)', ', 1)')} SELECT source, id, ingested_at, substr(excerpt, 1, 700) AS excerpt FROM cards QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(excerpt) DESC NULLS LAST, id, ingested_at) <= CASE source WHEN 'journals' THEN 10 ELSE 8 END")
def pinned(spark, sf):
    """Eight cards a source, ten of the literature, by the length of their whole texts, which are then cut."""
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc_nulls_last(F.char_length("excerpt")), "id", "ingested_at"))
    most = F.when(F.col("source") == "journals", 10).otherwise(8)
    return _cards(spark, sf, None).withColumn("n", n).where(F.col("n") <= most).select("source", "id", "ingested_at", F.substring("excerpt", 1, 700).alias("excerpt"))


@register("PRJ-10", "SELECT segment_id, ingested_at, 'Lecture ' || package_id || ' at ' || floor(start_sec)::BIGINT || 's: ' || text AS embed_text FROM segments_indexable WHERE video_url <> '' AND length(text) >= 40")
def vector_rows(spark, sf):
    text = F.concat(F.lit("Lecture "), "package_id", F.lit(" at "), F.floor("start_sec").cast("string"), F.lit("s: "), "text")
    return read_table(spark, sf, "segments_indexable").where("video_url <> '' and char_length(text) >= 40").select("segment_id", "ingested_at", text.alias("embed_text"))


@register("PRJ-12", "SELECT record_id, ingested_at, coalesce(entity_name, title) AS title, coalesce(score, 0) AS score, substr(excerpt, 1, 500) AS excerpt FROM gi_crc_standalone")
def flat_hits(spark, sf):
    return read_table(spark, sf, "gi_crc_standalone").select("record_id", "ingested_at", F.coalesce("entity_name", "title").alias("title"), F.coalesce("score", F.lit(0.0)).alias("score"), F.substring("excerpt", 1, 500).alias("excerpt"))


@register("PRJ-13", "SELECT 'gap:' || record_id || ':' || coalesce(candidate_tags, '') AS id, 'candidate' AS kind, source FROM curriculum_records")
def constant_columns(spark, sf):
    return read_table(spark, sf, "curriculum_records").select(F.concat(F.lit("gap:"), "record_id", F.lit(":"), F.coalesce("candidate_tags", F.lit(""))).alias("id"), F.lit("candidate").alias("kind"), "source")


@register("FLT-10", "SELECT doc_id, CASE WHEN contains(lower(text), 'carcinoma') THEN 'diagnosis' WHEN regexp_matches(text, 'marker [A-Z]+-[0-9]+') THEN 'marker' WHEN regexp_matches(lower(text), 'slide|section|block') THEN 'material' ELSE 'none' END AS signal FROM documents")
def signals(spark, sf):
    low = F.lower("text")
    why = F.when(F.contains(low, F.lit("carcinoma")), "diagnosis").when(F.col("text").rlike("marker [A-Z]+-[0-9]+"), "marker").when(low.rlike("slide|section|block"), "material").otherwise("none")
    return read_table(spark, sf, "documents").select("doc_id", why.alias("signal"))


@register("FLT-15", "SELECT chunk_id, ingested_at, text IS NULL OR length(trim(text)) < 40 OR regexp_matches(lower(text), 'table of contents|references|index of plates|see also') AS skip, CASE WHEN text IS NULL THEN 'empty' WHEN length(trim(text)) < 40 THEN 'short' WHEN regexp_matches(lower(text), 'table of contents|references|index of plates|see also') THEN 'furniture' END AS reason FROM chunks")
def do_not_index(spark, sf):
    why = F.when(F.col("text").isNull(), "empty").when(F.char_length(F.trim("text")) < 40, "short").when(F.lower("text").rlike("table of contents|references|index of plates|see also"), "furniture")
    return read_table(spark, sf, "chunks").select("chunk_id", "ingested_at", why.isNotNull().alias("skip"), why.alias("reason"))


@register("FLT-21", "SELECT tag_id FROM canonical_tags WHERE regexp_matches(primary_tag, '(oma|itis|plasia)$') AND NOT regexp_matches(string_split(primary_tag, '::')[-1], '^(Mixed|Other|Solid)') AND len(string_split(string_split(primary_tag, '::')[-1], '_')) >= 2")
def diagnosis_like(spark, sf):
    leaf = T.tag_part(F.col("primary_tag"), -1)
    return read_table(spark, sf, "canonical_tags").where(F.col("primary_tag").rlike("(oma|itis|plasia)$") & ~leaf.rlike("^(Mixed|Other|Solid)") & (F.size(F.split(leaf, "_")) >= 2)).select("tag_id")


@register("FLT-26", "WITH w AS (SELECT entity_id, unnest(list_filter(string_split(lower(entity_name), ' '), lambda t: t <> '')) AS w FROM canonical_entities) SELECT entity_id, w AS word FROM w WHERE length(w) >= 3 AND w NOT IN ('the', 'cell') AND w NOT IN (SELECT w FROM w GROUP BY w HAVING count(DISTINCT entity_id) > 40)")
def accepted_phrases(spark, sf):
    words = read_table(spark, sf, "canonical_entities").select("entity_id", F.explode(F.filter(F.split(F.lower("entity_name"), " "), lambda t: t != "")).alias("word"))
    common = words.groupBy("word").agg(F.countDistinct("entity_id").alias("n")).where("n > 40").select("word")
    return words.where((F.length("word") >= 3) & ~F.col("word").isin("the", "cell")).join(common, "word", "left_anti").select("entity_id", "word")


@register("JN-08", "WITH m AS (SELECT image_path, min('https://img.example/' || md5(image_path)) AS url FROM chunks WHERE figure_id IS NOT NULL AND image_path IS NOT NULL GROUP BY 1) SELECT chunk_id, ingested_at, coalesce(m.url, 'proxy:' || c.image_path) AS url, CASE WHEN m.url IS NOT NULL THEN 'public' ELSE 'proxy' END AS mode FROM chunks c LEFT JOIN m USING (image_path) WHERE c.image_path IS NOT NULL")
def public_urls(spark, sf):
    rows = read_table(spark, sf, "chunks").where("image_path is not null")
    urls = rows.where("figure_id is not null").groupBy("image_path").agg(F.min(F.concat(F.lit("https://img.example/"), F.md5("image_path"))).alias("u"))
    return rows.join(urls, "image_path", "left").select("chunk_id", "ingested_at", F.coalesce("u", F.concat(F.lit("proxy:"), "image_path")).alias("url"), F.when(F.col("u").isNotNull(), "public").otherwise("proxy").alias("mode"))


@register("JN-14")
def token_set_join(spark, sf):
    """Values with an entity whose token-set ratio is at least 90."""
    values = read_table(spark, sf, "gi_crc_standalone").select(T.normalize(F.col("entity_name")).alias("value"))
    entries = read_table(spark, sf, "canonical_entities").select("entity_id", T.normalize(F.col("entity_name")).alias("entry"))
    return token_set_best(values, entries, "value", "entry", "entity_id", 90)


@register("JN-15")
def best_match(spark, sf):
    """Tags of records and the list's tag that shares most, by exact slug, then shared words, scored by sequence ratio."""
    values = read_table(spark, sf, "records").select("primary_tag").where("primary_tag is not null").distinct().withColumn("leaf", T.slug(T.tag_part(F.col("primary_tag"), -1)))
    entries = read_table(spark, sf, "canonical_tags").select("tag_id", T.slug(T.tag_part(F.col("primary_tag"), -1)).alias("entry"))
    words = lambda c: F.explode(F.array_distinct(F.split(c, "_"))).alias("w")
    pool = values.select("primary_tag", "leaf", words("leaf")).join(entries.select("tag_id", "entry", words("entry")), "w").groupBy("primary_tag", "leaf", "tag_id", "entry").agg(F.count("*").alias("shared"))
    scored = pool.withColumn("score", F.when(F.col("leaf") == F.col("entry"), 100.0).otherwise(F.round(sequence_ratio("leaf", "entry"), 4))).where("score >= 80")
    best = scored.groupBy("primary_tag").agg(F.max(F.struct("score", "shared", (-F.col("tag_id")).alias("n"))).alias("x"))
    return best.select("primary_tag", (-F.col("x.n")).alias("tag_id"), "x.score")


@register(
    "JN-17",
    f"""WITH v AS (SELECT v, list_distinct(list_filter(string_split(v, ' '), lambda w: length(w) > 2 AND w NOT IN {GENERIC})) AS w FROM (SELECT DISTINCT trim(regexp_replace(lower(entity_name), '[^a-z0-9]+', ' ', 'g')) AS v FROM gi_crc_standalone) WHERE v <> ''),
            e AS (SELECT entity_id, e, list_distinct(list_filter(string_split(e, ' '), lambda w: length(w) > 2 AND w NOT IN {GENERIC})) AS x FROM (SELECT entity_id, trim(regexp_replace(lower(entity_name), '[^a-z0-9]+', ' ', 'g')) AS e FROM canonical_entities) WHERE e <> ''),
            s AS (SELECT v, entity_id, v = e AS same, CASE WHEN v = e OR ((contains(v, e) OR contains(e, v)) AND len(w) > 0) THEN least(length(v), length(e)) / greatest(length(v), length(e))
                    WHEN contains(v, e) OR contains(e, v) THEN 0 ELSE len(list_intersect(w, x)) / greatest(len(w), len(x), 1) END AS s FROM v CROSS JOIN e)
       SELECT v AS value, entity_id, round(s, 6) AS score FROM s WHERE s >= 0.5 QUALIFY row_number() OVER (PARTITION BY v ORDER BY same DESC, round(s, 6) DESC, entity_id) = 1""",
)
def conservative_match(spark, sf):
    values = read_table(spark, sf, "gi_crc_standalone").select(T.normalize(F.col("entity_name")).alias("value"))
    entries = read_table(spark, sf, "canonical_entities").select("entity_id", T.normalize(F.col("entity_name")).alias("entry"))
    return conservative_best(values, entries, "value", "entry", "entity_id")


@register("JN-19", "WITH q AS (SELECT doc_id, CASE WHEN n_chars <> length(text) THEN 'wrong_length' WHEN trim(text) = '' THEN 'blank' END AS flag FROM documents) SELECT d.doc_id, coalesce(q.flag, 'clean') AS flag FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id AND q.flag IS NOT NULL")
def quality_flags(spark, sf):
    docs = read_table(spark, sf, "documents")
    flags = docs.select("doc_id", F.when(F.col("n_chars") != F.char_length("text"), "wrong_length").when(F.trim("text") == "", "blank").alias("flag")).where("flag is not null")
    return docs.select("doc_id").join(flags, "doc_id", "left").select("doc_id", F.coalesce("flag", F.lit("clean")).alias("flag"))


@register("JN-25", "WITH a AS (SELECT chunk_id, max(tagging_status) AS d FROM chunks WHERE tagging_status = 'reviewed' GROUP BY 1), b AS (SELECT source_id, page, max(tagging_status) AS d FROM chunks WHERE tagging_status IS NOT NULL AND source_id IS NOT NULL AND page IS NOT NULL GROUP BY ALL) SELECT c.chunk_id, c.ingested_at, coalesce(a.d, b.d, 'direct') AS decision FROM chunks c LEFT JOIN a ON a.chunk_id = c.chunk_id LEFT JOIN b ON b.source_id = c.source_id AND b.page = c.page")
def decisions(spark, sf):
    rows = read_table(spark, sf, "chunks").select("chunk_id", "ingested_at", "source_id", "page", "tagging_status")
    a = rows.where("tagging_status = 'reviewed'").groupBy("chunk_id").agg(F.max("tagging_status").alias("a"))
    b = rows.where("tagging_status is not null and source_id is not null and page is not null").groupBy("source_id", "page").agg(F.max("tagging_status").alias("b"))
    return rows.join(a, "chunk_id", "left").join(b, ["source_id", "page"], "left").select("chunk_id", "ingested_at", F.coalesce("a", "b", F.lit("direct")).alias("decision"))


@register("JN-27", "WITH v AS (SELECT regexp_replace(package_id, '^[a-z]+_', '') AS stem, min(video_url) AS url FROM segments_indexable WHERE video_url IS NOT NULL GROUP BY 1) SELECT DISTINCT s.package_id, v.url, CASE WHEN v.url IS NULL THEN 'pending' ELSE 'ready' END AS state FROM segments_indexable s LEFT JOIN v ON v.stem = regexp_replace(s.package_id, '^[a-z]+_', '')")
def media(spark, sf):
    rows = read_table(spark, sf, "segments_indexable").withColumn("stem", F.regexp_replace("package_id", "^[a-z]+_", ""))
    urls = rows.where("video_url is not null").groupBy("stem").agg(F.min("video_url").alias("url"))
    return rows.select("package_id", "stem").distinct().join(urls, "stem", "left").select("package_id", "url", F.when(F.col("url").isNull(), "pending").otherwise("ready").alias("state"))


@register("AGG-19", "SELECT retrieval_mode, count(*) AS n, count(*) FILTER (WHERE excerpt IS NOT NULL) AS hits, round(100.0 * count(*) FILTER (WHERE excerpt IS NOT NULL) / count(*), 2) AS rate FROM journal_virchows GROUP BY 1")
def failure_modes(spark, sf):
    hits = F.count("excerpt")
    return read_table(spark, sf, "journal_virchows").groupBy("retrieval_mode").agg(F.count("*").alias("n"), hits.alias("hits"), F.round(100.0 * hits / F.count("*"), 2).alias("rate"))


@register("WIN-18", "SELECT chunk_id, image_path FROM chunks WHERE image_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_path, md5(coalesce(text, '')) ORDER BY chunk_id, ingested_at) = 1")
def unique_figures(spark, sf):
    rows = read_table(spark, sf, "chunks").where("image_path is not null")
    return rows.groupBy("image_path", F.md5(F.coalesce("text", F.lit(""))).alias("h")).agg(F.min_by("chunk_id", F.struct("chunk_id", "ingested_at")).alias("chunk_id")).select("chunk_id", "image_path")


@register(
    "WIN-27",
    """WITH r AS (SELECT segment_id, package_id, start_sec, CASE WHEN regexp_matches(text, 'cystic') THEN 'cystic' WHEN regexp_matches(text, 'marker') THEN 'marker' END AS head FROM segments_indexable QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY ingested_at DESC) = 1)
       SELECT segment_id, last_value(head IGNORE NULLS) OVER (PARTITION BY package_id ORDER BY start_sec, segment_id ROWS UNBOUNDED PRECEDING) AS topic FROM r""",
)
def sticky_map(spark, sf):
    rows = current_rows(read_table(spark, sf, "segments_indexable"), "segment_id", ["package_id", "start_sec", "text"])
    head = F.when(F.col("text").rlike("cystic"), "cystic").when(F.col("text").rlike("marker"), "marker")
    over = Window.partitionBy("package_id").orderBy("start_sec", "segment_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("segment_id", F.last(head, ignorenulls=True).over(over).alias("topic"))


@register("TOP-07", "SELECT tag_root, count(*) AS n FROM records WHERE tag_root IS NOT NULL GROUP BY 1 ORDER BY n DESC, tag_root LIMIT 100")
def node_listing(spark, sf):
    return read_table(spark, sf, "records").where("tag_root is not null").groupBy("tag_root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag_root").limit(100)


@register("SET-09", "WITH g AS (SELECT string_split(primary_tag, '::')[-1] AS leaf, list(DISTINCT primary_tag ORDER BY primary_tag) AS l FROM canonical_tags GROUP BY 1) SELECT leaf, array_to_string(l[2:], ',') AS others FROM g WHERE len(l) > 1")
def alias_lists(spark, sf):
    g = read_table(spark, sf, "canonical_tags").groupBy(T.tag_part(F.col("primary_tag"), -1).alias("leaf")).agg(F.array_sort(F.collect_set("primary_tag")).alias("l")).where(F.size("l") > 1)
    return g.select("leaf", F.array_join(F.slice("l", 2, F.size("l")), ",").alias("others"))


@register("SET-10", "WITH u AS (SELECT primary_tag AS tag, 0 AS p, 'list' AS authority FROM canonical_tags UNION ALL SELECT approved_tag, 1, 'approved' FROM curriculum_records WHERE approved_tag <> '' UNION ALL SELECT primary_tag, 2, 'local' FROM tag_records WHERE primary_tag IS NOT NULL) SELECT tag, arg_min(authority, p) AS authority FROM u GROUP BY tag")
def universe(spark, sf):
    part = lambda t, c, p, a: read_table(spark, sf, t).where(f"{c} <> ''").select(F.col(c).alias("tag"), F.lit(p).alias("p"), F.lit(a).alias("authority"))
    all_tags = part("canonical_tags", "primary_tag", 0, "list").unionByName(part("curriculum_records", "approved_tag", 1, "approved")).unionByName(part("tag_records", "primary_tag", 2, "local"))
    return all_tags.groupBy("tag").agg(F.min_by("authority", "p").alias("authority"))


@register("FN-14", "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, 'overlaps with ([a-z -]+) when', 1), lambda x: trim(x)), ',') AS candidates FROM documents")
def differentials(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.regexp_extract_all("text", F.lit("overlaps with ([a-z -]+) when"), F.lit(1)), lambda x: F.trim(x)), ",").alias("candidates"))


@register("DOC-04", "WITH m AS (SELECT unnest(['Atypia', 'Dysplasia', 'Metaplasia']) AS word, unnest(['Change', 'Change', 'Change']) AS canon) SELECT coalesce(m.canon, string_split(string_split(primary_tag, '::')[-1], '_')[-1]) AS kind, count(*) AS n FROM canonical_tags t LEFT JOIN m ON m.word = string_split(string_split(primary_tag, '::')[-1], '_')[-1] GROUP BY 1")
def lumped(spark, sf):
    word = F.element_at(F.split(T.tag_part(F.col("primary_tag"), -1), "_"), -1)
    table = F.create_map(*(F.lit(x) for x in ("Atypia", "Change", "Dysplasia", "Change", "Metaplasia", "Change")))
    return read_table(spark, sf, "canonical_tags").groupBy(F.coalesce(F.try_element_at(table, word), word).alias("kind")).agg(F.count("*").alias("n"))


@register("DOC-06", "WITH u AS (SELECT DISTINCT primary_tag FROM records WHERE primary_tag IS NOT NULL) SELECT t.tag_root, count(*) AS leaves, count(u.primary_tag) AS used, round(100.0 * count(u.primary_tag) / count(*), 2) AS rate FROM canonical_tags t LEFT JOIN u USING (primary_tag) GROUP BY ROLLUP (t.tag_root)")
def coverage_audit(spark, sf):
    used = read_table(spark, sf, "records").where("primary_tag is not null").select("primary_tag").distinct().withColumn("u", F.lit(1))
    rows = read_table(spark, sf, "canonical_tags").join(used, "primary_tag", "left")
    return rows.rollup("tag_root").agg(F.count("*").alias("leaves"), F.count("u").alias("used"), F.round(100.0 * F.count("u") / F.count("*"), 2).alias("rate"))


@register("EVL-06", "SELECT record_id, ingested_at, CASE WHEN contains(lower(coalesce(status, '')), 'approved') THEN 'accept' WHEN contains(lower(coalesce(status, '')), 'review') THEN 'revise' ELSE 'reject' END AS verdict FROM curriculum_records")
def verdicts(spark, sf):
    low = F.lower(F.coalesce("status", F.lit("")))
    return read_table(spark, sf, "curriculum_records").select("record_id", "ingested_at", F.when(F.contains(low, F.lit("approved")), "accept").when(F.contains(low, F.lit("review")), "revise").otherwise("reject").alias("verdict"))


@register("EVL-08", "SELECT (SELECT count(*) - count(DISTINCT tag_id) FROM canonical_tags) AS repeated_tag_ids, (SELECT count(*) FROM canonical_tags WHERE primary_tag IS NULL) AS missing_tags, (SELECT count(*) - count(DISTINCT doc_id) FROM documents) AS repeated_doc_ids")
def integrity(spark, sf):
    tags = read_table(spark, sf, "canonical_tags").agg((F.count("*") - F.countDistinct("tag_id")).alias("repeated_tag_ids"), F.count_if(F.col("primary_tag").isNull()).alias("missing_tags"))
    docs = read_table(spark, sf, "documents").agg((F.count("*") - F.countDistinct("doc_id")).alias("repeated_doc_ids"))
    return tags.crossJoin(docs)  # one row each


@register("ORC-02", "SELECT CASE WHEN url IS NULL OR url = '' THEN 'missing' WHEN NOT starts_with(url, 'https://hub.example/') THEN 'outside' ELSE 'ok' END AS reason, count(*) AS n, count(DISTINCT url) AS urls FROM records GROUP BY 1")
def delete_targets(spark, sf):
    why = F.when(F.col("url").isNull() | (F.col("url") == ""), "missing").when(~F.col("url").startswith("https://hub.example/"), "outside").otherwise("ok")
    return read_table(spark, sf, "records").groupBy(why.alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))


@register("ORC-08", "SELECT chunk_id, ingested_at, title FROM journal_virchows WHERE contains(lower(coalesce(title, '')), 'cyst') OR contains(lower(coalesce(excerpt, '')), 'cyst') OR contains(lower(coalesce(journal, '')), 'cyst') ORDER BY chunk_id, ingested_at LIMIT 25")
def keyword_sample(spark, sf):
    hit = F.lit(False)
    for c in ("title", "excerpt", "journal"):
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("cyst"))
    return read_table(spark, sf, "journal_virchows").where(hit).orderBy("chunk_id", "ingested_at").limit(25).select("chunk_id", "ingested_at", "title")


@register("ORC-09", "SELECT record_id, ingested_at, coalesce(nullif(primary_tag, ''), tag_root) AS tag, substr(excerpt, 1, 1200) AS excerpt, coalesce(nullif(url, ''), 'none') AS url FROM records WHERE coalesce(nullif(primary_tag, ''), tag_root) IS NOT NULL")
def minimal_index(spark, sf):
    tag = F.coalesce(F.nullif("primary_tag", F.lit("")), "tag_root")
    return read_table(spark, sf, "records").where(tag.isNotNull()).select("record_id", "ingested_at", tag.alias("tag"), F.substring("excerpt", 1, 1200).alias("excerpt"), F.coalesce(F.nullif("url", F.lit("")), F.lit("none")).alias("url"))
