"""Named queries on the text, tag and link functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.registry import Registry
from tessera.sources.tables import read_table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

_N = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _norm(c: str) -> str:
    return _N.format(c)


@register("FN-01", f"SELECT doc_id, {_norm('title')} AS norm FROM documents")
def normalize(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.normalize(F.col("title")).alias("norm"))


@register("FN-02", "SELECT doc_id, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40) AS slug FROM documents")
def slug(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.slug(F.col("title"), 40).alias("slug"))


@register("FN-03", "SELECT record_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(primary_tag, '[_-]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))) AS phrase FROM records")
def phrase(spark, sf):
    return read_table(spark, sf, "records").select("record_id", T.phrase(F.col("primary_tag")).alias("phrase"))


@register(
    "FN-04",
    "SELECT tag_id, string_split(primary_tag, '::')[1] AS root, string_split(primary_tag, '::')[-1] AS leaf, array_to_string(list_slice(string_split(primary_tag, '::'), 1, 2), '::') AS branch FROM canonical_tags",
)
def tag_parts(spark, sf):
    tag = F.col("primary_tag")
    return read_table(spark, sf, "canonical_tags").select("tag_id", T.tag_part(tag, 1).alias("root"), T.tag_part(tag, -1).alias("leaf"), T.tag_branch(tag, 2).alias("branch"))


@register(
    "FN-05",
    f"""SELECT entity_id, array_to_string(list_sort(list_transform(
          list_filter(string_split({_norm("replace(regexp_replace(lower(entity_name), '\\([^)]*\\)', ' ', 'g'), '&', ' and ')")}, ' '), lambda t: t <> '' AND t NOT IN ('of', 'the', 'and', 'nos', 'type')),
          lambda t: CASE WHEN length(t) > 4 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN substr(t, 1, length(t) - 1) ELSE t END)), ' ') AS key FROM canonical_entities""",
)
def label_key(spark, sf):
    return read_table(spark, sf, "canonical_entities").select("entity_id", T.label_key(F.col("entity_name")).alias("key"))


_ABBREVIATIONS = {"ca": "carcinoma", "mets": "metastases", "ln": "lymph node", "fig": "figure", "vs": "versus"}
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ABBREVIATIONS.items())


@register("FN-06", f"SELECT chunk_id, ingested_at, array_to_string(list_transform(list_filter(string_split({_norm('text')}, ' '), lambda t: t <> ''), lambda t: CASE t {_CASES} ELSE t END), ' ') AS expanded FROM chunks")
def expand(spark, sf):
    return read_table(spark, sf, "chunks").select("chunk_id", "ingested_at", T.expand_tokens(F.col("text"), _ABBREVIATIONS).alias("expanded"))


_TERMS = ("necrosis", "mitoses", "marker")


def _spots(column: str) -> str:
    return "[" + ", ".join(f"strpos(lower({column}), '{t}')" for t in _TERMS) + "]"


@register(
    "FN-07",
    f"""WITH p AS (SELECT doc_id, text, greatest(coalesce(list_filter({_spots("text")}, lambda x: x > 0)[1], 1) - 80, 1) AS s FROM documents)
        SELECT doc_id, CASE WHEN length(text) <= 240 THEN text ELSE
          (CASE WHEN s > 1 THEN '...' ELSE '' END) || trim(substr(text, s, 240)) || (CASE WHEN s + 239 < length(text) THEN '...' ELSE '' END) END AS excerpt FROM p""",
)
def excerpts(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.excerpt(F.col("text"), _TERMS, 240).alias("excerpt"))


@register("FN-08", f"SELECT doc_id, substr(text, greatest(coalesce(list_min(list_filter({_spots('text')}, lambda x: x > 0)), 1) - 105, 1), 420) AS excerpt FROM documents")
def earliest(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.earliest_excerpt(F.col("text"), _TERMS, 420).alias("excerpt"))


@register("FN-09", f"SELECT doc_id, contains(' ' || {_norm('text')} || ' ', ' mitotic activity ') AS hit FROM documents")
def phrase_test(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.has_phrase(F.col("text"), "mitotic activity").alias("hit"))


@register(
    "FN-10",
    f"""WITH p AS (SELECT doc_id, list_sort(list_filter({_spots("text")}, lambda x: x > 0)) AS s FROM documents)
        SELECT doc_id, coalesce((len(s) > 1 AND s[2] - s[1] <= 90) OR (len(s) > 2 AND s[3] - s[2] <= 90), false) AS near FROM p""",
)
def proximity(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.terms_near(F.col("text"), _TERMS, 90).alias("near"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@register(
    "FN-11",
    f"""WITH w AS (SELECT list_filter(string_split({_norm("title")}, ' '), lambda t: t <> '' AND t NOT IN ({_STOP})) AS w FROM documents WHERE title IS NOT NULL)
        SELECT g AS gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1) GROUP BY g""",
)
def bigrams(spark, sf):
    words = read_table(spark, sf, "documents").select(T.content_tokens(F.col("title")).alias("w"))
    return words.select(F.explode(T.ngrams(F.col("w"), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@register(
    "FN-12",
    f"""WITH w AS (SELECT record_id, ingested_at, list_distinct(list_filter(string_split({_norm("title")}, ' '), lambda t: t <> '')) AS a, list_distinct(list_filter(string_split({_norm("excerpt")}, ' '), lambda t: t <> '')) AS b FROM records WHERE title IS NOT NULL AND excerpt IS NOT NULL)
        SELECT record_id, ingested_at, round(100 * len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0), 4) AS overlap FROM w""",
)
def overlap(spark, sf):
    rows = read_table(spark, sf, "records").where("title is not null and excerpt is not null")
    return rows.select("record_id", "ingested_at", F.round(100 * T.jaccard(T.tokens(F.col("title")), T.tokens(F.col("excerpt"))), 4).alias("overlap"))


@register("FN-13", "SELECT segment_id, ingested_at, replace(replace(regexp_replace(text, '\\bkerratin\\b|\\bkeretin\\b', 'keratin', 'g'), ' um ', ' '), ' uh ', ' ') AS text FROM segments_indexable")
def corrections(spark, sf):
    text = F.regexp_replace("text", "\\bkerratin\\b|\\bkeretin\\b", "keratin")
    return read_table(spark, sf, "segments_indexable").select("segment_id", "ingested_at", F.replace(F.replace(text, F.lit(" um "), F.lit(" ")), F.lit(" uh "), F.lit(" ")).alias("text"))


@register("FN-15", "SELECT doc_id, array_to_string(list_slice(list_distinct_ordered, 1, 4), ' ') AS markers FROM (SELECT doc_id, list_filter(m, lambda x, i: list_position(m, x) = i) AS list_distinct_ordered FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z]{2}-[0-9]+') AS m FROM documents))")
def markers(spark, sf):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z]{2}-[0-9]+"), F.lit(0)))
    return read_table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(found, 1, 4), " ").alias("markers"))


@register("FN-16", "SELECT chunk_id, ingested_at, regexp_extract(text, 'Fig[.] ([0-9]+)', 1) AS figure, lpad(regexp_extract(text, 'case ([A-Z])[0-9]+-([0-9]+)', 2), 6, '0') AS case_no FROM chunks WHERE text IS NOT NULL")
def attributes(spark, sf):
    rows = read_table(spark, sf, "chunks").where("text is not null")
    return rows.select("chunk_id", "ingested_at", F.regexp_extract("text", "Fig[.] ([0-9]+)", 1).alias("figure"), F.lpad(F.regexp_extract("text", "case ([A-Z])[0-9]+-([0-9]+)", 2), 6, "0").alias("case_no"))


@register(
    "FN-17",
    """SELECT entity_name, count(*) AS n, CASE WHEN length(regexp_replace(entity_name, '[^A-Za-z]', '', 'g')) * 0.7 <= length(regexp_replace(entity_name, '[^A-Z]', '', 'g'))
         THEN array_to_string(list_transform(string_split(lower(entity_name), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') ELSE entity_name END AS titled FROM gi_crc_standalone WHERE entity_name IS NOT NULL GROUP BY entity_name""",
)
def titled(spark, sf):
    counted = read_table(spark, sf, "gi_crc_standalone").where("entity_name is not null").groupBy("entity_name").agg(F.count("*").alias("n"))
    return counted.withColumn("titled", T.title_case(F.col("entity_name")))


_SEC = "regexp_replace(regexp_replace(printf('%.2f', {}), '0+$', ''), '[.]$', '')"


@register("FN-18", f"SELECT segment_id, ingested_at, video_url || '#t=' || {_SEC.format('start_sec')} || coalesce(',' || {_SEC.format('end_sec')}, '') AS link FROM segments_indexable")
def links(spark, sf):
    return read_table(spark, sf, "segments_indexable").select("segment_id", "ingested_at", T.time_link(F.col("video_url"), F.col("start_sec"), F.col("end_sec")).alias("link"))


@register("FN-19", "SELECT chunk_id, ingested_at, floor(try_cast(trim(page) AS DOUBLE))::BIGINT AS page_no FROM chunks")
def pages(spark, sf):
    return read_table(spark, sf, "chunks").select("chunk_id", "ingested_at", T.loose_int(F.col("page")).alias("page_no"))


@register("FN-20", "SELECT doc_id, sha256(coalesce(source, '') || '|' || coalesce(title, '') || '|' || substr(coalesce(text, ''), 1, 80)) AS key FROM documents")
def hashes(spark, sf):
    c = [F.coalesce(F.col(x), F.lit("")) for x in ("source", "title", "text")]
    return read_table(spark, sf, "documents").select("doc_id", F.sha2(F.concat(c[0], F.lit("|"), c[1], F.lit("|"), F.substring(c[2], 1, 80)), 256).alias("key"))


@register("FN-21", "SELECT chunk_id, ingested_at, len(coalesce(try_cast(candidate_tags AS JSON)::VARCHAR[], [])) AS n_tags FROM chunks")
def lenient_json(spark, sf):
    return read_table(spark, sf, "chunks").select("chunk_id", "ingested_at", F.size(T.json_list(F.col("candidate_tags"))).cast("bigint").alias("n_tags"))


@register("FN-22", "WITH p AS (SELECT record_id, ingested_at, list_filter(list_transform(regexp_split_to_array(curriculum_tags, '[|;,]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM curriculum_records) SELECT record_id, ingested_at, len(list_distinct(p)) AS parts FROM p WHERE p IS NOT NULL")
def flattened(spark, sf):
    rows = read_table(spark, sf, "curriculum_records").where("curriculum_tags is not null")
    return rows.select("record_id", "ingested_at", F.size(T.flatten_tags(F.col("curriculum_tags"))).cast("bigint").alias("parts"))


@register("FN-25", "SELECT tag_id, printf('%s. Taxonomy leaf: %s. Full path: %s.', replace(string_split(primary_tag, '::')[-1], '_', ' '), string_split(primary_tag, '::')[-1], replace(primary_tag, '::', ' > ')) AS text FROM canonical_tags")
def leaf_text(spark, sf):
    leaf = T.tag_part(F.col("primary_tag"), -1)
    return read_table(spark, sf, "canonical_tags").select("tag_id", F.format_string("%s. Taxonomy leaf: %s. Full path: %s.", F.replace(leaf, F.lit("_"), F.lit(" ")), leaf, F.replace("primary_tag", F.lit("::"), F.lit(" > "))).alias("text"))


@register("FN-26", "SELECT event_id, floor(epoch(ts))::BIGINT AS at, date_trunc('hour', ts) AS hour, ts + INTERVAL 10 MINUTE < TIMESTAMP '2024-01-15' AS expired FROM events")
def times(spark, sf):
    return read_table(spark, sf, "events").select(
        "event_id",
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        (F.expr("ts + interval 10 minutes") < F.lit("2024-01-15").cast("timestamp_ntz")).alias("expired"),
    )


@register("FN-27", "SELECT doc_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM documents")
def escaped(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.html_escape(F.col("title")).alias("html"))


@register("FN-28", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'carcinoma|sarcoma|lymphoma') THEN 'malignant' WHEN regexp_matches(lower(text), 'dysplasia|atypia') THEN 'atypical' WHEN regexp_matches(lower(text), 'adenoma|fibroma|lipoma') THEN 'benign' ELSE 'other' END AS tier FROM documents")
def first_rule(spark, sf):
    low = F.lower("text")
    tier = F.when(low.rlike("carcinoma|sarcoma|lymphoma"), "malignant").when(low.rlike("dysplasia|atypia"), "atypical").when(low.rlike("adenoma|fibroma|lipoma"), "benign").otherwise("other")
    return read_table(spark, sf, "documents").select("doc_id", tier.alias("tier"))


@register("FN-29", "SELECT r.record_id, r.ingested_at, coalesce(tag_root, '') = '' OR list_has_any([lower(tag_root)], ['gi', 'gu', 'gyn']) AS fits FROM records r")
def compatible(spark, sf):
    root = F.coalesce("tag_root", F.lit(""))
    return read_table(spark, sf, "records").select("record_id", "ingested_at", ((root == "") | F.arrays_overlap(F.array(F.lower(root)), F.array(F.lit("gi"), F.lit("gu"), F.lit("gyn")))).alias("fits"))


@register("PRJ-02", "SELECT record_id, ingested_at, coalesce(nullif(trim(excerpt), ''), nullif(trim(title), ''), nullif(trim(url), ''), 'none') AS text FROM records")
def first_text(spark, sf):
    return read_table(spark, sf, "records").select("record_id", "ingested_at", F.coalesce(T.first_present(F.col("excerpt"), F.col("title"), F.col("url")), F.lit("none")).alias("text"))


@register("PRJ-03", "SELECT record_id, ingested_at, source || ':' || substr(coalesce(nullif(trim(url), ''), record_id), 1, 60) AS id, substr(coalesce(nullif(trim(title), ''), record_id), 1, 24) AS short_title FROM records")
def record_ids(spark, sf):
    ident = F.coalesce(T.present(F.col("url")), F.col("record_id"))
    return read_table(spark, sf, "records").select("record_id", "ingested_at", F.concat("source", F.lit(":"), F.substring(ident, 1, 60)).alias("id"), F.substring(F.coalesce(T.present(F.col("title")), F.col("record_id")), 1, 24).alias("short_title"))


@register("PRJ-04", "SELECT record_id, ingested_at, CASE WHEN nullif(trim(approved_tag), '') IS NOT NULL THEN 'approved_tag' WHEN nullif(trim(original_tag), '') IS NOT NULL THEN 'original_tag' END AS field, coalesce(nullif(trim(approved_tag), ''), nullif(trim(original_tag), '')) AS tag FROM curriculum_records")
def preferred(spark, sf):
    a, o = T.present(F.col("approved_tag")), T.present(F.col("original_tag"))
    best = F.coalesce(F.when(a.isNotNull(), F.struct(F.lit("approved_tag").alias("field"), a.alias("tag"))), F.when(o.isNotNull(), F.struct(F.lit("original_tag").alias("field"), o.alias("tag"))))
    return read_table(spark, sf, "curriculum_records").select("record_id", "ingested_at", best.alias("b")).select("record_id", "ingested_at", "b.field", "b.tag")


@register("PRJ-05", "SELECT chunk_id, ingested_at, regexp_replace(concat_ws(' ', source_title, chapter_title, section_heading, text), '\\s+', ' ', 'g') AS search_text FROM chunks")
def search_text(spark, sf):
    return read_table(spark, sf, "chunks").select("chunk_id", "ingested_at", F.regexp_replace(F.concat_ws(" ", "source_title", "chapter_title", "section_heading", "text"), "\\s+", " ").alias("search_text"))


@register("PRJ-11", "SELECT record_id, ingested_at, json_extract_string(locator_json, '$.source_id') AS source_id, try_cast(json_extract_string(locator_json, '$.page') AS BIGINT) AS page, CASE WHEN locator_json IS NULL THEN 'none' WHEN json_extract_string(locator_json, '$.page') IS NULL THEN 'partial' ELSE 'complete' END AS locator FROM records")
def locators(spark, sf):
    source, page = F.get_json_object("locator_json", "$.source_id"), F.get_json_object("locator_json", "$.page")
    state = F.when(F.col("locator_json").isNull(), "none").when(page.isNull(), "partial").otherwise("complete")
    return read_table(spark, sf, "records").select("record_id", "ingested_at", source.alias("source_id"), page.try_cast("bigint").alias("page"), state.alias("locator"))


@register("PRJ-14", "SELECT record_id, ingested_at, coalesce(nullif(approved_tag, ''), original_tag) AS tag, coalesce(nullif(root, ''), string_split(original_tag, '::')[1]) AS root, coalesce(fuzzy_score, 100) AS score FROM curriculum_records")
def aliased(spark, sf):
    return read_table(spark, sf, "curriculum_records").select(
        "record_id", "ingested_at", F.coalesce(F.nullif("approved_tag", F.lit("")), "original_tag").alias("tag"), F.coalesce(F.nullif("root", F.lit("")), T.tag_part(F.col("original_tag"), 1)).alias("root"), F.coalesce("fuzzy_score", F.lit(100)).alias("score")
    )
