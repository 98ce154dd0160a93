"""Named queries on samples, winners, scores, low information, and replayed evaluations."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import quality as Q
from tessera.functions import text as T
from tessera.operators import sampling
from tessera.operators.current import current_rows
from tessera.operators.joins import range_lookup
from tessera.operators.vector import nearest_many
from tessera.plans.ranking import TERMS, postings
from tessera.plans.registry import Registry
from tessera.session import cut_lineage
from tessera.sources.tables import read_table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


# --- search by vectors


@register(
    "TOP-02-batch",
    """SELECT q.vec_id AS query, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id)::INT AS rank
       FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q QUALIFY rank <= 10""",
)
def vector_batch(spark, sf):
    rows = read_table(spark, sf, "embeddings")
    return nearest_many(rows, "vec_id", "embedding", rows.where("vec_id % 20 = 0"), 10)


# --- winners and samples


@register(
    "WIN-21",
    """WITH t AS (SELECT DISTINCT tag_root, primary_tag, lower(regexp_replace(string_split(primary_tag, '::')[-1], '[^A-Za-z0-9]+', '', 'g')) AS leaf, CASE tag_authority WHEN 'curriculum' THEN 0 WHEN 'approved_local' THEN 1 WHEN 'who_like' THEN 2 ELSE 3 END AS p FROM records WHERE primary_tag IS NOT NULL AND tag_root IS NOT NULL),
            w AS (SELECT tag_root, leaf, first(primary_tag ORDER BY p, -len(string_split(primary_tag, '::')), primary_tag) AS winner, list_sort(list_distinct(list(primary_tag))) AS l FROM t GROUP BY tag_root, leaf)
       SELECT tag_root, leaf, winner, array_to_string(list_filter(l, lambda x: x <> winner), ',') AS aliases FROM w""",
)
def winners(spark, sf):
    """Per root and leaf the tag of the best authority, then the deepest, then the least; the others are its aliases."""
    p = F.when(F.col("tag_authority") == "curriculum", 0).when(F.col("tag_authority") == "approved_local", 1).when(F.col("tag_authority") == "who_like", 2).otherwise(3)
    leaf = F.lower(F.regexp_replace(F.element_at(F.split("primary_tag", "::"), -1), "[^A-Za-z0-9]+", ""))
    rows = read_table(spark, sf, "records").where("primary_tag is not null and tag_root is not null").select("tag_root", "primary_tag", leaf.alias("leaf"), p.alias("p")).distinct()
    won = rows.groupBy("tag_root", "leaf").agg(F.min_by("primary_tag", F.struct("p", (-F.size(F.split("primary_tag", "::"))).alias("d"), "primary_tag")).alias("winner"), F.collect_set("primary_tag").alias("l"))
    return won.select("tag_root", "leaf", "winner", F.array_join(F.array_except(F.sort_array("l"), F.array("winner")), ",").alias("aliases"))


def _quota_sql(group: str, size: int, seed: int, best: str) -> str:
    seeded = f"md5('{seed}:' || doc_id), doc_id"
    return f"""WITH b AS (SELECT doc_id, {group} AS g, n_chars FROM documents WHERE {group} IS NOT NULL), s AS (SELECT greatest(1, {size} // count(DISTINCT g)) AS share FROM b),
       r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {best or seeded}) AS n FROM b), t AS (SELECT doc_id, g FROM r, s WHERE n <= share),
       f AS (SELECT doc_id, g FROM r, s WHERE n > share ORDER BY {seeded} LIMIT (SELECT greatest(0, {size} - count(*)) FROM t))
       SELECT * FROM t UNION ALL SELECT * FROM f"""


@register("WIN-22", _quota_sql("source", 60, 3, "n_chars DESC NULLS LAST, doc_id"))
def stratified(spark, sf):
    rows = read_table(spark, sf, "documents").where("source is not null").select("doc_id", F.col("source").alias("g"), "n_chars")
    return sampling.quota_sample(rows, "g", "doc_id", 60, 3, [F.desc_nulls_last("n_chars")]).select("doc_id", "g")


_BUCKET = "CASE WHEN regexp_matches(title, 'carcinoma') THEN 0 WHEN regexp_matches(title, 'blastoma') THEN 1 ELSE 2 END"


@register("WIN-24", _quota_sql(_BUCKET, 100, 5, ""))
def bucketed(spark, sf):
    bucket = F.when(F.col("title").rlike("carcinoma"), 0).when(F.col("title").rlike("blastoma"), 1).otherwise(2)
    return sampling.quota_sample(read_table(spark, sf, "documents").select("doc_id", bucket.alias("g")), "g", "doc_id", 100, 5)


@register(
    "WIN-25",
    """WITH a AS (SELECT tag_id FROM canonical_tags WHERE tag_root = 'Cyto' ORDER BY md5('9:' || tag_id), tag_id LIMIT 1),
       b AS (SELECT tag_id FROM canonical_tags WHERE tag_authority = 'who_like' AND tag_id NOT IN (FROM a) ORDER BY md5('9:' || tag_id), tag_id LIMIT 1),
       c AS (SELECT tag_id FROM canonical_tags WHERE tag_id NOT IN (FROM a) AND tag_id NOT IN (FROM b) ORDER BY md5('9:' || tag_id), tag_id LIMIT (SELECT 20 - (SELECT count(*) FROM a) - (SELECT count(*) FROM b)))
       SELECT tag_id, 1 AS stratum FROM a UNION ALL SELECT tag_id, 2 FROM b UNION ALL SELECT tag_id, 0 FROM c""",
)
def required_strata(spark, sf):
    strata = [F.col("tag_root") == "Cyto", F.col("tag_authority") == "who_like"]
    return sampling.required_first(read_table(spark, sf, "canonical_tags"), strata, "tag_id", 20, 9).select("tag_id", "stratum")


@register("WIN-28", "SELECT p_partkey, b.label FROM part JOIN (VALUES (1, 10, 'small'), (11, 25, 'medium'), (20, 30, 'middling'), (26, 50, 'large')) b(lo, hi, label) ON p_size BETWEEN lo AND hi")
def ranges(spark, sf):
    labels = spark.createDataFrame([(1, 10, "small"), (11, 25, "medium"), (20, 30, "middling"), (26, 50, "large")], "lo int, hi int, label string")
    return range_lookup(read_table(spark, sf, "part"), "p_size", labels, "lo", "hi", 12).select("p_partkey", "label")


@register(
    "DOC-05",
    """WITH g AS (SELECT tag_root, string_split(primary_tag, '::')[2] AS part, count(*) AS n FROM canonical_tags GROUP BY ALL),
       c AS (SELECT tag_root, CASE WHEN n >= 2 THEN part ELSE 'Other' END AS category, sum(n) AS n FROM g GROUP BY ALL),
       t AS (SELECT tag_root, sum(n) AS total, sum(n) FILTER (WHERE category <> 'Other') AS named, count(*) FILTER (WHERE category <> 'Other') AS k FROM c GROUP BY 1),
       o AS (SELECT c.tag_root, CASE WHEN coalesce(named, 0) / total >= 0.4 AND k >= 2 THEN category ELSE 'All' END AS category, n FROM c JOIN t USING (tag_root)),
       s AS (SELECT tag_root, category, sum(n)::BIGINT AS n FROM o GROUP BY ALL)
       SELECT *, row_number() OVER (PARTITION BY tag_root ORDER BY category = 'Other', n DESC, category)::INT AS place FROM s""",
)
def category_groups(spark, sf):
    """Tags by their second part where enough of a root's tags have one they share; the largest category first, the rest last."""
    parts = read_table(spark, sf, "canonical_tags").groupBy("tag_root", T.tag_part(F.col("primary_tag"), 2).alias("part")).agg(F.count("*").alias("n"))
    categories = parts.groupBy("tag_root", F.when(F.col("n") >= 2, F.col("part")).otherwise("Other").alias("category")).agg(F.sum("n").alias("n"))
    root = Window.partitionBy("tag_root")
    named = F.col("category") != "Other"
    grouped = (F.coalesce(F.sum(F.when(named, F.col("n"))).over(root), F.lit(0)) / F.sum("n").over(root) >= 0.4) & (F.count_if(named).over(root) >= 2)
    out = categories.select("tag_root", F.when(grouped, F.col("category")).otherwise("All").alias("category"), "n").groupBy("tag_root", "category").agg(F.sum("n").alias("n"))
    return out.withColumn("place", F.row_number().over(root.orderBy(F.col("category") == "Other", F.desc("n"), "category")))


# --- scores


_NODE_QUERIES = ("root:GI", "tag:cell", "GI::Colon", "HN", "Giant cell polyp of GI")


@register(
    "RNK-03",
    """WITH n AS (SELECT primary_tag, count(*) AS n FROM records WHERE primary_tag IS NOT NULL GROUP BY 1), t AS (SELECT tag_id, lower(primary_tag) AS tag, lower(tag_root) AS root, coalesce(n, 0) AS n FROM canonical_tags LEFT JOIN n USING (primary_tag)),
       s AS (SELECT tag_id, 'root:GI' AS query, CASE WHEN starts_with(tag, 'gi') OR root = 'gi' THEN 1000 + n ELSE 0 END::DOUBLE AS score FROM t
         UNION ALL SELECT tag_id, 'tag:cell', CASE WHEN contains(tag, 'cell') THEN 800 + n ELSE 0 END FROM t
         UNION ALL SELECT tag_id, 'GI::Colon', CASE WHEN tag = 'gi::colon' THEN 1200 + n WHEN starts_with(tag, 'gi::colon') THEN 950 + n WHEN root = 'gi::colon' THEN 900 + n ELSE 0 END FROM t
         UNION ALL SELECT tag_id, q, CASE WHEN h > 0 THEN h * 100 + CASE WHEN list_contains(w, root) THEN 150 ELSE 0 END + least(n, 2000) / 1000.0 ELSE 0 END
           FROM (SELECT *, len(list_filter(w, lambda x: contains(tag, x) OR contains(root, x))) AS h FROM t CROSS JOIN (SELECT unnest(['HN', 'Giant cell polyp of GI']) AS q, unnest([['hn'], ['giant', 'cell', 'polyp', 'of', 'gi']]) AS w)))
       SELECT tag_id, query, round(score, 6) AS score FROM s WHERE score > 0""",
)
def node_scores(spark, sf):
    """Nodes of the tag tree by how they answer a query: by root, by a part of the tag, by path, or by words; records count a little."""
    from tessera.operators.requests import parse_tag_query

    counts = read_table(spark, sf, "records").where("primary_tag is not null").groupBy("primary_tag").agg(F.count("*").alias("n"))
    nodes = read_table(spark, sf, "canonical_tags").join(counts, "primary_tag", "left").select("tag_id", F.lower("primary_tag").alias("tag"), F.lower("tag_root").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    tag, root, n, scores = F.col("tag"), F.col("root"), F.col("n"), []
    for query in _NODE_QUERIES:
        mode, value = parse_tag_query(query)
        v = F.lit(value.lower())
        if mode == "root":
            score = F.when(tag.startswith(v) | (root == v), 1000 + n)
        elif mode == "tag":
            score = F.when(F.contains(tag, v), 800 + n)
        elif mode == "path":
            score = F.when(tag == v, 1200 + n).when(tag.startswith(v), 950 + n).when(root == v, 900 + n)
        else:
            words = [F.lit(w) for w in value.lower().split() if len(w) > 1]
            hits = reduce(add, ((F.contains(tag, w) | F.contains(root, w)).cast("int") for w in words))
            score = F.when(hits > 0, hits * 100 + F.when(root.isin(*words), 150).otherwise(0) + F.least(n, F.lit(2000)) / 1000.0)
        scores.append(F.struct(F.lit(query).alias("query"), F.round(score.cast("double"), 6).alias("score")))
    return nodes.select("tag_id", F.explode(F.array(*scores)).alias("s")).select("tag_id", "s.*").where("score > 0")


_ASKED, _MORE, _WRONG = "giant cell adenoma of the liver", ("hepatic", "GCAL"), ("colon", "stomach")


@register(
    "RNK-04",
    f"""WITH t AS (SELECT record_id, ingested_at, trim(regexp_replace(lower(entity_name), '[^a-z0-9]+', ' ', 'g')) AS t FROM gi_crc_standalone WHERE entity_name IS NOT NULL),
       w AS (SELECT *, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS w FROM t)
       SELECT record_id, ingested_at, round(least(0.15 * len(list_intersect(w, string_split('{_ASKED}', ' '))), 1.5) + CASE WHEN contains(t, '{_ASKED}') THEN 2.0 ELSE 0 END + CASE WHEN length(t) > 3 AND contains('{_ASKED}', t) THEN 1.5 ELSE 0 END
         + 0.75 * ({' + '.join(f"contains(t, '{m.lower()}')::INT" for m in _MORE)}) - CASE WHEN {' OR '.join(f"contains(t, '{x}')" for x in _WRONG)} THEN 0.5 ELSE 0 END, 6) AS boost FROM w""",
)
def title_boost(spark, sf):
    """Shared words, the whole query in the title, the whole title in the query, terms of the expansion, and other organs."""
    rows = read_table(spark, sf, "gi_crc_standalone").where("entity_name is not null").select("record_id", "ingested_at", T.normalize(F.col("entity_name")).alias("t"))
    t, asked = F.col("t"), F.lit(_ASKED)
    shared = F.size(F.array_intersect(F.array_distinct(F.filter(F.split(t, " "), lambda x: x != "")), F.split(asked, " ")))
    more = reduce(add, (F.contains(t, F.lit(m.lower())).cast("int") for m in _MORE))
    boost = F.least(0.15 * shared, F.lit(1.5)) + F.when(F.contains(t, asked), 2.0).otherwise(0.0) + F.when((F.length(t) > 3) & F.contains(asked, t), 1.5).otherwise(0.0) + 0.75 * more - F.when(t.rlike("|".join(_WRONG)), 0.5).otherwise(0.0)
    return rows.select("record_id", "ingested_at", F.round(boost, 6).alias("boost"))


_TARGET = "serrated xanthoma of the colon"


@register(
    "RNK-11",
    f"""WITH v AS (SELECT DISTINCT lower(entity_name) AS v FROM gi_crc_standalone WHERE entity_name IS NOT NULL),
       w AS (SELECT v, list_distinct(list_filter(string_split(trim(regexp_replace(v, '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w, string_split('{_TARGET}', ' ') AS q FROM v)
       SELECT v AS value, CASE WHEN v = '{_TARGET}' THEN 100 WHEN contains(v, '{_TARGET}') OR (length(v) > 3 AND contains('{_TARGET}', v)) THEN 95
         ELSE round(100 * greatest(1 - levenshtein(v, '{_TARGET}') / greatest(length(v), {len(_TARGET)}), len(list_intersect(w, q)) / len(list_distinct(list_concat(w, q)))), 4) END AS score FROM w""",
)
def lexical_similarity(spark, sf):
    """Equal, held within the other, or the better of the ratio of letters and the share of words in common."""
    v, q = F.col("value"), F.lit(_TARGET)
    words = F.array_distinct(T.tokens(v))
    share = F.size(F.array_intersect(words, F.split(q, " "))) / F.size(F.array_union(words, F.split(q, " ")))
    ratio = 1 - F.levenshtein(v, q) / F.greatest(F.length(v), F.length(q))
    score = F.when(v == q, 100.0).when(F.contains(v, q) | ((F.length(v) > 3) & F.contains(q, v)), 95.0).otherwise(F.round(100 * F.greatest(ratio, share), 4))
    return read_table(spark, sf, "gi_crc_standalone").where("entity_name is not null").select(F.lower("entity_name").alias("value")).distinct().select("value", score.alias("score"))


_EXPANDED = (*TERMS, "mitoses", "cyst", "node")


@register(
    "RNK-12",
    f"""SELECT doc_id, round(CASE WHEN root IS NOT NULL AND root <> 'GI' AND contains(lower(title), 'lymph') THEN -1 ELSE ({' + '.join(f"regexp_matches(lower(text), '\\b{t}\\b')::INT" if len(t) <= 5 else f"contains(lower(text), '{t}')::INT" for t in _EXPANDED)}) / {float(len(_EXPANDED))} END, 6) AS relevance FROM documents""",
)
def relevance(spark, sf):
    """The share of the terms a text has, short ones as whole words only; -1 where its title is of another topic."""
    low = F.lower("text")
    hits = reduce(add, ((low.rlike(rf"\b{t}\b") if len(t) <= 5 else F.contains(low, F.lit(t))).cast("int") for t in _EXPANDED))
    conflict = F.col("root").isNotNull() & (F.col("root") != "GI") & F.contains(F.lower("title"), F.lit("lymph"))
    return read_table(spark, sf, "documents").select("doc_id", F.round(F.when(conflict, -1.0).otherwise(hits / F.lit(float(len(_EXPANDED)))), 6).alias("relevance"))


@register("RNK-16", "SELECT package_id, count(DISTINCT primary_tag) * 1000 - round(max(start_sec) - min(start_sec), 3) AS score FROM segments_indexable GROUP BY package_id")
def run_score(spark, sf):
    rows = read_table(spark, sf, "segments_indexable").groupBy("package_id").agg(F.countDistinct("primary_tag").alias("n"), F.round(F.max("start_sec") - F.min("start_sec"), 3).alias("elapsed"))
    return rows.select("package_id", (F.col("n") * 1000 - F.col("elapsed")).alias("score"))


# --- what says too little


_SIGNAL = r"(?i)\b(adenoma|carcinoma|fibroma|sarcoma|lymphoma|cyst|polyp|necrosis|stain|marker|nuclei|mucin)\b"


def _sql(p: str) -> str:
    return p.replace("'", "''")


_QUALITY = f"""q AS (SELECT *, coalesce(said, '') AS t, len(w) AS n, len(list_filter(w, lambda x: x IN {Q.FILLER})) AS f FROM (SELECT *, list_filter(string_split(trim(regexp_replace(lower(coalesce(said, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM said)),
       s AS (SELECT *, regexp_matches(t, '{_sql(_SIGNAL)}') AS signal, f / greatest(n, 1) AS share, regexp_matches(t, '{_sql(Q.any_of(Q.NOISE))}') AS noise, regexp_matches(t, '{_sql(Q.any_of(Q.HOUSEKEEPING))}') AS house, regexp_matches(t, '(?i){_sql(Q.CAPTION)}') AS cap FROM q),
       h AS (SELECT *, CASE WHEN NOT signal THEN CASE WHEN noise THEN 'noise' WHEN n < 3 THEN 'too short' WHEN n < 40 AND share >= 0.45 THEN 'filler' WHEN house AND n < 45 THEN 'housekeeping' WHEN captioned AND n < 25 AND cap THEN 'caption' END END AS hard FROM s)"""


@register("FLT-11", f"WITH said AS (SELECT segment_id, ingested_at, text AS said, false AS captioned FROM segments_indexable), {_QUALITY} SELECT segment_id, ingested_at, hard AS reason FROM h")
def hard_reasons(spark, sf):
    text = F.col("text")
    return read_table(spark, sf, "segments_indexable").select("segment_id", "ingested_at", Q.hard_reason(text, F.coalesce(text, F.lit("")).rlike(_SIGNAL), F.lit(False)).alias("reason"))


@register(
    "FLT-12",
    f"""WITH said AS (SELECT chunk_id, ingested_at, text AS said, true AS captioned, coalesce(candidate_tags <> '[]', false) AS context FROM chunks
         UNION ALL SELECT segment_id, ingested_at, text, false, coalesce(tag_basis = 'keyword', false) FROM segments_indexable), {_QUALITY},
       k AS (SELECT *, signal OR (context AND n - f >= 5 AND NOT noise) AS kept FROM h)
       SELECT chunk_id, ingested_at, coalesce(hard, CASE WHEN kept THEN CASE WHEN n < 45 THEN CASE WHEN signal THEN 'short, kept for its words' ELSE 'short, kept for its context' END ELSE 'kept' END
         WHEN n < 8 THEN 'too short without signal' WHEN n < 18 THEN 'very short without signal' WHEN n < 40 AND share >= 0.45 THEN 'filler' WHEN house AND n < 45 THEN 'housekeeping' WHEN captioned AND n < 25 AND cap THEN 'caption' ELSE 'kept' END) AS class FROM k""",
)
def information_classes(spark, sf):
    chunks = read_table(spark, sf, "chunks").select("chunk_id", "ingested_at", "text", F.lit(True).alias("captioned"), F.coalesce(F.col("candidate_tags") != "[]", F.lit(False)).alias("context"))
    segments = read_table(spark, sf, "segments_indexable").select(F.col("segment_id").alias("chunk_id"), "ingested_at", "text", F.lit(False).alias("captioned"), F.coalesce(F.col("tag_basis") == "keyword", F.lit(False)).alias("context"))
    text = F.col("text")
    return chunks.unionByName(segments).select("chunk_id", "ingested_at", Q.verdict(text, F.coalesce(text, F.lit("")).rlike(_SIGNAL), F.col("context"), F.col("captioned")).alias("class"))


_NAMES = r"[a-z]+ (?:adenoma|carcinoma|fibroma|sarcoma|lymphoma|cyst|polyp|granuloma)"


@register(
    "FLT-14",
    f"""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{_NAMES}'))) AS n FROM documents)
       SELECT doc_id, regexp_matches(t, '{_sql(Q.CONTENTS)}') OR (regexp_matches(t, '{_sql(Q.LISTING)}') AND n >= 3) OR (n >= 8 AND length(t) < 1200) AS dump FROM t""",
)
def contents_lists(spark, sf):
    names = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_NAMES), F.lit(0))
    return read_table(spark, sf, "documents").select("doc_id", Q.lists_contents(F.col("text"), names).alias("dump"))


@register(
    "FLT-29",
    """WITH g AS (SELECT source, count(*) FILTER (WHERE status = 'rejected_or_hidden') AS bad FROM curriculum_records GROUP BY source)
       SELECT record_id, ingested_at FROM curriculum_records JOIN g USING (source) WHERE bad * 7 <= (SELECT count(*) FROM curriculum_records c WHERE c.source = g.source) AND status = 'approved' AND NOT coalesce(regexp_matches(approved_tag, '::Lectures::|::Textbooks::|::Error|Slide_|Page_'), false)""",
)
def group_gate(spark, sf):
    """Approved rows without a forbidden tag, of sources of which at most a seventh was refused."""
    rows = read_table(spark, sf, "curriculum_records")
    refused = F.coalesce(F.col("status") == "rejected_or_hidden", F.lit(False))
    fit = rows.groupBy("source").agg(F.count_if(refused).alias("bad"), F.count("*").alias("n")).where("bad * 7 <= n").select("source")
    forbidden = F.coalesce(F.col("approved_tag").rlike("::Lectures::|::Textbooks::|::Error|Slide_|Page_"), F.lit(False))
    return rows.where((F.col("status") == "approved") & ~forbidden).join(fit, "source").select("record_id", "ingested_at")


@register("JN-11", "SELECT c.chunk_id, c.ingested_at, CASE WHEN text IS NULL OR trim(text) = '' THEN 'blank' WHEN length(text) < 200 THEN 'short' ELSE 'unmapped' END AS class FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunks t WHERE t.chunk_id = c.chunk_id AND t.candidate_tags <> '[]')")
def without_candidates(spark, sf):
    chunks = read_table(spark, sf, "chunks")
    tagged = chunks.where("candidate_tags <> '[]'").select("chunk_id").distinct()
    kind = F.when(F.col("text").isNull() | (F.trim("text") == ""), "blank").when(F.char_length("text") < 200, "short").otherwise("unmapped")
    return chunks.join(tagged, "chunk_id", "left_anti").select("chunk_id", "ingested_at", kind.alias("class"))


@register("ORC-01", "SELECT package_id, coalesce(min(root), 'none') AS root FROM segments_indexable GROUP BY package_id HAVING count(*) FILTER (WHERE tag_basis = 'smoothed_short_island' AND NOT indexable) = 0")
def pending(spark, sf):
    """Packages none of whose segments was held back as a short island."""
    held = F.count_if((F.col("tag_basis") == "smoothed_short_island") & ~F.col("indexable"))
    return read_table(spark, sf, "segments_indexable").groupBy("package_id").agg(F.coalesce(F.min("root"), F.lit("none")).alias("root"), held.alias("n")).where("n = 0").drop("n")


# --- evaluation


_GRID = """g AS (SELECT entity_id, kind, lower(q) AS q, lower(entity_name) AS name FROM (SELECT entity_id, entity_name, unnest(['exact_name', 'abbreviation', 'entity_plus_organ', 'entity_plus_morphology']) AS kind,
         unnest([entity_name, nullif(abbreviation, ''), entity_name || ' ' || root, string_split(entity_name, ' of ')[1]]) AS q FROM canonical_entities) WHERE q IS NOT NULL),
       r AS (SELECT source_name, lower(entity_name) AS e, title, source_url, hit_rank, record_id FROM gi_crc_standalone QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) = 1),
       v AS (SELECT source_name, e, count(*) AS n, count(source_url) AS urls FROM r WHERE e IS NOT NULL AND source_name IS NOT NULL GROUP BY ALL),
       src AS (SELECT DISTINCT source_name FROM r WHERE source_name IS NOT NULL),
       h AS (SELECT g.entity_id, g.kind, s.source_name, f.figures, sum(CASE WHEN f.figures THEN v.urls ELSE v.n END) AS hits, sum(CASE WHEN contains(v.e, g.name) THEN CASE WHEN f.figures THEN v.urls ELSE v.n END ELSE 0 END) AS right_hits
             FROM g CROSS JOIN src s CROSS JOIN (SELECT unnest([false, true]) AS figures) f LEFT JOIN v ON v.source_name = s.source_name AND contains(v.e, g.q) GROUP BY ALL),
       c AS (SELECT *, CASE WHEN coalesce(hits, 0) = 0 THEN CASE WHEN figures THEN 'no_figures' ELSE 'no_hits' END WHEN coalesce(right_hits, 0) = 0 THEN 'wrong_entity' ELSE 'found' END AS outcome FROM h)"""


def _grid(spark, sf):
    """Every entity's queries against every source with and without figures: entity_id, kind, source_name, figures, outcome.

    Queries and entries are a fixed list; hits are sought among distinct values.
    """
    name = F.lower("entity_name")
    kinds = {"exact_name": name, "abbreviation": F.nullif(F.lower("abbreviation"), F.lit("")), "entity_plus_organ": F.lower(F.concat("entity_name", F.lit(" "), "root")), "entity_plus_morphology": F.lower(F.split("entity_name", " of ")[0])}
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), q.alias("q")) for k, q in kinds.items())))
    queries = read_table(spark, sf, "canonical_entities").select("entity_id", name.alias("name"), asked.alias("a")).select("entity_id", "name", "a.*").where("q is not null")
    rows = current_rows(read_table(spark, sf, "gi_crc_standalone"), "record_id", ["source_name", "entity_name", "source_url"]).where("source_name is not null")
    values = rows.where("entity_name is not null").groupBy("source_name", F.lower("entity_name").alias("e")).agg(F.count("*").alias("n"), F.count("source_url").alias("urls"))
    met = values.join(F.broadcast(queries), F.contains("e", F.col("q")))
    right = F.contains("e", F.col("name")).cast("bigint")
    hits = met.groupBy("entity_id", "kind", "source_name").agg(*(F.sum(F.col(c) * w).alias(a) for a, c, w in (("hits", "n", F.lit(1)), ("right", "n", right), ("fig_hits", "urls", F.lit(1)), ("fig_right", "urls", right))))
    cells = queries.select("entity_id", "kind").crossJoin(rows.select("source_name").distinct())  # a fixed list by the few sources
    both = cells.join(hits, ["entity_id", "kind", "source_name"], "left").na.fill(0)
    outcome = lambda h, r, none: F.when(F.col(h) == 0, none).when(F.col(r) == 0, "wrong_entity").otherwise("found")
    pair = F.explode(F.array(F.struct(F.lit(False).alias("figures"), outcome("hits", "right", "no_hits").alias("outcome")), F.struct(F.lit(True).alias("figures"), outcome("fig_hits", "fig_right", "no_figures").alias("outcome"))))
    return both.select("entity_id", "kind", "source_name", pair.alias("o")).select("entity_id", "kind", "source_name", "o.*")


@register("EVL-02", f"WITH {_GRID} SELECT entity_id, kind, source_name, figures, outcome FROM c")
def outcomes(spark, sf):
    return _grid(spark, sf)


@register("EVL-03", f"WITH {_GRID} SELECT kind, source_name, figures, count(*) AS queries, count(*) FILTER (WHERE outcome = 'found') AS found, round(100.0 * count(*) FILTER (WHERE outcome = 'found') / count(*), 2) AS rate FROM c GROUP BY ALL")
def benchmark(spark, sf):
    found = F.count_if(F.col("outcome") == "found")
    return _grid(spark, sf).groupBy("kind", "source_name", "figures").agg(F.count("*").alias("queries"), found.alias("found"), F.round(100.0 * found / F.count("*"), 2).alias("rate"))


@register("EVL-04", f"WITH {_GRID} SELECT entity_id, kind, source_name, outcome FROM c WHERE NOT figures AND outcome <> 'found'")
def replayed(spark, sf):
    """Misses of a stored run, judged again from what was written."""
    from tessera.session import work_folder
    from tessera.sources import readers, sinks

    path = work_folder(spark)
    sinks.write_jsonl(_grid(spark, sf), path, gzip=True)
    stored = readers.jsonl_strict(spark, path, "entity_id int, kind string, source_name string, figures boolean, outcome string")
    return stored.where("not figures and outcome <> 'found'").select("entity_id", "kind", "source_name", "outcome")


@register(
    "ORC-12",
    """WITH t AS (SELECT tag_id, list_distinct(list_filter(regexp_extract_all(lower(replace(array_to_string(list_slice(string_split(primary_tag, '::'), -2, -1), ' '), '_', ' ')), '[a-z0-9]+'), lambda x: length(x) > 1)) AS w FROM canonical_tags),
       q AS (SELECT tag_id, len(w) AS k, unnest(w) AS term FROM t), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents),
       h AS (SELECT tag_id, k, doc_id, count(*) AS n FROM q JOIN d USING (term) GROUP BY ALL)
       SELECT t.tag_id, count(*) FILTER (WHERE n = k) AS documents, count(doc_id) AS near FROM t LEFT JOIN h USING (tag_id) GROUP BY t.tag_id""",
)
def probes(spark, sf):
    """For every tag the query it suggests, and how many documents have all or any of its words."""
    words = T.tokens(F.replace(F.array_join(F.slice(F.split("primary_tag", "::"), -2, 2), " "), F.lit("_"), F.lit(" ")))
    tags = cut_lineage(read_table(spark, sf, "canonical_tags").select("tag_id", F.array_distinct(F.filter(words, lambda w: F.length(w) > 1)).alias("w")))
    asked = tags.select("tag_id", F.size("w").alias("k"), F.explode("w").alias("term"))
    wanted = [r[0] for r in asked.select("term").distinct().collect()]  # words of a fixed list
    hits = postings(spark, sf).of(wanted).join(F.broadcast(asked), "term").groupBy("tag_id", "k", "doc_id").agg(F.count("*").alias("n"))
    found = hits.groupBy("tag_id").agg(F.count_if(F.col("n") == F.col("k")).alias("documents"), F.count("*").alias("near"))
    return tags.select("tag_id").join(found, "tag_id", "left").na.fill(0)


# --- links


_LINKS = (
    ("journal_virchows", "chunk_id", "source_url", ""), ("journal_virchows", "chunk_id", "doi", "https://doi.org/"), ("gi_crc_standalone", "record_id", "source_url", ""),
    ("records", "record_id", "url", ""), ("tag_records", "record_id", "url", ""), ("segments_indexable", "segment_id", "video_url", ""),
)


@register(
    "PRJ-09",
    "WITH u AS (" + " UNION ALL ".join(f"SELECT {i} AS f, {k} AS id, '{p}' || {c} AS url FROM {t} WHERE {c} <> ''" for i, (t, k, c, p) in enumerate(_LINKS)) + "), o AS (SELECT url, min((f, id)) AS first FROM u GROUP BY url) SELECT url, row_number() OVER (ORDER BY first)::INT AS n FROM o QUALIFY n <= 48",
)
def citation_index(spark, sf):
    """The first 48 different links over six fields, in order of field and record."""
    parts = [read_table(spark, sf, t).where(F.col(c) != "").select(F.lit(i).alias("f"), F.col(k).alias("id"), F.concat(F.lit(p), c).alias("url")) for i, (t, k, c, p) in enumerate(_LINKS)]
    first = reduce(lambda a, b: a.unionByName(b), parts).groupBy("url").agg(F.min(F.struct("f", "id")).alias("first")).orderBy("first").limit(48)
    return first.select("url", F.row_number().over(Window.orderBy("first")).alias("n"))




# --- ontology rows


@register(
    "WIN-26",
    """SELECT r_name AS major, n_name AS organ, CASE WHEN s_suppkey % 2 = 1 THEN 'odd' END AS section, s_name || ' of ' || s_suppkey AS item,
         row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey, s_suppkey % 2, s_suppkey)::INT AS number FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def outlined(spark, sf):
    """Suppliers written as an outline of regions, nations and sections, with wrapped lines, and read back from it."""
    from tessera.operators.sequence import outline

    region, nation, supplier = (read_table(spark, sf, t) for t in ("region", "nation", "supplier"))
    held = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    lines = (
        region.select("r_regionkey", F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(-1).cast("bigint").alias("c"), F.lit(0).alias("d"), F.concat((F.col("r_regionkey") + 1).cast("string"), F.lit(". "), "r_name").alias("line"))
        .unionByName(held.select("r_regionkey", F.col("n_nationkey").alias("a"), F.lit(-1).alias("b"), F.lit(-1).cast("bigint").alias("c"), F.lit(0).alias("d"), F.concat(F.lit("A) "), "n_name").alias("line")))
        .unionByName(held.select("r_regionkey", F.col("n_nationkey").alias("a"), F.lit(1).alias("b"), F.lit(-1).cast("bigint").alias("c"), F.lit(0).alias("d"), F.lit("* odd").alias("line")))
    )
    rows = supplier.join(held, F.col("s_nationkey") == F.col("n_nationkey")).select("r_regionkey", F.col("n_nationkey").alias("a"), (F.col("s_suppkey") % 2).cast("int").alias("b"), F.col("s_suppkey").alias("c"), F.explode(F.array(F.struct(F.lit(0).alias("d"), F.concat(F.lit("- "), "s_name").alias("line")), F.struct(F.lit(1).alias("d"), F.concat(F.lit("   of "), F.col("s_suppkey").cast("string")).alias("line")))).alias("x")).select("r_regionkey", "a", "b", "c", "x.*")
    levels = [("major", r"^[0-9]+\. (.*)$"), ("organ", r"^A\) (.*)$"), ("section", r"^\* (.*)$")]
    return outline(lines.unionByName(rows), "r_regionkey", ["a", "b", "c", "d"], "line", levels, r"^- (.*)$").drop("r_regionkey")


@register(
    "PRJ-15",
    """WITH p AS (SELECT tag_id, tag_root, primary_tag, split_part(primary_tag, '::', 2) AS organ, split_part(primary_tag, '::', 3) AS leaf FROM canonical_tags)
       SELECT tag_id, CASE WHEN tag_root = 'Cyto' THEN 'cytology' WHEN tag_root IN ('GI', 'GU', 'GYN') THEN 'viscera' WHEN tag_root IN ('Heme', 'Neuro') THEN 'systems' ELSE 'other' END AS section,
         CASE WHEN tag_root IN ('GI', 'GU', 'GYN', 'Heme', 'Neuro') THEN primary_tag ELSE 'Spec::' || lower(tag_root) || '::' || organ || '::' || leaf END AS tag,
         CASE WHEN organ = '' OR starts_with(organ, '(') OR regexp_full_match(organ, '[0-9]+') OR length(organ) < 4 THEN 'General' ELSE replace(organ, '_', ' ') END AS subcategory FROM p""",
)
def projected_leaves(spark, sf):
    """Leaves of sections with tags of their own keep them, others are wrapped; what is no organ goes under General."""
    parts = F.split("primary_tag", "::")
    organ, leaf, root = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("")), F.col("tag_root")
    section = F.when(root == "Cyto", "cytology").when(root.isin("GI", "GU", "GYN"), "viscera").when(root.isin("Heme", "Neuro"), "systems").otherwise("other")
    tag = F.when(section.isin("viscera", "systems"), F.col("primary_tag")).otherwise(F.concat_ws("::", F.lit("Spec"), F.lower(root), organ, leaf))
    general = (organ == "") | organ.startswith("(") | organ.rlike("^[0-9]+$") | (F.length(organ) < 4)
    return read_table(spark, sf, "canonical_tags").select("tag_id", section.alias("section"), tag.alias("tag"), F.when(general, "General").otherwise(F.replace(organ, F.lit("_"), F.lit(" "))).alias("subcategory"))


_PRIORS = ("GI::Colon", "GI::", "HN::")


@register(
    "RNK-08",
    f"""WITH l AS (SELECT tag_id, primary_tag, lower(replace(split_part(primary_tag, '::', 3), '_', ' ')) AS phrase, len(string_split(primary_tag, '::')) AS depth FROM canonical_tags),
       lw AS (SELECT *, list_distinct(list_filter(regexp_extract_all(phrase, '[a-z0-9]+'), lambda x: length(x) > 2)) AS w FROM l),
       d AS (SELECT doc_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents WHERE title IS NOT NULL), dw AS (SELECT *, list_distinct(string_split(t, ' ')) AS w FROM d),
       o AS (SELECT doc_id, tag_id, primary_tag, depth, len(lw.w) AS k, list_intersect(lw.w, dw.w) AS o, CASE WHEN contains(t, phrase) THEN CASE WHEN length(phrase) >= 10 THEN 10 + least(length(phrase) / 8.0, 5.0) WHEN length(phrase) >= 6 THEN 4.5 ELSE 0 END ELSE 0 END AS p FROM lw JOIN dw ON len(list_intersect(lw.w, dw.w)) > 0),
       s AS (SELECT doc_id, tag_id, p + list_sum(list_transform(o, lambda x: 1.6 + least(length(x) / 5.0, 2.5))) + 0.12 * depth + 0.08 * k
               + CASE {' '.join(f"WHEN starts_with(primary_tag, '{x}') THEN {2.0 - 0.15 * i}" for i, x in enumerate(_PRIORS))} ELSE 0 END AS score, p > 0 OR len(o) >= 2 OR list_max(list_transform(o, lambda x: length(x))) >= 8 AS ok FROM o)
       SELECT doc_id, tag_id, round(score, 6)::DOUBLE AS score FROM s WHERE ok QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, tag_id) <= 3""",
)
def leaf_scores(spark, sf):
    """The three leaves that a title speaks for most: its phrase, its words by length, its depth, and where it stands."""
    parts = F.split("primary_tag", "::")
    phrase = F.lower(F.replace(F.element_at(parts, 3), F.lit("_"), F.lit(" ")))
    words = F.array_distinct(F.filter(F.regexp_extract_all(phrase, F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.length(x) > 2))
    prior = F.lit(0.0)
    for i, x in reversed(list(enumerate(_PRIORS))):
        prior = F.when(F.col("primary_tag").startswith(x), 2.0 - 0.15 * i).otherwise(prior)
    leaves = read_table(spark, sf, "canonical_tags").select("tag_id", phrase.alias("phrase"), (0.12 * F.size(parts) + 0.08 * F.size(words) + prior).alias("base"), F.explode(words).alias("w"))
    titles = read_table(spark, sf, "documents").where("title is not null").select("doc_id", T.normalize(F.col("title")).alias("t"))
    said = titles.select("doc_id", "t", F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    met = said.join(F.broadcast(leaves), "w").groupBy("doc_id", "tag_id").agg(F.first("t").alias("t"), F.first("phrase").alias("phrase"), F.first("base").alias("base"), F.sum(1.6 + F.least(F.length("w") / 5.0, F.lit(2.5))).alias("o"), F.count("*").alias("n"), F.max(F.length("w")).alias("longest"))
    p = F.when(F.contains("t", F.col("phrase")), F.when(F.length("phrase") >= 10, 10 + F.least(F.length("phrase") / 8.0, F.lit(5.0))).when(F.length("phrase") >= 6, 4.5).otherwise(0.0)).otherwise(0.0)
    scored = met.withColumn("p", p).where("p > 0 or n >= 2 or longest >= 8").select("doc_id", "tag_id", F.round(F.col("p") + F.col("o") + F.col("base"), 6).alias("score"))
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "tag_id"))).where("_n <= 3").drop("_n")


@register(
    "JN-18",
    """WITH v AS (SELECT DISTINCT trim(regexp_replace(lower(entity_name), '[^a-z0-9]+', ' ', 'g')) AS v, lower(coalesce(section, '')) AS page FROM gi_crc_standalone WHERE entity_name IS NOT NULL), vw AS (SELECT *, list_distinct(string_split(v, ' ')) AS w FROM v WHERE v <> ''),
       e AS (SELECT entity_id, trim(regexp_replace(lower(entity_name), '[^a-z0-9]+', ' ', 'g')) AS e, lower(string_split(entity_name, ' of the ')[-1]) AS organ FROM canonical_entities), ew AS (SELECT *, list_distinct(list_filter(string_split(e, ' '), lambda x: length(x) > 3)) AS x, string_split(e, ' ')[1] AS subtype FROM e),
       s AS (SELECT v, page, entity_id, len(list_intersect(w, x)) / len(x) + CASE WHEN contains(v, organ) OR contains(page, organ) THEN 0.2 ELSE 0 END - CASE WHEN NOT list_contains(w, subtype) THEN 0.3 ELSE 0 END AS s FROM vw JOIN ew ON len(list_intersect(w, x)) > 0)
       SELECT v AS value, page, entity_id, round(s, 6)::DOUBLE AS score FROM s WHERE s >= 0.5 QUALIFY row_number() OVER (PARTITION BY v, page ORDER BY round(s, 6) DESC, entity_id) = 1""",
)
def context_match(spark, sf):
    """The entry that shares most words with a value, favoured by the organ of value or page, less where the entry names a subtype the value doesn't."""
    rows = read_table(spark, sf, "gi_crc_standalone").where("entity_name is not null").select(T.normalize(F.col("entity_name")).alias("value"), F.lower(F.coalesce("section", F.lit(""))).alias("page")).where("value <> ''").distinct()
    name = T.normalize(F.col("entity_name"))
    words = F.array_distinct(F.filter(F.split(name, " "), lambda x: F.length(x) > 3))
    entries = read_table(spark, sf, "canonical_entities").select("entity_id", F.lower(F.element_at(F.split("entity_name", " of the "), -1)).alias("organ"), F.split(name, " ")[0].alias("subtype"), F.size(words).alias("k"), F.explode(words).alias("w"))
    said = rows.select("value", "page", F.explode(F.array_distinct(F.split("value", " "))).alias("w"))
    met = said.join(F.broadcast(entries), "w").groupBy("value", "page", "entity_id").agg(F.count("*").alias("n"), F.first("k").alias("k"), F.first("organ").alias("organ"), F.first("subtype").alias("subtype"))
    there = F.contains("value", F.col("organ")) | F.contains("page", F.col("organ"))
    lacks = ~F.array_contains(F.split("value", " "), F.col("subtype"))
    raw = F.col("n") / F.col("k") + F.when(there, 0.2).otherwise(0.0) - F.when(lacks, 0.3).otherwise(0.0)
    scored = met.withColumn("raw", raw).where("raw >= 0.5").select("value", "page", "entity_id", F.round("raw", 6).alias("score"))
    best = scored.groupBy("value", "page").agg(F.max(F.struct("score", (-F.col("entity_id")).alias("n"))).alias("x"))
    return best.select("value", "page", (-F.col("x.n")).alias("entity_id"), F.col("x.score").alias("score"))


# --- topics, gates and phrases


_POSITIVE, _BLOCKED = ("colon", "colorectal", "rectal", "bowel"), ("breast", "prostate", "salivary", "cervix", "thyroid")
_GENES = r"\bagent [A-Z]+[0-9]+-[0-9]+"


@register(
    "FLT-09",
    f"""WITH t AS (SELECT doc_id, lower(coalesce(title, '') || ' ' || coalesce(text, '')) AS t, regexp_matches(coalesce(text, ''), '{_GENES}') AS gene FROM documents)
       SELECT doc_id, CASE WHEN gene THEN 'kept, gene' WHEN regexp_matches(t, '{'|'.join(_BLOCKED)}') AND NOT regexp_matches(t, '{'|'.join(_POSITIVE)}') THEN 'other organ' WHEN NOT regexp_matches(t, '{'|'.join(TERMS)}') THEN 'no distinctive word' ELSE 'kept' END AS outcome FROM t""",
)
def on_topic(spark, sf):
    """Which texts speak of what was asked: those on genes always, none of other organs alone, none without a distinctive word."""
    t = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    rows = read_table(spark, sf, "documents").select("doc_id", t.alias("t"), F.coalesce("text", F.lit("")).rlike(_GENES).alias("gene"))
    other = F.col("t").rlike("|".join(_BLOCKED)) & ~F.col("t").rlike("|".join(_POSITIVE))
    return rows.select("doc_id", F.when(F.col("gene"), "kept, gene").when(other, "other organ").when(~F.col("t").rlike("|".join(TERMS)), "no distinctive word").otherwise("kept").alias("outcome"))


@register(
    "FLT-13",
    f"""WITH p AS (SELECT package_id, least(greatest(max(coalesce(end_sec, start_sec)) * 0.025, 80), 160) AS opening, max(coalesce(end_sec, start_sec)) - 80 AS closing FROM segments_indexable GROUP BY package_id)
       SELECT segment_id, ingested_at, CASE WHEN start_sec <= opening THEN 'opening' WHEN start_sec >= closing THEN 'closing' WHEN regexp_matches(coalesce(text, ''), '{_sql(Q.any_of(Q.HOUSEKEEPING))}') THEN 'cue' WHEN text IS NULL OR len(string_split(trim(text), ' ')) < 5 THEN 'few words' END AS housekeeping
       FROM segments_indexable JOIN p USING (package_id)""",
)
def housekeeping(spark, sf):
    """Segments at either end of a lecture, with a cue of housekeeping, or of few words."""
    rows = read_table(spark, sf, "segments_indexable")
    end = F.max(F.coalesce("end_sec", "start_sec"))
    spans = rows.groupBy("package_id").agg(F.least(F.greatest(end * 0.025, F.lit(80)), F.lit(160)).alias("opening"), (end - 80).alias("closing"))
    start, text = F.col("start_sec"), F.col("text")
    why = F.when(start <= F.col("opening"), "opening").when(start >= F.col("closing"), "closing").when(F.coalesce(text, F.lit("")).rlike(Q.any_of(Q.HOUSEKEEPING)), "cue").when(text.isNull() | (F.size(F.split(F.trim(text), " ")) < 5), "few words")
    return rows.join(spans, "package_id").select("segment_id", "ingested_at", why.alias("housekeeping"))


@register(
    "FLT-28",
    """WITH e AS (SELECT vec_id, label AS prior, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
       s AS (SELECT e.vec_id, e.prior, c.label, round(list_dot_product(e.v, x.v), 6) AS s FROM e CROSS JOIN c JOIN e x ON x.vec_id = c.vec_id),
       t AS (SELECT vec_id, prior, list({'s': s, 'l': label} ORDER BY s DESC, label) AS t FROM s GROUP BY vec_id, prior)
       SELECT vec_id, t[1].l AS label, CASE WHEN t[1].s < 0.3 THEN 'low similarity' WHEN t[1].l <> prior AND t[1].s < 0.3 + 0.08 THEN 'off prior, weak' WHEN t[1].l <> prior AND t[1].s - t[2].s < 0.02 THEN 'off prior, close'
         WHEN round(t[1].s - t[2].s, 6) < 0.035 AND t[1].l // 4 <> t[2].l // 4 THEN 'ambiguous' WHEN t[1].l <> prior AND t[1].s < 0.3 + 0.06 THEN 'no signal' ELSE 'pass' END AS gate FROM t""",
)
def semantic_gate(spark, sf):
    """The nearest leaf of a row and the first reason to refuse it; near leaves of one branch don't make it ambiguous."""
    from tessera.operators.joins import first_per_key
    from tessera.operators.vector import closest_entries

    rows = read_table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    leaves = first_per_key(rows, ["label"], [F.col("vec_id")]).select("label", "embedding")
    top = closest_entries(rows, "vec_id", "embedding", leaves, "label", 2).groupBy("vec_id")
    pick = lambda i, c: F.max(F.when(F.col("rank") == i, F.col(c)))
    both = top.agg(pick(1, "score").alias("a"), pick(2, "score").alias("b"), pick(1, "label").alias("l"), pick(2, "label").alias("m"))
    known = both.join(rows.select("vec_id", F.col("label").alias("prior")), "vec_id")
    off, margin = F.col("l") != F.col("prior"), F.col("a") - F.col("b")
    gate = F.when(F.col("a") < 0.3, "low similarity").when(off & (F.col("a") < 0.3 + 0.08), "off prior, weak").when(off & (margin < 0.02), "off prior, close")
    gate = gate.when((F.round(margin, 6) < 0.035) & (F.floor(F.col("l") / 4) != F.floor(F.col("m") / 4)), "ambiguous").when(off & (F.col("a") < 0.3 + 0.06), "no signal").otherwise("pass")
    return known.select("vec_id", F.col("l").alias("label"), gate.alias("gate"))


_SIGNALS = ("cyst", "polyp", "fibroma", "carcinoma", "sarcoma", "lymphoma", "granuloma", "xanthoma")


@register(
    "AGG-13",
    f"""WITH d AS (SELECT root, string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents WHERE title IS NOT NULL AND root IS NOT NULL),
       g AS (SELECT root, unnest(w) AS phrase, 1 AS n FROM d UNION ALL SELECT root, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))), 2 FROM d UNION ALL SELECT root, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))), 3 FROM d),
       l AS (SELECT DISTINCT lower(replace(split_part(primary_tag, '::', 3), '_', ' ')) AS phrase FROM canonical_tags),
       s AS (SELECT root, phrase, sum(CASE n WHEN 1 THEN CASE WHEN phrase IN {_SIGNALS} THEN CASE WHEN length(phrase) >= 8 THEN 5 ELSE 3 END ELSE 0 END WHEN 2 THEN 2 ELSE 3 END) + CASE WHEN phrase IN (SELECT phrase FROM l) THEN 1000 ELSE 0 END AS weight FROM g WHERE phrase <> '' GROUP BY root, phrase),
       t AS (SELECT * FROM s WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY root ORDER BY weight DESC, phrase) <= 15),
       k AS (SELECT root, list_reduce(list(phrase ORDER BY weight DESC, phrase), lambda a, x: CASE WHEN len(list_filter(string_split(a, '|'), lambda y: contains(y, x) OR contains(x, y))) > 0 THEN a ELSE a || '|' || x END) AS kept FROM t GROUP BY root)
       SELECT root, array_to_string(string_split(kept, '|')[1:5], '|') AS phrases FROM k""",
)
def weighted_phrases(spark, sf):
    """The five phrases that weigh most in a root's titles, none within another: words that signal, pairs, triples, and leaves far above all."""
    words = F.split(T.normalize(F.col("title")), " ")
    rows = read_table(spark, sf, "documents").where("title is not null and root is not null").select("root", words.alias("w"))
    weight = lambda x: F.when(x.isin(*_SIGNALS), F.when(F.length(x) >= 8, 5).otherwise(3)).otherwise(0)
    grams = [F.transform("w", lambda x: F.struct(x.alias("phrase"), weight(x).alias("v")))]

    def of(n: int):
        size = F.greatest(F.size("w") - n + 1, F.lit(0))
        starts = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.array_join(F.slice("w", i, n), " ").alias("phrase"), F.lit(n).alias("v")))

    grams += [of(2), of(3)]
    counted = rows.select("root", F.explode(F.concat(*grams)).alias("g")).where("g.phrase <> ''").groupBy("root", "g.phrase").agg(F.sum("g.v").alias("v"))
    leaves = read_table(spark, sf, "canonical_tags").select(F.lower(F.replace(F.element_at(F.split("primary_tag", "::"), 3), F.lit("_"), F.lit(" "))).alias("phrase")).distinct().withColumn("leaf", F.lit(1000))
    scored = counted.join(F.broadcast(leaves), "phrase", "left").select("root", "phrase", (F.col("v") + F.coalesce("leaf", F.lit(0))).alias("v")).where("v > 0")
    top = scored.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("v"), "phrase"))).where("n <= 15")
    listed = top.groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "phrase"))), lambda x: x["phrase"]).alias("l"))
    kept = F.aggregate("l", F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.contains(y, x) | F.contains(x, y)), a).otherwise(F.concat(a, F.array(x))))
    return listed.select("root", F.array_join(F.slice(kept, 1, 5), "|").alias("phrases"))


_CLUSTER = ("carcinoma", "necrosis", "margin")


@register(
    "RNK-05",
    f"""WITH h AS (SELECT doc_id, lower(coalesce(text, '')) AS t, lower(coalesce(title, '')) AS title, root, source, doc_kind, {' + '.join(f"contains(lower(coalesce(text, '')), '{c}')::INT" for c in _CLUSTER)} AS hits FROM documents),
       s AS (SELECT doc_id, CASE WHEN doc_kind = 'stub' THEN 0 ELSE least(1.0, CASE WHEN contains(t, 'squamous carcinoma') OR contains(title, 'carcinoma') THEN 0.56 ELSE 0 END + CASE WHEN hits = 3 THEN 0.28 WHEN hits = 2 THEN 0.18 ELSE 0 END
         + CASE WHEN root = 'GI' THEN 0.16 ELSE 0 END + CASE WHEN {' OR '.join(f"contains(title, '{c}')" for c in _CLUSTER)} THEN 0.12 ELSE 0 END + CASE WHEN source IS NULL THEN 0.04 ELSE 0 END) END AS s FROM h)
       SELECT doc_id, round(s, 6)::DOUBLE AS score, CASE WHEN round(s, 6) >= 0.9 THEN 'high' WHEN round(s, 6) >= 0.7 THEN 'medium' ELSE 'low' END AS band FROM s""",
)
def candidate_score(spark, sf):
    """How well a document fits a tag: its phrase, its cluster of words, root, title, and whether it has a source already."""
    text, title = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    hits = reduce(add, (F.contains(text, F.lit(c)).cast("int") for c in _CLUSTER))
    exact = F.contains(text, F.lit("squamous carcinoma")) | F.contains(title, F.lit("carcinoma"))
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    score = part(exact, 0.56) + F.when(hits == 3, 0.28).when(hits == 2, 0.18).otherwise(0.0) + part(F.col("root") == "GI", 0.16) + part(title.rlike("|".join(_CLUSTER)), 0.12) + part(F.col("source").isNull(), 0.04)
    rows = read_table(spark, sf, "documents").select("doc_id", F.round(F.when(F.col("doc_kind") == "stub", 0.0).otherwise(F.least(F.lit(1.0), score)), 6).alias("score"))
    return rows.select("doc_id", "score", F.when(F.col("score") >= 0.9, "high").when(F.col("score") >= 0.7, "medium").otherwise("low").alias("band"))


_PRIORITY = ("textbooks", "pathout", "lectures")


@register(
    "RNK-10",
    f"""WITH h AS (SELECT title, primary_tag, coalesce(tag_authority = 'curriculum', false) AS strong, coalesce(list_position({list(_PRIORITY)}, source), 9) AS p, record_id FROM records WHERE primary_tag IS NOT NULL AND tag_root IS NOT NULL AND title IS NOT NULL)
       SELECT title, arg_min(primary_tag, (NOT strong, p, record_id, primary_tag)) AS chosen, count(*) FILTER (WHERE strong) AS strong FROM h GROUP BY title""",
)
def priority_choice(spark, sf):
    """Of a title's tags a strong one first, then by the order of sources."""
    p = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in _PRIORITY)), F.col("source")), F.lit(0)), F.lit(9))
    strong = F.coalesce(F.col("tag_authority") == "curriculum", F.lit(False))
    rows = read_table(spark, sf, "records").where("primary_tag is not null and tag_root is not null and title is not null").select("title", "primary_tag", "record_id", p.alias("p"), strong.alias("strong"))
    return rows.groupBy("title").agg(F.min_by("primary_tag", F.struct((~F.col("strong")).alias("w"), "p", "record_id", "primary_tag")).alias("chosen"), F.count_if("strong").alias("strong"))


_FACT = "([A-Z][^.]*mitos[^.]*[.])"


@register(
    "EVL-07",
    f"""WITH d AS (SELECT source, doc_id, regexp_extract(coalesce(text, ''), '{_FACT}', 1) AS fact, substr(text, 1, 60) AS e FROM documents WHERE source IS NOT NULL),
       r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM d WHERE e IS NOT NULL)
       SELECT s.source, coalesce((SELECT arg_min(fact, doc_id) FROM d WHERE d.source = s.source AND fact <> ''), (SELECT string_agg(e, ' | ' ORDER BY n) FROM r WHERE r.source = s.source AND n <= 8)) AS facts FROM (SELECT DISTINCT source FROM d) s""",
)
def key_facts(spark, sf):
    """A source's first sentence on what was asked, or the beginnings of its first eight texts."""
    rows = read_table(spark, sf, "documents").where("source is not null").select("source", "doc_id", F.regexp_extract(F.coalesce("text", F.lit("")), _FACT, 1).alias("fact"), F.substring("text", 1, 60).alias("e"))
    facts = rows.groupBy("source").agg(F.min_by(F.when(F.col("fact") != "", F.col("fact")), F.when(F.col("fact") != "", F.col("doc_id"))).alias("fact"))
    first = rows.where("e is not null").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("n <= 8")
    texts = first.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "e"))), lambda x: x["e"]), " | ").alias("texts"))
    return facts.join(texts, "source", "left").select("source", F.coalesce("fact", "texts").alias("facts"))


@register(
    "ORC-05",
    """WITH ev AS (SELECT primary_tag, record_id, source, row_number() OVER (PARTITION BY primary_tag ORDER BY source, record_id) AS n, count(*) OVER (PARTITION BY primary_tag) AS total FROM (SELECT DISTINCT primary_tag, record_id, source FROM records WHERE primary_tag IS NOT NULL AND source IS NOT NULL)),
       p AS (SELECT primary_tag, string_agg(record_id, ',' ORDER BY n) AS cards, max(total) AS evidence FROM ev WHERE n <= 3 GROUP BY 1), b AS (SELECT primary_tag, count(DISTINCT source) AS sources FROM ev GROUP BY 1)
       SELECT t.tag_id, lower(replace(array_to_string(list_slice(string_split(t.primary_tag, '::'), -2, -1), ' '), '_', ' ')) AS query, coalesce(cards, '') AS cards, coalesce(evidence, 0) AS evidence, coalesce(sources, 0) AS sources, cards IS NOT NULL AS ok
       FROM canonical_tags t LEFT JOIN p USING (primary_tag) LEFT JOIN b USING (primary_tag)""",
)
def pages(spark, sf):
    """A page per tag: the query it stands for, its first three records, what they were chosen from, and whether there is an answer."""
    records = read_table(spark, sf, "records").where("primary_tag is not null and source is not null").select("primary_tag", "record_id", "source").distinct()
    counts = records.groupBy("primary_tag").agg(F.count("*").alias("evidence"), F.countDistinct("source").alias("sources"))
    first = records.withColumn("n", F.row_number().over(Window.partitionBy("primary_tag").orderBy("source", "record_id"))).where("n <= 3")
    cards = first.groupBy("primary_tag").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "record_id"))), lambda x: x["record_id"]), ",").alias("cards"))
    query = F.lower(F.replace(F.array_join(F.slice(F.split("primary_tag", "::"), -2, 2), " "), F.lit("_"), F.lit(" ")))
    tags = read_table(spark, sf, "canonical_tags").select("tag_id", "primary_tag", query.alias("query"))
    return tags.join(counts, "primary_tag", "left").join(cards, "primary_tag", "left").select("tag_id", "query", F.coalesce("cards", F.lit("")).alias("cards"), F.coalesce("evidence", F.lit(0)).alias("evidence"), F.coalesce("sources", F.lit(0)).alias("sources"), F.col("cards").isNotNull().alias("ok"))
