"""Named queries on understanding requests, each over a table of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import requests as R
from tessera.operators.lexical import query_terms
from tessera.plans.ranking import bm25_sql, lexical_rank_sql, postings
from tessera.plans.registry import Registry
from tessera.sources.tables import read_table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@register(
    "QRY-01",
    f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(title), '[a-z0-9_]+'), lambda t: length(t) > 1 AND t NOT IN {_in(T.STOPWORDS)})[1:12] AS t FROM documents WHERE title IS NOT NULL),
       q AS (SELECT doc_id, list_transform(t, lambda x: '"' || x || '"') AS q FROM t)
       SELECT doc_id, CASE WHEN len(q) = 0 THEN NULL ELSE array_to_string(q, ' AND ') END AS strict, CASE WHEN len(q) > 1 THEN array_to_string(q, ' OR ') END AS loose FROM q""",
)
def match_expressions(spark, sf):
    terms = F.filter(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(*T.STOPWORDS))
    q = R.match_queries(terms)
    return read_table(spark, sf, "documents").where("title is not null").select("doc_id", F.try_element_at(q, F.lit(1)).alias("strict"), F.try_element_at(q, F.lit(2)).alias("loose"))


_MODES = ("replace", "append", "either")


def _governed(spark, sf) -> R.Governance:
    """Rules from the fixed list of entities with an abbreviation; the organs of the fixed list of tags hint at their root."""
    entities = read_table(spark, sf, "canonical_entities").where("abbreviation is not null").orderBy("entity_id").collect()
    hints = read_table(spark, sf, "canonical_tags").groupBy(F.lower(F.split("primary_tag", "::")[1]).alias("term")).agg(F.min("tag_root").alias("root")).collect()
    rules = tuple(R.Rule(e["abbreviation"], (e["entity_name"],), allowed_roots=frozenset({e["root"]}), mode=_MODES[e["entity_id"] % 3]) for e in entities)
    return R.Governance(rules, {h["term"]: h["root"] for h in hints})


_QUERY_TABLE = """said AS (
  SELECT entity_id, kind, abbreviation, entity_name, root AS allowed, CASE kind WHEN 'organ' THEN abbreviation || ' of the ' || split_part(entity_name, ' of the ', 2) WHEN 'context' THEN abbreviation || ' grading' ELSE abbreviation END AS query,
         CASE WHEN kind = 'rooted' THEN root END AS root
  FROM canonical_entities CROSS JOIN (SELECT unnest(['bare', 'organ', 'context', 'rooted']) AS kind) WHERE abbreviation IS NOT NULL)"""


def _query_table(spark, sf):
    kinds = F.explode(F.array(*(F.lit(k) for k in ("bare", "organ", "context", "rooted"))))
    entities = read_table(spark, sf, "canonical_entities").where("abbreviation is not null").select("*", kinds.alias("kind"))
    organ = F.concat("abbreviation", F.lit(" of the "), F.coalesce(F.try_element_at(F.split("entity_name", " of the "), F.lit(2)), F.lit("")))
    query = F.when(F.col("kind") == "organ", organ).when(F.col("kind") == "context", F.concat("abbreviation", F.lit(" grading"))).otherwise(F.col("abbreviation"))
    return entities.select("entity_id", "kind", query.alias("query"), F.when(F.col("kind") == "rooted", F.col("root")).alias("root"))


@register(
    "QRY-02",
    f"""WITH {_QUERY_TABLE},
       hints AS (SELECT lower(split_part(primary_tag, '::', 2)) AS term, min(tag_root) AS hinted FROM canonical_tags GROUP BY 1),
       words AS (SELECT DISTINCT entity_id, kind, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM said),
       spoken AS (SELECT DISTINCT entity_id, kind, hinted FROM words JOIN hints USING (term)),
       ok AS (SELECT s.*, coalesce(s.root = s.allowed, false) OR EXISTS (SELECT 1 FROM spoken k WHERE k.entity_id = s.entity_id AND k.kind = s.kind AND k.hinted = s.allowed) AS ok FROM said s)
       SELECT entity_id, kind, CASE WHEN NOT ok THEN query WHEN entity_id % 3 = 0 THEN replace(query, abbreviation, entity_name) WHEN entity_id % 3 = 1 THEN query || ' ' || entity_name ELSE query || ' (' || entity_name || ')' END AS query, ok::INT AS applied FROM ok""",
)
def governed_expansion(spark, sf):
    out = R.expand_queries(_query_table(spark, sf), "query", _governed(spark, sf), "root")
    return out.select("entity_id", "kind", F.col("expanded.query").alias("query"), F.size("expanded.applied").alias("applied"))


@register(
    "QRY-03",
    """WITH h AS (SELECT lower(split_part(primary_tag, '::', 2)) AS term, min(tag_root) AS root FROM canonical_tags GROUP BY 1),
       w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS term FROM documents)
       SELECT doc_id, string_agg(DISTINCT root, ',' ORDER BY root) AS roots FROM w JOIN h USING (term) GROUP BY doc_id""",
)
def roots(spark, sf):
    hints = read_table(spark, sf, "canonical_tags").groupBy(F.lower(F.split("primary_tag", "::")[1]).alias("term")).agg(F.min("tag_root").alias("root"))
    return R.roots_of(read_table(spark, sf, "documents"), "doc_id", "title", hints).select("doc_id", F.array_join("roots", ",").alias("roots"))


_REQUEST = "GCAL of the liver"
_REQUEST_RULES = R.Governance((R.Rule("GCAL", ("giant cell adenoma",), allowed_roots=frozenset({"GI"})),), {"liver": "GI"})
_REQUEST_TERMS = query_terms(R.expand_query(_REQUEST, _REQUEST_RULES).query, T.STOPWORDS)


@register("QRY-04", f"WITH {bm25_sql(_REQUEST_TERMS, lexical_rank_sql(_REQUEST_TERMS, 10))} SELECT *, 0 AS warnings FROM lex")
def expanded_search(spark, sf):
    docs = read_table(spark, sf, "documents")
    found, warnings = R.search_or_fall_back(lambda q: postings(spark, sf).search(docs, "text", query_terms(q, T.STOPWORDS), 10), _REQUEST, _REQUEST_RULES)
    return found.withColumn("warnings", F.lit(len(warnings)))


_FORMS = "(SELECT tag_id, unnest(['root: ' || tag_root, 'TAG:' || primary_tag, primary_tag || ' ', replace(split_part(primary_tag, '::', 3), '_', ' ')]) AS said FROM canonical_tags)"


@register(
    "QRY-05",
    f"""WITH q AS (SELECT tag_id, trim(said) AS q FROM {_FORMS})
       SELECT tag_id, CASE WHEN starts_with(lower(q), 'root:') THEN 'root' WHEN starts_with(lower(q), 'tag:') THEN 'tag' WHEN contains(q, '::') THEN 'path' ELSE 'text' END AS mode,
              CASE WHEN starts_with(lower(q), 'root:') OR starts_with(lower(q), 'tag:') THEN trim(substr(q, strpos(q, ':') + 1)) ELSE q END AS value FROM q""",
)
def tag_grammar(spark, sf):
    leaf = F.replace(F.element_at(F.split("primary_tag", "::"), 3), F.lit("_"), F.lit(" "))
    forms = F.explode(F.array(F.concat(F.lit("root: "), "tag_root"), F.concat(F.lit("TAG:"), "primary_tag"), F.concat("primary_tag", F.lit(" ")), leaf))
    return read_table(spark, sf, "canonical_tags").select("tag_id", forms.alias("said")).select("tag_id", R.tag_query(F.col("said")).alias("q")).select("tag_id", "q.mode", "q.value")


#: The aspects of a topic page and the suffixes of a gallery.
ASPECTS = ("histology microscopic morphology", "immunohistochemistry IHC ancillary molecular", "differential diagnosis")
SUFFIXES = ("histology", "gross", "microscopy", "diagnosis", "figure", "image", "pathology")


@register(
    "QRY-06",
    f"""WITH b AS (SELECT tag_id, trim(replace(split_part(primary_tag, '::', 3), '_', ' ')) AS base, trim(regexp_replace(replace(split_part(primary_tag, '::', 2), '_', ' '), '\\s+', ' ', 'g')) AS organ FROM canonical_tags),
       f AS (SELECT *, CASE WHEN organ <> '' AND len(regexp_extract_all(base, '\\S+')) <= 3 AND NOT contains(lower(base), lower(organ)) THEN base || ' ' || organ ELSE base END AS full_name FROM b),
       v AS (SELECT tag_id, list_concat(CASE WHEN full_name = base THEN [base] ELSE [base, full_name] END, list_transform({list(ASPECTS)}, lambda a: full_name || ' ' || a))[1:4] AS v FROM f WHERE base <> '')
       SELECT tag_id, unnest(range(1, len(v) + 1))::INT AS place, unnest(v) AS variant FROM v""",
)
def topic_variants(spark, sf):
    parts = F.split("primary_tag", "::")
    base, organ = (F.trim(F.replace(F.element_at(parts, i), F.lit("_"), F.lit(" "))) for i in (3, 2))
    context = F.concat("tag_root", F.lit(" — "), organ, F.lit(" > Entities"))
    found = R.each(lambda q, c: R.variants(q, c, ASPECTS), F.col("base"), F.col("context"))
    rows = read_table(spark, sf, "canonical_tags").select("tag_id", base.alias("base"), context.alias("context")).where("base <> ''")
    return rows.select("tag_id", F.posexplode(found).alias("p", "variant")).select("tag_id", (F.col("p") + 1).cast("int").alias("place"), "variant")


@register("QRY-07", f"SELECT entity_id, unnest(range(1, 9))::INT AS place, unnest(list_concat([trim(entity_name)], list_transform({list(SUFFIXES)}, lambda s: trim(entity_name) || ' ' || s))) AS variant FROM canonical_entities WHERE trim(entity_name) <> ''")
def gallery_variants(spark, sf):
    found = R.each(lambda q: R.with_suffixes(q, SUFFIXES), F.col("entity_name"))
    return read_table(spark, sf, "canonical_entities").where("trim(entity_name) <> ''").select("entity_id", F.posexplode(found).alias("p", "variant")).select("entity_id", (F.col("p") + 1).cast("int").alias("place"), "variant")


#: What a question asks for, in the order they are tried.
ASKED = (
    ("search_only", r"\b(sources?\s+only|search\s+only|raw\s+evidence|no\s+synthesis|just\s+(the\s+)?(sources|cards|evidence))\b"),
    ("html_teaching", r"\b(html\s+teaching|teaching\s+page|lecture\s+handout)\b"),
    ("compare_sources", r"\b(difference|differ|vs\.?|versus|compare|comparison|between)\b"),
)
FEATURES = r"\b(diagnostic\s+criteria|differential\s+diagnosis|molecular\s+features|gross\s+(pathology|findings)|microscopic\s+features|ancillary\s+(studies|tests)|clinical\s+features)\b"
VISUAL = r"\b(show\s+me|show|picture|pictures|photo|photos|image|images|figure|figures|histology|histologic|microscopic|microscopy|gross|what\s+does|look\s+like|demonstrate|illustrate|visual)\b"
ABOUT = r"^(?:what\s+is|what'?s|whats|define|explain|tell\s+me\s+about|describe|features?\s+of|pathology\s+of|histology\s+of|criteria\s+for|workup\s+of)\s+(.+?)\??$"
_ASKS = ("{} sources only", "lecture handout on {}", "{} versus fibroma", "what is {}?", "{}", "clinical features: {} (adult)", "show images, please: {}", "how often does {} recur; and where?")


def _asked_sql() -> str:
    sql = lambda p: p.replace("'", "''")
    first = " ".join(f"WHEN regexp_matches(q, '(?i){sql(p)}') THEN '{m}'" for m, p in ASKED)
    return f"""WITH q AS (SELECT entity_id, unnest(list_transform({list(_ASKS)}, lambda t: replace(t, '{{}}', entity_name))) AS q FROM canonical_entities),
       e AS (SELECT *, CASE WHEN regexp_matches(q, '(?i){sql(ABOUT)}') THEN rtrim(trim(regexp_extract(q, '(?i){sql(ABOUT)}', 1)), '?.!')
                            WHEN regexp_matches(q, '(?i){sql(VISUAL)}') OR regexp_matches(q, '(?i){sql(ASKED[2][1])}') THEN NULL
                            WHEN regexp_full_match(q, '[A-Za-z][A-Za-z0-9\\- ]{{0,40}}') AND len(regexp_extract_all(q, '\\S+')) <= 6 THEN q END AS entity FROM q)
       SELECT entity_id, q AS query, CASE {first} WHEN entity IS NOT NULL OR regexp_matches(q, '(?i){FEATURES}') THEN 'topic_page' WHEN regexp_matches(q, '(?i){sql(VISUAL)}') THEN 'visual' ELSE 'gpt_like' END AS mode FROM e"""


@register("QRY-09", _asked_sql())
def routed(spark, sf):
    asks = F.explode(F.array(*(F.replace(F.lit(t), F.lit("{}"), F.col("entity_name")) for t in _ASKS)))
    q = F.col("query")
    visual, compared = q.rlike(f"(?i){VISUAL}"), q.rlike(f"(?i){ASKED[2][1]}")
    about = F.rtrim(F.trim(F.regexp_extract(q, f"(?i){ABOUT}", 1)), F.lit("?.!"))
    plain = q.rlike(r"^[A-Za-z][A-Za-z0-9\- ]{0,40}$") & (F.size(F.split(F.trim(q), r"\s+")) <= 6)
    entity = F.when(q.rlike(f"(?i){ABOUT}"), about).when(visual | compared, F.lit(None)).when(plain, q)
    mode = F.when(q.rlike(f"(?i){ASKED[0][1]}"), ASKED[0][0]).when(q.rlike(f"(?i){ASKED[1][1]}"), ASKED[1][0]).when(compared, ASKED[2][0])
    mode = mode.when(entity.isNotNull() | q.rlike(f"(?i){FEATURES}"), "topic_page").when(visual, "visual").otherwise("gpt_like")
    return read_table(spark, sf, "canonical_entities").select("entity_id", asks.alias("query")).select("entity_id", "query", mode.alias("mode"))


#: Words that speak for an organ, in the order they are tried, patterns tried before them, and anchors.
ORGANS = {
    "breast": ("breast", "mammary", "ductal", "lobular", "lcis", "dcis", "mastectomy"),
    "prostate": ("prostate", "prostatic", "pin", "gleason"),
    "salivary": ("salivary", "parotid", "submandibular", "minor salivary"),
    "colon": ("colon", "colorectal", "rectal", "bowel"),
    "cervix": ("cervix", "cervical", "cin", "hsil", "lsil"),
    "thyroid": ("thyroid", "papillary thyroid", "follicular thyroid"),
    "lung": ("lung", "pulmonary", "bronchial"),
    "skin": ("skin", "cutaneous", "melanoma", "dermat"),
}
SPECIFIC = {r"\b(lcis|dcis)\b|lobular carcinoma in situ": "breast"}
ANCHORS = {"colon": "colorectal"}


def _organ_sql() -> str:
    hint = " ".join([*(f"WHEN regexp_matches(low, '{p}') THEN '{o}'" for p, o in SPECIFIC.items()), *(f"WHEN regexp_matches(low, '{'|'.join(w)}') THEN '{o}'" for o, w in ORGANS.items())])
    scope = " ".join(f"WHEN organ = '{o}' AND NOT regexp_matches(lower(q), '{'|'.join(w[:3])}') THEN q || ' {ANCHORS.get(o, o)}'" for o, w in ORGANS.items())
    return f"""WITH t AS (SELECT doc_id, trim(split_part(title, ' ', 1)) AS q, lower(title) AS low FROM documents WHERE title IS NOT NULL), h AS (SELECT *, CASE {hint} END AS organ FROM t)
       SELECT doc_id, organ, CASE WHEN q = '' THEN q {scope} ELSE q END AS query FROM h"""


@register("QRY-10", _organ_sql())
def organ_scoped(spark, sf):
    rows = read_table(spark, sf, "documents").where("title is not null").select("doc_id", F.trim(F.split("title", " ")[0]).alias("q"), R.organ_hint(F.col("title"), ORGANS, SPECIFIC).alias("organ"))
    return rows.select("doc_id", "organ", R.scoped(F.col("q"), F.col("organ"), ORGANS, ANCHORS).alias("query"))


#: Words too general to search a tag by.
GENERAL = (
    "and", "or", "of", "the", "with", "without", "tumor", "tumors", "tumour", "tumours", "neoplasm", "neoplasms", "malignant",
    "benign", "lesion", "lesions", "disease", "pathology", "diagnosis", "other", "miscellaneous",
)


@register(
    "QRY-11",
    f"""WITH p AS (SELECT tag_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(split_part(primary_tag, '::', 3), '[_-]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))) AS leaf,
                       lower(trim(regexp_replace(regexp_replace(regexp_replace(split_part(primary_tag, '::', 2), '[_-]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))) || ' ' ||
                       lower(trim(regexp_replace(regexp_replace(regexp_replace(split_part(primary_tag, '::', 3), '[_-]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))) AS path FROM canonical_tags),
       t AS (SELECT *, list_filter(regexp_extract_all(leaf, '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN {_in(GENERAL)}) AS a, list_filter(regexp_extract_all(path, '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN {_in(GENERAL)}) AS b FROM p),
       c AS (SELECT *, list_concat(a[1:3], list_filter(b, lambda t: NOT list_contains(a, t))[1:2]) AS c FROM t)
       SELECT tag_id, 'leaf_exact' AS kind, '"' || replace(leaf, '"', '""') || '"' AS query FROM c WHERE length(leaf) >= 4 AND len(a) > 0
       UNION ALL SELECT tag_id, 'leaf_terms', array_to_string(a, ' AND ') FROM c WHERE len(a) >= 2
       UNION ALL SELECT tag_id, 'path_cluster', array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ' AND ') FROM c WHERE len(list_distinct(c)) >= 2""",
)
def tag_queries(spark, sf):
    def terms(c):
        return F.filter(F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 3) & ~t.isin(*GENERAL))

    parts = F.split("primary_tag", "::")
    leaf, organ = (T.phrase(F.element_at(parts, i)) for i in (3, 2))
    rows = read_table(spark, sf, "canonical_tags").select("tag_id", leaf.alias("leaf"), F.concat(organ, F.lit(" "), leaf).alias("path")).select("tag_id", "leaf", terms(F.col("leaf")).alias("a"), terms(F.col("path")).alias("b"))
    cluster = F.array_distinct(F.concat(F.slice("a", 1, 3), F.slice(F.filter("b", lambda t: ~F.array_contains("a", t)), 1, 2)))
    rows = rows.withColumn("c", cluster)
    made = F.array(
        F.when((F.length("leaf") >= 4) & (F.size("a") > 0), F.struct(F.lit("leaf_exact").alias("kind"), F.concat(F.lit('"'), F.replace("leaf", F.lit('"'), F.lit('""')), F.lit('"')).alias("query"))),
        F.when(F.size("a") >= 2, F.struct(F.lit("leaf_terms").alias("kind"), F.array_join("a", " AND ").alias("query"))),
        F.when(F.size("c") >= 2, F.struct(F.lit("path_cluster").alias("kind"), F.array_join("c", " AND ").alias("query"))),
    )
    return rows.select("tag_id", F.explode(made).alias("q")).where("q is not null").select("tag_id", "q.kind", "q.query")


@register(
    "QRY-13",
    """WITH q AS (SELECT entity_id, 'compare  @' || entity_name || '; with @' || coalesce(abbreviation, 'none') || ' now' AS q FROM canonical_entities),
       m AS (SELECT entity_id, list_filter(list_transform(regexp_extract_all(q, '@([^;@]+);?', 1), lambda x: trim(x)), lambda x: x <> '') AS labels, trim(regexp_replace(regexp_replace(q, '@([^;@]+);?', '\\1', 'g'), '\\s+', ' ', 'g')) AS clean FROM q)
       SELECT m.entity_id, array_to_string(labels, '|') AS labels, clean, e.entity_id AS resolved FROM m LEFT JOIN canonical_entities e ON lower(e.entity_name) = lower(labels[1])""",
)
def mentioned(spark, sf):
    entities = read_table(spark, sf, "canonical_entities")
    q = F.concat(F.lit("compare  @"), "entity_name", F.lit("; with @"), F.coalesce("abbreviation", F.lit("none")), F.lit(" now"))
    rows = entities.select("entity_id", q.alias("q")).select("entity_id", R.each(R.mentions, F.col("q")).alias("labels"), F.element_at(R.each(lambda t: [R.without_marks(t)], F.col("q")), 1).alias("clean"))
    known = entities.select(F.col("entity_id").alias("resolved"), F.lower("entity_name").alias("name"))
    return rows.join(known, F.lower(F.try_element_at("labels", F.lit(1))) == F.col("name"), "left").select("entity_id", F.array_join("labels", "|").alias("labels"), "clean", "resolved")


@register(
    "QRY-14",
    """SELECT entity_id, kind, query FROM (SELECT entity_id, unnest(['exact_name', 'abbreviation', 'entity_plus_organ', 'entity_plus_morphology']) AS kind,
         unnest([trim(entity_name), nullif(trim(abbreviation), ''), trim(entity_name) || ' ' || nullif(trim(root), ''), trim(entity_name) || ' ' || nullif(lower(split_part(entity_name, ' ', 2)), '')]) AS query FROM canonical_entities) WHERE query IS NOT NULL""",
)
def benchmark_queries(spark, sf):
    name = F.trim("entity_name")
    second = T.present(F.lower(F.coalesce(F.try_element_at(F.split("entity_name", " "), F.lit(2)), F.lit(""))))
    kinds = {"exact_name": name, "abbreviation": T.present(F.col("abbreviation")), "entity_plus_organ": F.concat(name, F.lit(" "), T.present(F.col("root"))), "entity_plus_morphology": F.concat(name, F.lit(" "), second)}
    made = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), q.alias("query")) for k, q in kinds.items())))
    return read_table(spark, sf, "canonical_entities").select("entity_id", made.alias("q")).select("entity_id", "q.kind", "q.query").where("query is not null")


@register(
    "QRY-15",
    r"""WITH q AS (SELECT doc_id, '("' || title || '") AND [' || coalesce(source, '') || '] or not w/3 {x} NOTE' AS q FROM documents WHERE title IS NOT NULL)
       SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(q, '[(){}\[\]"''\\]', ' ', 'g'), '(?i)\b(?:AND|OR|NOT|W/[0-9]+|PRE/[0-9]+)\b', ' ', 'g'), '\s+', ' ', 'g')) AS query FROM q""",
)
def provider_queries(spark, sf):
    q = F.concat(F.lit('("'), "title", F.lit('") AND ['), F.coalesce("source", F.lit("")), F.lit("] or not w/3 {x} NOTE"))
    return read_table(spark, sf, "documents").where("title is not null").select("doc_id", R.plain_terms(q).alias("query"))


_TAGS, _KEYWORDS = ("GI::Colon", "Heme"), ("cyst", "pathout", "tumor")


@register(
    "QRY-16",
    f"""WITH t AS (SELECT * FROM tag_records WHERE {' OR '.join(f"starts_with(primary_tag, '{t}')" for t in _TAGS)})
       SELECT 'tag_browse' AS mode, primary_tag, NULL::VARCHAR AS record_id, count(*) AS n FROM t GROUP BY 2
       UNION ALL SELECT DISTINCT 'tag_contents', primary_tag, record_id, 1 FROM t
       UNION ALL SELECT DISTINCT 'tag_then_query', primary_tag, record_id, 1 FROM t WHERE {' AND '.join(f"(title ILIKE '%{k}%' OR text_excerpt ILIKE '%{k}%' OR primary_tag ILIKE '%{k}%')" for k in ('cyst', 'tumor'))}""",
)
def tag_aware(spark, sf):
    rows = read_table(spark, sf, "tag_records")
    tagged = R.tagged(rows, _TAGS, "prefix")
    browse = tagged.groupBy("primary_tag").agg(F.count("*").alias("n")).select(F.lit("tag_browse").alias("mode"), "primary_tag", F.lit(None).cast("string").alias("record_id"), "n")
    listed = tagged.select("primary_tag", "record_id").distinct().select(F.lit("tag_contents").alias("mode"), "primary_tag", "record_id", F.lit(1).cast("bigint").alias("n"))
    asked = R.with_keywords(tagged, "cyst tumor", ("title", "text_excerpt", "primary_tag")).select("primary_tag", "record_id").distinct()
    return browse.unionByName(listed).unionByName(asked.select(F.lit("tag_then_query").alias("mode"), "primary_tag", "record_id", F.lit(1).cast("bigint").alias("n")))


@register(
    "QRY-17",
    """WITH r AS (SELECT record_id, ingested_at, CASE WHEN row_index % 3 = 0 THEN 'Wrapped::' || primary_tag ELSE primary_tag END AS tag, CASE WHEN row_index % 4 = 0 THEN upper(tag_root) || '.' WHEN row_index % 4 = 1 THEN 'Cyto' END AS browse FROM records WHERE row_index IS NOT NULL),
       p AS (SELECT *, list_filter(string_split(tag, '::'), lambda x: x <> '') AS p, nullif(regexp_replace(lower(browse), '[^a-z0-9]+', '', 'g'), '') AS b FROM r),
       t AS (SELECT *, CASE WHEN contains(tag, '::') THEN regexp_replace(lower(CASE WHEN regexp_replace(lower(p[1]), '[^a-z0-9]+', '', 'g') = 'wrapped' AND len(p) > 1 THEN p[2] ELSE p[1] END), '[^a-z0-9]+', '', 'g') END AS t FROM p)
       SELECT DISTINCT record_id, ingested_at, CASE WHEN b = 'cyto' AND starts_with(t, 'cyto') THEN t ELSE coalesce(b, t) END AS root FROM t""",
)
def page_roots(spark, sf):
    tag = F.when(F.col("row_index") % 3 == 0, F.concat(F.lit("Wrapped::"), "primary_tag")).otherwise(F.col("primary_tag"))
    browse = F.when(F.col("row_index") % 4 == 0, F.concat(F.upper("tag_root"), F.lit("."))).when(F.col("row_index") % 4 == 1, "Cyto")
    return read_table(spark, sf, "records").where("row_index is not null").select("record_id", "ingested_at", R.page_root(tag, browse, "wrapped", "cyto").alias("root")).distinct()
