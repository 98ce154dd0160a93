"""Named queries on search, fusion, scoring and queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.fusion import reciprocal_rank_fusion
from tessera.operators.lexical import Postings, bm25, query_terms
from tessera.operators.vector import dot, nearest, unit
from tessera.plans.registry import Registry
from tessera.session import work_folder
from tessera.sources.sinks import modified
from tessera.sources.tables import read_table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

QUESTION = "brisk mitotic activity of the granuloma"
TERMS = query_terms(QUESTION, T.STOPWORDS)


_OPEN: dict[tuple, Postings] = {}


def postings(spark, sf) -> Postings:
    """The index of the documents, built once per session and state of the table."""
    path = f"{sf}/documents.parquet"
    key = (spark.sparkContext.applicationId, path, modified(spark, path))
    if key not in _OPEN:
        docs = read_table(spark, sf, "documents")
        _OPEN[key] = Postings.build(docs, "doc_id", "text", work_folder(spark), buckets=max(8, min(1024, len(docs.inputFiles()))), stop=T.STOPWORDS)
    return _OPEN[key]


def bm25_sql(terms=TERMS, extra: str = "") -> str:
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(terms))
    sums = ", ".join(f"sum((f{i} > 0)::INT) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(terms)))
    hits = " + ".join(f"(f{i} > 0)::INT" for i in range(len(terms)))
    return f"""w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '') AS t FROM documents),
      s AS (SELECT doc_id, len(t) AS l, {counts} FROM w), c AS (SELECT count(*) AS n, avg(l) AS a, {sums} FROM s),
      b AS (SELECT doc_id, ({hits})::INT AS n_terms, round({score}, 6) AS score FROM s CROSS JOIN c WHERE {hits} > 0){extra}"""


def lexical_rank_sql(terms, k: int) -> str:
    return f", x AS (SELECT doc_id, CASE WHEN n_terms = {len(terms)} THEN 1 ELSE 2 END AS tier, score FROM b), lex AS (SELECT *, row_number() OVER (ORDER BY tier, score DESC, doc_id)::INT AS rank FROM x WHERE tier = (SELECT min(tier) FROM x) QUALIFY rank <= {k})"


@register("RNK-02", f"WITH {bm25_sql()} SELECT * FROM b")
def lexical(spark, sf):
    return postings(spark, sf).bm25(TERMS)


@register("RNK-02-scan", f"WITH {bm25_sql()} SELECT * FROM b")
def lexical_scan(spark, sf):
    """The same from the texts, for a corpus searched once."""
    return bm25(read_table(spark, sf, "documents"), "doc_id", "text", TERMS)


@register("RNK-02-like", "SELECT doc_id, 3 AS tier, 9999.0::DOUBLE AS score, row_number() OVER (ORDER BY doc_id)::INT AS rank FROM documents WHERE contains(lower(text), 'ranulom') QUALIFY rank <= 25")
def last_resort(spark, sf):
    """No text has the word, so its letters are looked for."""
    return postings(spark, sf).search(read_table(spark, sf, "documents"), "text", ["ranulom", "xyzzy"], 25)


_LEX = lexical_rank_sql(TERMS, 25)


@register("TOP-01", f"WITH {bm25_sql(TERMS, _LEX)} SELECT * FROM lex")
def lexical_top(spark, sf):
    return postings(spark, sf).search(read_table(spark, sf, "documents"), "text", TERMS, 25)


def _query_vector(spark, sf) -> list[float]:
    return list(read_table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"])


_VEC = "vec AS (SELECT vec_id AS doc_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, doc_id LIMIT 25), vr AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM vec)"


@register("TOP-02", f"WITH {_VEC} SELECT doc_id AS vec_id, score FROM vr")
def vector_top(spark, sf):
    return nearest(read_table(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf), 25)


def hybrid_search(spark, sf):
    """Lexical and vector search of the documents, fused by reciprocal rank, with titles and excerpts."""
    docs = read_table(spark, sf, "documents")
    a = postings(spark, sf).search(docs, "text", TERMS, 25)
    b = nearest(read_table(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf), 25).withColumnRenamed("vec_id", "doc_id")
    b = b.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    top = reciprocal_rank_fusion(a, b, "doc_id").orderBy(F.desc("fusion"), F.asc_nulls_last("a_rank"), F.asc_nulls_last("b_rank"), "doc_id").limit(10)
    rows = top.collect()  # ten rows; their ids reach the scan as a filter
    best, wanted = spark.createDataFrame(rows, top.schema), docs.where(F.col("doc_id").isin([r["doc_id"] for r in rows]))
    return wanted.join(F.broadcast(best), "doc_id").select("doc_id", "title", T.excerpt(F.col("text"), TERMS, 200).alias("excerpt"), "a_rank", "b_rank", "mode", "fusion")


_SPOTS = "[" + ", ".join(f"strpos(lower(text), '{t}')" for t in TERMS) + "]"


@register(
    "RNK-01",
    f"""WITH {bm25_sql(TERMS, _LEX)}, {_VEC},
       f AS (SELECT doc_id, lex.rank AS a_rank, vr.rank AS b_rank, CASE WHEN lex.rank IS NOT NULL AND vr.rank IS NOT NULL THEN 'hybrid' WHEN lex.rank IS NULL THEN 'vector_only' ELSE 'lexical_only' END AS mode,
               round(coalesce(1.0 / (60 + lex.rank), 0) + coalesce(1.0 / (60 + vr.rank), 0) + CASE WHEN lex.rank IS NOT NULL AND vr.rank IS NOT NULL THEN 0.005 ELSE 0 END, 6) AS fusion FROM lex FULL JOIN vr USING (doc_id)),
       t AS (SELECT * FROM f ORDER BY fusion DESC, a_rank NULLS LAST, b_rank NULLS LAST, doc_id LIMIT 10),
       p AS (SELECT t.*, title, text, greatest(coalesce(list_filter({_SPOTS}, lambda x: x > 0)[1], 1) - 66, 1) AS s FROM t JOIN documents USING (doc_id))
       SELECT doc_id, title, CASE WHEN length(text) <= 200 THEN text ELSE (CASE WHEN s > 1 THEN '...' ELSE '' END) || trim(substr(text, s, 200)) || (CASE WHEN s + 199 < length(text) THEN '...' ELSE '' END) END AS excerpt, a_rank, b_rank, mode, fusion FROM p""",
)
def hybrid(spark, sf):
    return hybrid_search(spark, sf)


@register("FN-23", "WITH n AS (SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(n, 6) AS norm, round(v[1] / n, 6) AS first FROM n")
def norms(spark, sf):
    v = F.col("embedding")
    return read_table(spark, sf, "embeddings").select("vec_id", F.round(F.sqrt(dot(v, v)), 6).alias("norm"), F.round(unit(v)[0], 6).alias("first"))


@register("QRY-12", "SELECT tag_id, lower(replace(array_to_string(list_slice(string_split(primary_tag, '::'), -2, -1), ' '), '_', ' ')) AS query FROM canonical_tags")
def suggested(spark, sf):
    last = F.slice(F.split("primary_tag", "::"), -2, 2)
    return read_table(spark, sf, "canonical_tags").select("tag_id", F.lower(F.replace(F.array_join(last, " "), F.lit("_"), F.lit(" "))).alias("query"))


@register("QRY-08", f"SELECT term, count(*) FILTER (WHERE contains(lower(text), term)) AS n, count(*) FILTER (WHERE contains(lower(text), term)) < 2 AS gap FROM documents CROSS JOIN (SELECT unnest({[*TERMS, 'immunotherapy']}) AS term) GROUP BY term")
def gaps(spark, sf):
    low = F.lower("text")
    counts = read_table(spark, sf, "documents").agg(*(F.coalesce(F.sum(F.contains(low, F.lit(t)).cast("bigint")), F.lit(0)).alias(t) for t in [*TERMS, "immunotherapy"]))
    return counts.unpivot([], [*TERMS, "immunotherapy"], "term", "n").select("term", "n", (F.col("n") < 2).alias("gap"))
