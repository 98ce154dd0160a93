"""Named queries on windows, ordered state, samples and lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import cards, sampling, scan, sequence
from tessera.operators.current import current_rows
from tessera.operators.joins import first_per_key
from tessera.plans.registry import Registry
from tessera.sources.tables import read_table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

_SEG = "(SELECT * FROM segments_indexable QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY ingested_at DESC) = 1)"


def _segments(spark, sf):
    return current_rows(read_table(spark, sf, "segments_indexable"), "segment_id", ["package_id", "start_sec", "end_sec", "text", "primary_tag"])


@register("WIN-01", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders")
def ranks(spark, sf):
    over = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read_table(spark, sf, "orders").select("o_orderkey", F.row_number().over(over).alias("rank"))


@register("WIN-02", "SELECT source, tag_root, arg_max(record_id, (length(excerpt), record_id)) AS best, max(length(excerpt)) AS score FROM records WHERE excerpt IS NOT NULL GROUP BY ALL")
def best_per_pair(spark, sf):
    rows = read_table(spark, sf, "records").where("excerpt is not null").withColumn("score", F.char_length("excerpt").cast("bigint"))
    return rows.groupBy("source", "tag_root").agg(F.max_by("record_id", F.struct("score", "record_id")).alias("best"), F.max("score").alias("score"))


@register("WIN-03", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_shipdate) <= 5")
def top_k(spark, sf):
    over = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return read_table(spark, sf, "lineitem").withColumn("n", F.row_number().over(over)).where("n <= 5").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@register("WIN-04", "SELECT record_id, sha256(concat_ws('|', record_id, coalesce(title, ''), row_number() OVER (PARTITION BY record_id ORDER BY ingested_at, title)::VARCHAR)) AS row_key FROM curriculum_records")
def duplicate_ordinal(spark, sf):
    n = F.row_number().over(Window.partitionBy("record_id").orderBy("ingested_at", "title"))
    return read_table(spark, sf, "curriculum_records").select("record_id", F.sha2(F.concat_ws("|", "record_id", F.coalesce("title", F.lit("")), n.cast("string")), 256).alias("row_key"))


@register("WIN-05", "SELECT record_id, ingested_at, CASE WHEN row_number() OVER (PARTITION BY original_tag, source ORDER BY fuzzy_score DESC NULLS LAST, record_id, ingested_at) = 1 THEN 'kept' ELSE 'duplicate' END AS state FROM curriculum_records")
def first_wins(spark, sf):
    n = F.row_number().over(Window.partitionBy("original_tag", "source").orderBy(F.desc_nulls_last("fuzzy_score"), "record_id", "ingested_at"))
    return read_table(spark, sf, "curriculum_records").select("record_id", "ingested_at", F.when(n == 1, "kept").otherwise("duplicate").alias("state"))


@register(
    "WIN-06",
    f"""WITH r AS (SELECT package_id, segment_id, start_sec, coalesce(end_sec, start_sec) AS end_sec, primary_tag AS tag FROM {_SEG}),
            i AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR tag IS DISTINCT FROM lag(tag) OVER w THEN 1 ELSE 0 END AS b FROM r WINDOW w AS (PARTITION BY package_id ORDER BY start_sec, segment_id)),
            n AS (SELECT *, sum(b) OVER (PARTITION BY package_id ORDER BY start_sec, segment_id ROWS UNBOUNDED PRECEDING) AS run FROM i),
            g AS (SELECT package_id, run, min(tag) AS v, count(*) AS c, max(end_sec) - min(start_sec) AS span FROM n GROUP BY ALL),
            p AS (SELECT package_id, run, CASE WHEN (c < 3 OR span < 10) AND lag(run) OVER w IS NOT NULL THEN lag(v) OVER w WHEN (c < 3 OR span < 10) AND lead(run) OVER w IS NOT NULL THEN lead(v) OVER w ELSE v END AS smoothed FROM g WINDOW w AS (PARTITION BY package_id ORDER BY run))
       SELECT n.segment_id, p.smoothed FROM n JOIN p USING (package_id, run)""",
)
def smoothed(spark, sf):
    rows = _segments(spark, sf).withColumn("end_sec", F.coalesce("end_sec", "start_sec"))
    return sequence.smooth_islands(rows, "package_id", ["start_sec", "segment_id"], "primary_tag", "start_sec", "end_sec", 3, 10).select("segment_id", "smoothed")


@register("WIN-06-hours", ORACLES["WIN-06"])
def smoothed_by_hours(spark, sf):
    """The same with packages cut into hours, for packages too long for one task."""
    rows = _segments(spark, sf).withColumn("end_sec", F.coalesce("end_sec", "start_sec"))
    hours = F.floor(F.col("start_sec") / 3600)
    return sequence.smooth_islands(rows, "package_id", ["start_sec", "segment_id"], "primary_tag", "start_sec", "end_sec", 3, 10, place=hours).select("segment_id", "smoothed")


_BUDGETED = f"""rows AS (SELECT package_id, start_sec AS s, coalesce(end_sec, start_sec) AS e, coalesce(length(text), 0) AS c, row_number() OVER w AS n,
         coalesce(start_sec - lag(coalesce(end_sec, start_sec)) OVER w > 20, true) AS cut FROM {_SEG} WHERE start_sec IS NOT NULL WINDOW w AS (PARTITION BY package_id ORDER BY start_sec, coalesce(end_sec, start_sec))),
       steps AS (SELECT package_id, n, 1 AS w, s AS ws, c AS wc FROM rows WHERE n = 1
         UNION ALL SELECT r.package_id, r.n, CASE WHEN fits THEN w ELSE w + 1 END, CASE WHEN fits THEN ws ELSE s END, CASE WHEN fits THEN wc + 1 + c ELSE c END
         FROM (SELECT r.*, w, ws, wc, NOT cut AND e - ws <= 140 AND wc + 1 + c <= 2600 AS fits FROM steps t JOIN rows r ON r.package_id = t.package_id AND r.n = t.n + 1) r)"""


@register("WIN-07", f"WITH RECURSIVE {_BUDGETED} SELECT package_id AS entity, min(s) AS window_start, max(e) AS window_end, count(*) AS n_rows, max(wc)::BIGINT AS n_chars FROM steps JOIN rows USING (package_id, n) GROUP BY package_id, w HAVING max(wc) >= 400")
def budgeted(spark, sf):
    return sequence.merge_by_budget(_segments(spark, sf), "package_id", "start_sec", "end_sec", "text")


def _consolidated(same: float, any_tag: float) -> str:
    """The state machine row by row, then chunk by chunk."""
    return f"""WITH RECURSIVE
       rows AS (SELECT package_id, start_sec AS s, coalesce(end_sec, start_sec) AS e, coalesce(length(text), 0) AS c, primary_tag AS g, row_number() OVER (PARTITION BY package_id ORDER BY start_sec, end_sec NULLS FIRST, primary_tag NULLS FIRST) AS n FROM {_SEG} WHERE start_sec IS NOT NULL),
       steps AS (SELECT package_id, n, 1 AS w, s, e, 1 AS k, c, g FROM rows WHERE n = 1
         UNION ALL SELECT package_id, n, CASE WHEN fits THEN w ELSE w + 1 END, CASE WHEN fits THEN ps ELSE s END, CASE WHEN fits THEN greatest(pe, e) ELSE e END, CASE WHEN fits THEN pk + 1 ELSE 1 END, CASE WHEN fits THEN pc + 1 + c ELSE c END, g
         FROM (SELECT r.*, w, t.s AS ps, t.e AS pe, t.k AS pk, t.c AS pc, r.g IS NOT DISTINCT FROM t.g AND r.s - t.e <= 25 AND r.e - t.s <= 140 AND t.c + 1 + r.c <= 2600 AS fits FROM steps t JOIN rows r ON r.package_id = t.package_id AND r.n = t.n + 1)),
       chunks AS (SELECT package_id, w AS n, s, e, k, c, g FROM steps QUALIFY row_number() OVER (PARTITION BY package_id, w ORDER BY steps.n DESC) = 1),
       joined AS (SELECT package_id, n, 1 AS w, s, e, k, c, g FROM chunks WHERE n = 1
         UNION ALL SELECT package_id, n, CASE WHEN fits THEN w ELSE w + 1 END, CASE WHEN fits THEN ps ELSE s END, CASE WHEN fits THEN greatest(pe, e) ELSE e END, CASE WHEN fits THEN pk + k ELSE k END, CASE WHEN fits THEN pc + 1 + c ELSE c END, CASE WHEN fits THEN pg ELSE g END
         FROM (SELECT r.*, w, t.s AS ps, t.e AS pe, t.k AS pk, t.c AS pc, t.g AS pg,
                 ((r.e - r.s < {same} AND r.g IS NOT DISTINCT FROM t.g) OR r.e - r.s < {any_tag}) AND r.e - t.s <= 140 * 1.35::DOUBLE AND t.c + 1 + r.c <= 2600 * 1.35::DOUBLE AS fits FROM joined t JOIN chunks r ON r.package_id = t.package_id AND r.n = t.n + 1))
       SELECT package_id, s AS start_sec, e AS end_sec, k::BIGINT AS n_rows, c::BIGINT AS n_chars, g AS tag FROM joined QUALIFY row_number() OVER (PARTITION BY package_id, w ORDER BY n DESC) = 1"""


@register("WIN-08", _consolidated(0.0, 0.0))
def tagged_chunks(spark, sf):
    """Chunks of one tag within budgets, without absorption of short ones."""
    return scan.consolidate(_segments(spark, sf), "package_id", "start_sec", "end_sec", "text", "primary_tag", same=0.0, any_tag=0.0)


@register("WIN-09", _consolidated(55.0, 25.0))
def absorbed_chunks(spark, sf):
    """The same with short chunks joined to the one before them."""
    return scan.consolidate(_segments(spark, sf), "package_id", "start_sec", "end_sec", "text", "primary_tag")


_TOPICS = ("carcinoma", "fibroma", "cyst", "marker")


def _scored(spark, sf):
    words = F.array(*(F.struct(F.lit(t).alias("tag"), ((F.length("text") - F.length(F.replace("text", F.lit(t), F.lit("")))) / 20.0).alias("score")) for t in _TOPICS))
    rows = _segments(spark, sf).withColumn("scores", F.filter(words, lambda x: x["score"] > 0))
    return rows.withColumn("reset", F.contains("text", F.lit("agenda")))


def _held(within: float, least: float) -> str:
    score = ", ".join(f"nullif((length(text) - length(replace(text, '{t}', ''))) / 20.0::DOUBLE, 0) AS s{i}" for i, t in enumerate(_TOPICS))
    top = "greatest(" + ", ".join(f"s{i}" for i in range(len(_TOPICS))) + ")"
    best = " ".join(f"WHEN s{_TOPICS.index(t)} = {top} THEN '{t}'" for t in sorted(_TOPICS))
    own = " ".join(f"WHEN '{t}' THEN s{i}" for i, t in enumerate(_TOPICS))
    step = f"""CASE WHEN reset THEN 'reset' WHEN best IS NULL THEN CASE WHEN held IS NULL THEN 'none' ELSE 'carried' END
                    WHEN held <> best AND CASE held {own} END >= top - {within}::DOUBLE AND CASE held {own} END >= {least}::DOUBLE THEN 'held' ELSE 'best' END"""
    return f"""WITH RECURSIVE
       scored AS (SELECT package_id, segment_id, start_sec, coalesce(contains(text, 'agenda'), false) AS reset, {score} FROM {_SEG}),
       rows AS (SELECT *, {top} AS top, CASE {best} END AS best, row_number() OVER (PARTITION BY package_id ORDER BY start_sec NULLS FIRST, segment_id) AS n FROM scored),
       steps AS (SELECT package_id, 0::BIGINT AS n, NULL::VARCHAR AS segment_id, NULL::VARCHAR AS held, NULL::VARCHAR AS basis FROM (SELECT DISTINCT package_id FROM rows)
         UNION ALL SELECT package_id, n, segment_id, CASE basis WHEN 'reset' THEN NULL WHEN 'best' THEN best ELSE held END, basis
         FROM (SELECT r.*, held, {step} AS basis FROM steps t JOIN rows r ON r.package_id = t.package_id AND r.n = t.n + 1))
       SELECT package_id, segment_id, held AS tag, basis FROM steps WHERE n > 0"""


@register("WIN-12", _held(0.05, 0.0))
def sticky_keywords(spark, sf):
    """Weak rows inherit the last topic; it is held while its score is at least 0.9 of the best (here: within 0.05)."""
    return scan.sticky_hold(_scored(spark, sf), "package_id", ["start_sec", "segment_id"], "segment_id", "scores", "reset", within=0.05, least=0.0)


@register("WIN-14", _held(0.025, 0.48))
def sticky_semantic(spark, sf):
    """The last topic is held while it is within 0.025 of the best and at least 0.48."""
    return scan.sticky_hold(_scored(spark, sf), "package_id", ["start_sec", "segment_id"], "segment_id", "scores", "reset")


@register(
    "WIN-10",
    f"""WITH o AS (SELECT segment_id, package_id, start_sec, nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') AS own FROM {_SEG}),
       n AS (SELECT *, lag(own) OVER w AS before, lead(own) OVER w AS after FROM o WINDOW w AS (PARTITION BY package_id ORDER BY start_sec, segment_id)),
       r AS (SELECT *, greatest(700 - coalesce(length(own), 0) - 2, 0)::INT AS room FROM n),
       l AS (SELECT *, CASE WHEN length(before) <= room // 2 THEN before ELSE right(before, room // 2) END AS kept FROM r),
       c AS (SELECT segment_id, CASE WHEN length(concat_ws(' ', before, own, after)) > 700 THEN concat_ws(' ', nullif(kept, ''), own, nullif(substr(after, 1, room - coalesce(length(kept), 0)::INT), '')) ELSE concat_ws(' ', before, own, after) END AS context FROM l)
       SELECT segment_id, CASE WHEN context = '' THEN ' ' ELSE context END AS context FROM c""",
)
def context(spark, sf):
    hours = F.floor(F.col("start_sec") / 3600)
    return sequence.neighbour_context(_segments(spark, sf), "package_id", ["start_sec", "segment_id"], "text", place=hours).select("segment_id", "context")


@register(
    "WIN-11",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
            s AS (SELECT e.vec_id, round(list_dot_product(e.v, x.v), 6) AS s FROM e CROSS JOIN c JOIN e x ON x.vec_id = c.vec_id), t AS (SELECT vec_id, list(s ORDER BY s DESC) AS s FROM s GROUP BY vec_id)
       SELECT vec_id, s[1] AS top1, round(s[1] - s[2], 6) AS margin FROM t""",
)
def margin(spark, sf):
    from tessera.operators.vector import closest_entries

    rows = read_table(spark, sf, "embeddings")
    leaves = first_per_key(rows, ["label"], [F.col("vec_id")]).select("label", "embedding")
    top = closest_entries(rows, "vec_id", "embedding", leaves, "label", 2).groupBy("vec_id")
    best, second = (F.max(F.when(F.col("rank") == i, F.col("score"))) for i in (1, 2))
    return top.agg(best.alias("top1"), F.round(best - second, 6).alias("margin"))


@register(
    "WIN-13",
    f"""WITH r AS (SELECT package_id, segment_id, nullif(trim(primary_tag), '') AS tag, contains(text, 'agenda') AS reset, row_number() OVER (PARTITION BY package_id ORDER BY start_sec, segment_id) AS n FROM {_SEG}),
            l AS (SELECT *, last_value(CASE WHEN tag IS NOT NULL AND NOT coalesce(reset, false) THEN {{'v': tag, 'n': n}} END IGNORE NULLS) OVER w AS s, last_value(CASE WHEN reset THEN n END IGNORE NULLS) OVER w AS r FROM r WINDOW w AS (PARTITION BY package_id ORDER BY n ROWS UNBOUNDED PRECEDING))
       SELECT segment_id, CASE WHEN n - s.n <= 24 AND (r IS NULL OR r < s.n) THEN s.v END AS carried FROM l""",
)
def carried(spark, sf):
    rows = _segments(spark, sf).withColumn("tag", T.present(F.col("primary_tag")))
    return sequence.sticky(rows, "package_id", ["start_sec", "segment_id"], "tag", 24, F.contains("text", F.lit("agenda"))).select("segment_id", "carried")


@register(
    "WIN-15",
    """WITH r AS (SELECT record_id, source_name, score, row_number() OVER (PARTITION BY section ORDER BY score, record_id, ingested_at) AS n, min((score, record_id, ingested_at)) OVER (PARTITION BY section) AS f, ingested_at FROM gi_crc_standalone)
       SELECT record_id, ingested_at, row_number() OVER (ORDER BY n, f)::INT AS position FROM r QUALIFY position <= 50""",
)
def interleaved(spark, sf):
    rows = read_table(spark, sf, "gi_crc_standalone")
    return cards.interleave(rows, "section", ["score", "record_id", "ingested_at"], 50).select("record_id", "ingested_at", "position")


@register(
    "WIN-16",
    """WITH r AS (SELECT record_id, ingested_at, row_number() OVER (PARTITION BY section ORDER BY score, record_id, ingested_at) AS n, min((score, record_id, ingested_at)) OVER (PARTITION BY section) AS f FROM gi_crc_standalone),
            p AS (SELECT *, row_number() OVER (ORDER BY (n > 4)::INT, CASE WHEN n > 4 THEN n ELSE 0 END, f, n) AS position FROM r)
       SELECT record_id, ingested_at, position::INT AS position FROM p WHERE position <= 30""",
)
def capped(spark, sf):
    return cards.capped_with_floor(read_table(spark, sf, "gi_crc_standalone"), "section", ["score", "record_id", "ingested_at"], 30, 4).select("record_id", "ingested_at", "position")


@register("WIN-17", "SELECT record_id, ingested_at, url FROM records WHERE nullif(url, '') IS NULL UNION ALL SELECT * FROM (SELECT record_id, ingested_at, url FROM records WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY record_id, ingested_at) = 1)")
def deduped(spark, sf):
    rows = read_table(spark, sf, "records").select("record_id", "ingested_at", "url")
    return cards.first_seen(rows, F.nullif("url", F.lit("")), ["record_id", "ingested_at"])


@register("WIN-19", "SELECT video_url, arg_min(segment_id, (start_sec, segment_id)) AS segment_id FROM segments_indexable WHERE video_url IS NOT NULL GROUP BY video_url")
def collapsed(spark, sf):
    return read_table(spark, sf, "segments_indexable").where("video_url is not null").groupBy("video_url").agg(F.min_by("segment_id", F.struct("start_sec", "segment_id")).alias("segment_id"))


@register("WIN-20", f"SELECT package_id, arg_max(segment_id, (length(text), end_sec - start_sec, segment_id)) AS segment_id FROM {_SEG} WHERE end_sec IS NOT NULL GROUP BY package_id")
def best_segment(spark, sf):
    rows = _segments(spark, sf).where("end_sec is not null")
    return rows.groupBy("package_id").agg(F.max_by("segment_id", F.struct(F.char_length("text"), F.col("end_sec") - F.col("start_sec"), F.col("segment_id"))).alias("segment_id"))


@register(
    "WIN-23",
    """WITH r AS (SELECT record_id, source, tag_root, primary_tag FROM records WHERE primary_tag IS NOT NULL AND source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) = 1),
            n AS (SELECT *, row_number() OVER (PARTITION BY source, primary_tag ORDER BY record_id) AS n, count(*) OVER (PARTITION BY source, primary_tag) AS c FROM r)
       SELECT record_id, source, primary_tag FROM (SELECT * FROM n WHERE n <= 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY c DESC, primary_tag, n) <= 10""",
)
def source_balanced(spark, sf):
    rows = current_rows(read_table(spark, sf, "records").where("primary_tag is not null and source is not null"), "record_id", ["source", "primary_tag"])
    return sampling.balanced(rows, ["source"], "primary_tag", "record_id", 2, 10).select("record_id", "source", "primary_tag")


@register("WIN-29", "WITH c AS (SELECT tag_root, primary_tag, row_number() OVER (PARTITION BY tag_root ORDER BY primary_tag) AS n FROM canonical_tags) SELECT r.root, coalesce(c.primary_tag, 'none') AS example FROM (SELECT unnest(['GI', 'GU', 'Dental']) AS root) r LEFT JOIN c ON c.tag_root = r.root AND n <= 5")
def examples(spark, sf):
    n = F.row_number().over(Window.partitionBy("tag_root").orderBy("primary_tag"))
    some = read_table(spark, sf, "canonical_tags").withColumn("n", n).where("n <= 5").select(F.col("tag_root").alias("root"), "primary_tag")
    roots = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in ("GI", "GU", "Dental")))).alias("root"))
    return roots.join(some, "root", "left").select("root", F.coalesce("primary_tag", F.lit("none")).alias("example"))


@register("WIN-30", "SELECT lower(trim(chunk_type)) AS kind, first(chunk_type ORDER BY chunk_id, ingested_at) AS label, count(*) AS n FROM chunks GROUP BY 1")
def canonical_first(spark, sf):
    return read_table(spark, sf, "chunks").groupBy(F.lower(F.trim("chunk_type")).alias("kind")).agg(F.min_by("chunk_type", F.struct("chunk_id", "ingested_at")).alias("label"), F.count("*").alias("n"))


@register(
    "STR-02-batch",
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            n AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
       SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM n GROUP BY ALL""",
)
def sessionized(spark, sf):
    marked = sequence.sessions(read_table(spark, sf, "events"), "user_id", "ts", 6 * 3600)
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
