"""Named queries on streams, run to their end over the event table, and on reading back what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import Registry
from tessera.session import work_folder
from tessera.sources import readers, sinks
from tessera.sources.tables import read_table
from tessera.streaming import events as E

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


@register("STR-01", "SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf):
    counts = E.window_counts(E.event_stream(spark, f"{sf}/events.parquet"))
    out = E.run_to_table(counts, work_folder(spark), "update", ["event_type", "start"])
    return out.select("event_type", F.col("start").cast("date").alias("day"), "n", "total")


@register(
    "STR-02",
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            n AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
       SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM n GROUP BY user_id, session""",
)
def stream_sessions(spark, sf):
    counts = E.session_counts(E.event_stream(spark, f"{sf}/events.parquet"))
    out = E.run_to_table(counts, work_folder(spark), "complete")
    return out.select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n")


@register(
    "STR-03",
    """WITH r AS (SELECT *, row_number() OVER w AS n, max(CASE WHEN event_type = 'purchase' THEN 1 END) OVER w AS any_mark FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
            m AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS last FROM r)
       SELECT user_id, count(*) FILTER (WHERE event_type <> 'purchase' AND n - last <= 3) AS carried, count(*) FILTER (WHERE event_type <> 'purchase' AND (last IS NULL OR n - last > 3)) AS plain FROM m GROUP BY user_id""",
)
def stream_carried(spark, sf):
    state = E.carried_forward(E.event_stream(spark, f"{sf}/events.parquet"), "purchase", 3)
    return E.run_to_table(state, work_folder(spark), "update", ["user_id"])


@register("STR-06", "SELECT user_id, event_type, 1 AS n FROM events GROUP BY ALL")
def stream_first_seen(spark, sf):
    """Each user's first event of each type, whatever the number of rounds."""
    events = E.event_stream(spark, f"{sf}/events.parquet").withColumn("k", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    seen = E.first_seen(events, "k", "3650 days").select("user_id", "event_type")
    return E.run_to_table(seen, work_folder(spark), "append").groupBy("user_id", "event_type").agg(F.count("*").cast("int").alias("n"))


@register("STR-04", "SELECT count(*) AS done, true AS rising FROM events")
def stream_progress(spark, sf):
    frames = E.progress(E.event_stream(spark, f"{sf}/events.parquet").select("event_id"), work_folder(spark))
    done = [f["done"] for f in frames]
    return spark.createDataFrame([(done[-1], done == sorted(done))], "done bigint, rising boolean")


@register("SRC-01", "SELECT r_regionkey, r_name FROM region")
def jsonl_round_trip(spark, sf):
    path = work_folder(spark)
    sinks.write_jsonl(read_table(spark, sf, "region"), path, sort_keys=True, gzip=True)
    return readers.jsonl_tolerant(spark, path, "r_regionkey int, r_name string")


@register("SRC-06", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def csv_round_trip(spark, sf):
    path = work_folder(spark)
    sinks.write_csv(read_table(spark, sf, "nation"), path, ["n_name"])
    return readers.csv_rows(spark, path)


@register("SRC-07", "SELECT tag_id, primary_tag, NULL::VARCHAR AS missing FROM canonical_tags")
def sniffed(spark, sf):
    return readers.select_or_null(read_table(spark, sf, "canonical_tags"), {"tag_id": "int", "primary_tag": "string", "missing": "string"})


@register("SNK-03", "SELECT tag_root, count(*) AS n FROM canonical_tags GROUP BY 1")
def checked_table(spark, sf):
    path = work_folder(spark)
    sinks.write_checked(read_table(spark, sf, "canonical_tags"), path, ["tag_root"])
    return spark.read.parquet(path).groupBy("tag_root").agg(F.count("*").alias("n"))
