"""DuckDB SQL for those queries of this package that SQL can express."""

from __future__ import annotations


def _current(table: str, key: str) -> str:
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ingested_at DESC) = 1)"


_RUN_ROWS = f"""
base AS (
  SELECT package_id, segment_id, start_sec AS s, coalesce(end_sec, start_sec) AS e, primary_tag AS tag,
         regexp_replace(lower(coalesce(primary_tag, '')), '[^a-z0-9]', '', 'g') AS k
  FROM {_current("segments_indexable", "segment_id")}
),
linked AS (
  SELECT *, CASE WHEN k <> '' AND lag(k) OVER w <> '' AND s - lag(e) OVER w <= 20 + 1e-6 AND levenshtein(k, lag(k) OVER w) <= 1 THEN 0 ELSE 1 END AS b
  FROM base WINDOW w AS (PARTITION BY package_id ORDER BY s, segment_id)
),
numbered AS (SELECT *, sum(b) OVER (PARTITION BY package_id ORDER BY s, segment_id) AS run FROM linked),
runs AS (
  SELECT package_id, run, arg_min(segment_id, (s, segment_id)) AS a, arg_max(segment_id, (s, segment_id)) AS z, first(tag ORDER BY s, segment_id) AS tag,
         count(*) AS n, min(s) AS s, arg_max(e, (s, segment_id)) AS e
  FROM numbered GROUP BY package_id, run
)"""

_WINDOWS = """
stretches AS (SELECT DISTINCT doc_id, md5(substr(text, i, 200)) AS h, i FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
shared AS (SELECT h FROM stretches GROUP BY h HAVING count(DISTINCT doc_id) > 1),
hits AS (SELECT s.* FROM stretches s JOIN shared USING (h))"""

_ALIKE = f"""
said AS (
  SELECT tbl, key, w FROM (
    SELECT tbl, key, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM (
      SELECT 'chunks' AS tbl, chunk_id AS key, text FROM {_current("chunks", "chunk_id")}
      UNION ALL SELECT 'journal_virchows', chunk_id, excerpt FROM {_current("journal_virchows", "chunk_id")})
  ) WHERE len(w) >= 20
),
features AS (SELECT DISTINCT tbl, key, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS f FROM (SELECT tbl, key, w, unnest(range(1, len(w) - 1)) AS i FROM said)),
feature_counts AS (SELECT tbl, key, count(*) AS n FROM features GROUP BY tbl, key),
common AS (SELECT a.tbl, a.key AS key_a, b.key AS key_b, count(*) AS c FROM features a JOIN features b ON a.f = b.f AND a.tbl = b.tbl AND a.key < b.key GROUP BY ALL),
alike AS (
  SELECT c.tbl, key_a, key_b FROM common c JOIN feature_counts x ON x.tbl = c.tbl AND x.key = key_a JOIN feature_counts y ON y.tbl = c.tbl AND y.key = key_b
  WHERE c >= 0.7 * (x.n + y.n - c) - 1e-9
)"""

_GROUPS = f"""{_ALIKE},
named AS (SELECT tbl, key, md5(array_to_string(w, ' ')) AS c FROM said),
edges AS (SELECT tbl, key_a, key_b FROM alike UNION SELECT tbl, key_b, key_a FROM alike),
reach AS (SELECT tbl, key, key AS other FROM named UNION SELECT r.tbl, r.key, e.key_b FROM reach r JOIN edges e ON e.tbl = r.tbl AND e.key_a = r.other),
grouped AS (SELECT tbl, key, min(other) AS group_id FROM reach GROUP BY tbl, key),
sizes AS (SELECT tbl, group_id, count(*) AS group_size FROM grouped GROUP BY tbl, group_id HAVING count(*) > 1),
linked AS (SELECT e.tbl, x.key, count(DISTINCT y.c) AS n_links FROM edges e JOIN named x ON x.tbl = e.tbl AND x.key = e.key_a JOIN named y ON y.tbl = e.tbl AND y.key = e.key_b WHERE x.c <> y.c GROUP BY e.tbl, x.key)"""

_DOCUMENTS = "(SELECT count(*) FROM documents)"

ORACLES = {
    "p1_groups": f"WITH RECURSIVE {_GROUPS} SELECT g.tbl, g.key, g.group_id, group_size, coalesce(n_links, 0) AS n_links FROM grouped g JOIN sizes USING (tbl, group_id) LEFT JOIN linked l ON l.tbl = g.tbl AND l.key = g.key",
    "p3_check": f"""
        WITH v AS (SELECT 'records' AS tbl, record_id, primary_tag AS v, primary_tag IN (SELECT primary_tag FROM canonical_tags) AS e FROM {_current("records", "record_id")}
          UNION ALL SELECT 'gi_crc_standalone', record_id, entity_name, entity_name IN (SELECT entity_name FROM canonical_entities) FROM {_current("gi_crc_standalone", "record_id")})
        SELECT tbl, count(*) AS records, count(*) FILTER (WHERE e) AS exact, 0 AS faults FROM v WHERE regexp_matches(v, '\\S') GROUP BY tbl""",
    "p5_check": f"""
        SELECT 'chunks' AS tbl, chunk_id AS record_key, md5(text) AS digest, true AS fits FROM {_current("chunks", "chunk_id")} WHERE length(text) > 1200
        UNION ALL SELECT 'tag_records', record_id, md5(text_excerpt), true FROM {_current("tag_records", "record_id")} WHERE length(text_excerpt) > 1200""",
    "p6_check": f"SELECT capacity_id, {_DOCUMENTS} AS documents, 0 AS torn, 0 AS overfull, 0 AS disordered FROM pack_capacities",
    "p7_check": "SELECT t.source, count(d.doc_id) AS documents, 0 AS repeated, 0 AS misreported, 0 AS doubled, false AS missed FROM mix_targets t LEFT JOIN documents d ON d.source = t.source GROUP BY t.source",
    "p8_check": f"WITH {_WINDOWS}, found AS (SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM hits a JOIN hits b ON a.h = b.h AND a.doc_id < b.doc_id) SELECT count(*) AS pairs, 0 AS short, 0 AS unlike, 0 AS extendable FROM found",
    "p1_found": f"WITH {_ALIKE} SELECT tbl, key_a, key_b FROM alike",
    "p2_found": f"WITH {_RUN_ROWS} SELECT package_id, a AS first_segment_id, z AS last_segment_id FROM runs WHERE n > 1",
    "p2_runs": f"WITH {_RUN_ROWS} SELECT package_id AS entity, a AS first_item, z AS last_item, tag, n AS n_items, s AS start_sec, e AS end_sec, round(e - s, 6) AS duration_sec FROM runs",
    "p5_found": f"""
        SELECT 'chunks' AS tbl, chunk_id AS record_key FROM {_current("chunks", "chunk_id")} WHERE length(text) > 1200
        UNION ALL SELECT 'tag_records', record_id FROM {_current("tag_records", "record_id")} WHERE length(text_excerpt) > 1200""",
    "p8_found": f"WITH {_WINDOWS} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM hits a JOIN hits b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p8_shared": f"""WITH {_WINDOWS}, covered AS (SELECT doc_id, count(DISTINCT c) AS n FROM (SELECT doc_id, unnest(range(i, i + 200)) AS c FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(length(d.text), 0) AS n_chars, coalesce(c.n, 0) AS shared_chars FROM documents d LEFT JOIN covered c USING (doc_id)""",
}
