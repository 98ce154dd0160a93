"""Named queries on fields that pack several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.current import current_rows
from tessera.operators.multivalue import delimiter_profile, split_values
from tessera.sources.tables import read_table

FIELDS = ("primary_tags", "curriculum_tags", "candidate_tags")


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return current_rows(read_table(spark, sf, "curriculum_records"), "record_id", ["source", *FIELDS])


def p4_values(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record, field, position and tag."""
    return split_values(_rows(spark, sf), "record_id", "source", FIELDS, sources=read_table(spark, sf, "curriculum_records").select("source"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_values(spark, sf).where("n_values > 1").drop("n_values")


def p4_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The delimiters inferred for each source and field."""
    parts = [_rows(spark, sf).select("source", F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS]
    return delimiter_profile(parts[0].unionByName(parts[1]).unionByName(parts[2])).select("source", "field", "kind", F.array_join("delimiters", " ").alias("delimiters"), F.to_json("scores").alias("scores"))


QUERIES = {"p4_found": p4_found, "p4_values": p4_values, "p4_profile": p4_profile}

_SPLIT = r"""
rows AS (SELECT * FROM curriculum_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) = 1),
packed AS (SELECT record_id, 'primary_tags' AS field_name, primary_tags AS v FROM rows UNION ALL SELECT record_id, 'curriculum_tags', curriculum_tags FROM rows UNION ALL SELECT record_id, 'candidate_tags', candidate_tags FROM rows),
cut AS (SELECT record_id, field_name, string_split(regexp_replace(v, '[\s"''\\\[\]]*[;,|/\n\t][\s"''\;,|/\[\]]*([A-Za-z][A-Za-z0-9_]*::[A-Za-z])', chr(1) || '\1', 'g'), chr(1)) AS p FROM packed WHERE v IS NOT NULL),
clean AS (SELECT record_id, field_name, list_filter(list_transform(p, lambda x: replace(replace(regexp_replace(regexp_replace(x, '^[\s"''\\\[\];,|/]+', ''), '[\s"''\\\[\];,|/]+$', ''), '""', '"'), '\"', '"')), lambda x: x <> '') AS p FROM cut),
tags AS (SELECT record_id, field_name, unnest(range(1, len(p) + 1))::INT AS pos, len(p)::INT AS n_values, unnest(p) AS tag FROM clean)"""

ORACLES = {
    "p4_found": f"WITH {_SPLIT} SELECT record_id, field_name, pos, tag FROM tags WHERE n_values > 1",
    "p4_values": f"WITH {_SPLIT} SELECT record_id, field_name, pos, n_values, tag FROM tags",
}
