"""Named queries on predicates and gates."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.registry import Registry
from tessera.sources.tables import read_table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

#: What no tag may hold.
_FORBIDDEN = ("::Lectures::", "::Textbooks::", "::Error", "Slide_", "Page_", "Digital_Pathology_Slide", "Pathology_Slide", "rejected_generated")


@register("FLT-01", "SELECT record_id, ingested_at, primary_tag FROM records WHERE primary_tag IS NOT NULL AND NOT (" + " OR ".join(f"contains(primary_tag, '{p}')" for p in _FORBIDDEN) + ")")
def forbidden(spark, sf):
    hit = reduce(or_, (F.contains("primary_tag", F.lit(p)) for p in _FORBIDDEN))
    return read_table(spark, sf, "records").where(F.col("primary_tag").isNotNull() & ~hit).select("record_id", "ingested_at", "primary_tag")


#: What stands for no tag.
_HIDDEN = ("", "none", "null", "__unmapped__", "unmapped", "rejected", "rejected_generated", "excluded_junk", "hidden", "unmapped_no_context")


@register("FLT-02", f"SELECT lower(trim(coalesce(primary_tag, ''))) IN {_HIDDEN} AS hidden, count(*) AS n FROM records GROUP BY 1")
def hidden(spark, sf):
    return read_table(spark, sf, "records").groupBy(F.lower(F.trim(F.coalesce("primary_tag", F.lit("")))).isin(*_HIDDEN).alias("hidden")).agg(F.count("*").alias("n"))


_JUNK = r"(?i)^(page|slide|case)[ _]*[0-9]+|^[0-9.]+ ?(s|sec)$|[.](png|jpe?g|pdf|mp4)$"


@register("FLT-03", f"SELECT record_id, ingested_at, primary_tag FROM records WHERE regexp_matches(primary_tag, '{_JUNK}')")
def junk(spark, sf):
    return read_table(spark, sf, "records").where(F.col("primary_tag").rlike(_JUNK)).select("record_id", "ingested_at", "primary_tag")


@register("FLT-04", "SELECT record_id, ingested_at, primary_tag FROM records WHERE (primary_tag LIKE 'GI::%' OR primary_tag = 'Breast::Duct::Secretory_Carcinoma' OR tag_root = 'Heme') AND source IN ('textbooks', 'pathout')")
def tags(spark, sf):
    tag = F.col("primary_tag")
    wanted = tag.startswith("GI::") | (tag == "Breast::Duct::Secretory_Carcinoma") | (F.col("tag_root") == "Heme")
    return read_table(spark, sf, "records").where(wanted & F.col("source").isin("textbooks", "pathout")).select("record_id", "ingested_at", "primary_tag")


@register("FLT-05", "SELECT record_id, ingested_at FROM records WHERE (title ILIKE '%fibroma%' OR excerpt ILIKE '%fibroma%' OR url ILIKE '%fibroma%') AND source = 'lectures'")
def provenance(spark, sf):
    any_of = reduce(or_, (F.col(c).ilike("%fibroma%") for c in ("title", "excerpt", "url")))
    return read_table(spark, sf, "records").where(any_of & (F.col("source") == "lectures")).select("record_id", "ingested_at")


@register("FLT-06", "SELECT doc_id, title FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents f WHERE f.doc_id = d.doc_id AND f.n_chars <> length(f.text))")
def clean_only(spark, sf):
    docs = read_table(spark, sf, "documents")
    flagged = docs.where(F.col("n_chars") != F.char_length("text")).select("doc_id")
    return docs.join(flagged, "doc_id", "left_anti").select("doc_id", "title")


@register("FLT-07", "SELECT doc_id, root FROM documents WHERE source NOT IN ('textbook_gi', 'case_archive') OR root IS NULL OR root = 'GI'")
def narrowed(spark, sf):
    root, limited = F.col("root"), F.col("source").isin("textbook_gi", "case_archive")
    return read_table(spark, sf, "documents").where(~limited | root.isNull() | (root == "GI")).select("doc_id", "root")


@register("FLT-08", "SELECT chunk_id, ingested_at FROM chunks WHERE image_path IS NOT NULL AND starts_with(source_id, 'book_0')")
def figures_by_source(spark, sf):
    return read_table(spark, sf, "chunks").where(F.col("image_path").isNotNull() & F.col("source_id").startswith("book_0")).select("chunk_id", "ingested_at")


@register("FLT-16", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'wide' END, CASE WHEN p_size < 5 THEN 'tiny' END, CASE WHEN p_retailprice / p_size > 200 THEN 'strip' END], lambda x: x IS NOT NULL), ',') AS flags FROM part")
def flags(spark, sf):
    found = F.filter(F.array(F.when(F.col("p_size") > 40, "wide"), F.when(F.col("p_size") < 5, "tiny"), F.when(F.col("p_retailprice") / F.col("p_size") > 200, "strip")), lambda x: x.isNotNull())
    return read_table(spark, sf, "part").select("p_partkey", F.array_join(found, ",").alias("flags"))


@register("FLT-18", "SELECT chunk_id, ingested_at, CASE WHEN figure_id IS NOT NULL AND length(coalesce(text, '')) < 80 THEN NULL ELSE image_path END AS image_path FROM chunks")
def suppressed(spark, sf):
    tiny = F.col("figure_id").isNotNull() & (F.char_length(F.coalesce("text", F.lit(""))) < 80)
    return read_table(spark, sf, "chunks").select("chunk_id", "ingested_at", F.when(~tiny, F.col("image_path")).alias("image_path"))


@register("FLT-20", "SELECT count(*) AS n FROM chunks WHERE source_id IS NULL OR source_id NOT IN ('book_003', 'book_057', 'book_044')")
def denied(spark, sf):
    return read_table(spark, sf, "chunks").where(F.col("source_id").isNull() | ~F.col("source_id").isin("book_003", "book_057", "book_044")).agg(F.count("*").alias("n"))


@register("FLT-22", "SELECT CASE WHEN tag_root IN ('Cyto', 'Neuro') THEN 'listed' WHEN primary_tag LIKE '%Fibroma' THEN 'suffix' WHEN primary_tag LIKE 'GU::%' THEN 'prefix' ELSE 'kept' END AS reason, count(*) AS n FROM canonical_tags GROUP BY 1")
def drop_reasons(spark, sf):
    tag = F.col("primary_tag")
    why = F.when(F.col("tag_root").isin("Cyto", "Neuro"), "listed").when(tag.endswith("Fibroma"), "suffix").when(tag.startswith("GU::"), "prefix").otherwise("kept")
    return read_table(spark, sf, "canonical_tags").groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@register("FLT-23", "SELECT entity_id FROM canonical_entities WHERE contains(lower(entity_name || ' ' || coalesce(abbreviation, '')), 'cell') AND contains(lower(entity_name || ' ' || coalesce(abbreviation, '')), 'of the')")
def all_tokens(spark, sf):
    hay = F.lower(F.concat("entity_name", F.lit(" "), F.coalesce("abbreviation", F.lit(""))))
    return read_table(spark, sf, "canonical_entities").where(reduce(and_, (F.contains(hay, F.lit(t)) for t in ("cell", "of the")))).select("entity_id")


@register("FLT-24", "SELECT CASE lower(trim(source)) WHEN 'lecture' THEN 'lectures' WHEN 'video' THEN 'lectures' WHEN 'who' THEN 'compendium' ELSE lower(trim(source)) END AS source, count(*) AS n FROM gi_crc_standalone WHERE source IS NOT NULL GROUP BY 1")
def aliases(spark, sf):
    low = F.lower(F.trim("source"))
    table = F.create_map(*(F.lit(x) for x in ("lecture", "lectures", "video", "lectures", "who", "compendium")))
    return read_table(spark, sf, "gi_crc_standalone").where("source is not null").groupBy(F.coalesce(F.try_element_at(table, low), low).alias("source")).agg(F.count("*").alias("n"))


@register("FLT-25", "SELECT record_id, ingested_at FROM gi_crc_standalone WHERE section IN ('core', 'microscopy')")
def sections(spark, sf):
    return read_table(spark, sf, "gi_crc_standalone").where(F.col("section").isin("core", "microscopy")).select("record_id", "ingested_at")


@register("FLT-27", "SELECT segment_id, ingested_at FROM segments_indexable WHERE length(text) >= 40 AND end_sec - start_sec >= 4")
def long_enough(spark, sf):
    return read_table(spark, sf, "segments_indexable").where((F.char_length("text") >= 40) & (F.col("end_sec") - F.col("start_sec") >= 4)).select("segment_id", "ingested_at")
