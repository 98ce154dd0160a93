"""Named queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.canon import match_values
from tessera.llm.mix import mix_sources
from tessera.llm.neardup import NearDuplicates
from tessera.llm.pack import fill_report, pack_containers
from tessera.llm.runs import collapse_runs
from tessera.llm.spans import SharedSpans
from tessera.llm.split import split_oversized
from tessera.llm.tokens import VOCABULARY, count_tokens
from tessera.operators.current import current_rows
from tessera.session import cut_lineage
from tessera.sources.tables import read_table

# --- 1: near-duplicates


def _alike(spark: SparkSession, sf: str) -> NearDuplicates:
    parts = [
        current_rows(read_table(spark, sf, t), "chunk_id", [c]).select(F.lit(t).alias("tbl"), F.col("chunk_id").alias("key"), F.col(c).alias("text"))
        for t, c in (("chunks", "text"), ("journal_virchows", "excerpt"))
    ]
    return NearDuplicates(parts[0].unionByName(parts[1]))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _alike(spark, sf).pairs()


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The groups of records that are alike."""
    return _alike(spark, sf).groups()


# --- 2: runs of consecutive events


def p2_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per run of each lecture package."""
    rows = current_rows(read_table(spark, sf, "segments_indexable"), "segment_id", ["package_id", "start_sec", "end_sec", "primary_tag"])
    return collapse_runs(rows, "package_id", "segment_id", "start_sec", "end_sec", "primary_tag")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_runs(spark, sf).where("n_items > 1").select(F.col("entity").alias("package_id"), F.col("first_item").alias("first_segment_id"), F.col("last_item").alias("last_segment_id"))


# --- 3: canonical lists


def _mapped(spark: SparkSession, sf: str, **how) -> list[DataFrame]:
    """Per table tbl, record_id, value, name (of the entry it equals), canon_id and similarity of the current rows with a value."""
    tags, entities = read_table(spark, sf, "canonical_tags"), read_table(spark, sf, "canonical_entities")
    lists = {
        "records": ("primary_tag", tags.select(F.col("tag_id").cast("int").alias("id"), F.col("primary_tag").alias("name"), F.lit(None).cast("string").alias("alias"), F.element_at(F.split("primary_tag", "::"), -1).alias("core"))),
        "gi_crc_standalone": ("entity_name", entities.select(F.col("entity_id").cast("int").alias("id"), F.col("entity_name").alias("name"), F.col("abbreviation").alias("alias"), F.split("entity_name", " of ")[0].alias("core"))),
    }
    out = []
    for table, (column, entries) in lists.items():
        rows = cut_lineage(current_rows(read_table(spark, sf, table), "record_id", [column]).select("record_id", F.col(column).alias("value")))
        found = match_values(rows, entries, **how).join(entries.select("name").distinct(), F.col("value") == F.col("name"), "left")
        out.append(rows.join(found, "value").select(F.lit(table).alias("tbl"), "record_id", "value", "name", "canon_id", "similarity"))
    return out


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _mapped(spark, sf)
    return a.unionByName(b).where("name is null").select("tbl", "record_id", "canon_id")


def p3_mapped(spark: SparkSession, sf: str) -> DataFrame:
    """Every current value with the entry that was meant."""
    a, b = _mapped(spark, sf)
    return a.unionByName(b).drop("name")


def p3_joined(spark: SparkSession, sf: str) -> DataFrame:
    """As p3_mapped, by the shuffled prefix join that lists beyond any task's memory take."""
    a, b = _mapped(spark, sf, most_entries=0)
    return a.unionByName(b).drop("name")


def p3_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Values that match no entry, with their number of records."""
    a, b = _mapped(spark, sf)
    return a.unionByName(b).where("canon_id = -1").groupBy("tbl", "value").agg(F.count("*").alias("n_records"))


def p3_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per table its values, those equal to an entry that got another id, and whether each has one row and an id that exists."""
    a, b = _mapped(spark, sf)
    known = read_table(spark, sf, "canonical_tags").select(F.lit("records").alias("tbl"), F.col("tag_id").alias("known"))
    known = known.unionByName(read_table(spark, sf, "canonical_entities").select(F.lit("gi_crc_standalone").alias("tbl"), F.col("entity_id").alias("known"))).distinct()
    rows = a.unionByName(b).join(known.withColumnRenamed("tbl", "_t"), (F.col("tbl") == F.col("_t")) & (F.col("canon_id") == F.col("known")), "left")
    one = rows.groupBy("tbl", "record_id").agg(F.count("*").alias("n"), F.max((F.col("name").isNotNull() & (F.col("similarity") < 1)).cast("int")).alias("wrong"), F.max((F.col("known").isNull() & (F.col("canon_id") != -1)).cast("int")).alias("unknown"), F.max(F.col("name").isNotNull().cast("int")).alias("exact"))
    return one.groupBy("tbl").agg(F.count("*").alias("records"), F.sum("exact").alias("exact"), F.sum(F.col("wrong") + F.col("unknown") + (F.col("n") - 1)).alias("faults"))


# --- 5: cutting oversized texts

_LONG = (("chunks", "chunk_id", "text"), ("tag_records", "record_id", "text_excerpt"))


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of at most 1,200 characters of every longer current text."""
    parts = [split_oversized(current_rows(read_table(spark, sf, t), k, [c]), k, c, t) for t, k, c in _LONG]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_pieces(spark, sf).where("piece = 0").select("tbl", "record_key")


def p5_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per cut text the digest of what its pieces make when put together again, and whether all keep the limits."""
    held = F.sort_array(F.collect_list(F.struct("piece", "overlap", "text")))
    texts = p5_pieces(spark, sf).groupBy("tbl", "record_key").agg(held.alias("p"), F.max(F.char_length("text")).alias("longest"), F.max("overlap").alias("overlap"), F.count("*").alias("n"), F.max("n_pieces").alias("said"))
    whole = F.array_join(F.transform("p", lambda x: F.substr(x["text"], x["overlap"].cast("int") + 1)), "")
    return texts.select("tbl", "record_key", F.md5(whole).alias("digest"), ((F.col("longest") <= 1200) & (F.col("overlap") <= 120) & (F.col("n") == F.col("said"))).alias("fits"))


# --- 6: filling containers


def p6_pack(spark: SparkSession, sf: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document in a container of each capacity."""
    sizes = count_tokens(read_table(spark, sf, "documents"), "text", {"doc_id": "bigint"}, vocabulary)
    return pack_containers(sizes, read_table(spark, sf, "pack_capacities"))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(p6_pack(spark, sf), read_table(spark, sf, "pack_capacities"))


def p6_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per capacity the documents placed, and the number of overfull containers, of broken orders of places, and of documents split without need."""
    rooms = read_table(spark, sf, "pack_capacities").select("capacity_id", "capacity_tokens").distinct()
    packed = cut_lineage(p6_pack(spark, sf))
    boxes = packed.groupBy("capacity_id", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"), F.sum("place").alias("places")).join(rooms, "capacity_id")
    in_order = (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("places") == F.col("n") * (F.col("n") + 1) / 2)
    faults = boxes.groupBy("capacity_id").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"), F.count_if(~in_order).alias("disordered"))
    docs = packed.groupBy("capacity_id", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).join(rooms, "capacity_id")
    return docs.groupBy("capacity_id").agg(F.count("*").alias("documents"), F.count_if(F.col("n") != F.greatest(F.lit(1), F.ceil(F.col("t") / F.col("capacity_tokens")))).alias("torn")).join(faults, "capacity_id")


# --- 7: mixing sources


def _mix(spark: SparkSession, sf: str, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    sizes = count_tokens(read_table(spark, sf, "documents"), "text", {"doc_id": "bigint", "source": "string"}, vocabulary)
    return mix_sources(sizes, read_table(spark, sf, "mix_targets"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mix with their number of copies."""
    return _mix(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Per source the target and the actual share."""
    return _mix(spark, sf)[1]


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per target source its documents, and the number of documents repeated too often, of tokens the report has too many, and of targets missed that could be met.

    A target can be met but for its last tokens if the source's repeats suffice; then it counts as missed beyond the longest document.
    """
    mix, report = _mix(spark, sf)
    mix = cut_lineage(mix)
    targets = report.where("target_share is not null")
    by = mix.join(targets.select("source", "max_repeats"), "source").groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("over"), F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids"), F.max("tokens").alias("longest"))
    all_of = targets.join(by, "source", "left").na.fill(0, ["t", "over", "rows", "ids", "longest"])
    enough = F.col("available_tokens") * F.col("max_repeats") >= F.col("target_tokens")
    missed = enough & (F.abs(F.col("mixed_tokens") - F.col("target_tokens")) > F.col("longest"))
    short = ~enough & (F.col("mixed_tokens") != F.col("available_tokens") * F.col("max_repeats"))
    return all_of.select("source", "documents", F.col("over").alias("repeated"), F.abs(F.col("t") - F.col("mixed_tokens")).cast("bigint").alias("misreported"), (F.col("rows") - F.col("ids")).alias("doubled"), (missed | short).alias("missed"))


# --- 8: verbatim spans


def _spans(spark: SparkSession, sf: str) -> tuple[DataFrame, SharedSpans]:
    docs = read_table(spark, sf, "documents")
    return docs, SharedSpans(docs, "doc_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf)[1].pairs()


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The stretches that pairs of documents share."""
    return _spans(spark, sf)[1].spans


def p8_shared(spark: SparkSession, sf: str) -> DataFrame:
    """How many characters of each document stand elsewhere."""
    docs, shared = _spans(spark, sf)
    return shared.coverage(docs, "doc_id", "text")


def p8_check(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs share a stretch, and how many stretches are short, differ between their texts, or could be longer."""
    docs, shared = _spans(spark, sf)
    texts = docs.select("doc_id", "text")
    a, b = texts.toDF("doc_a", "ta"), texts.toDF("doc_b", "tb")
    both = shared.spans.join(a, "doc_a").join(b, "doc_b")

    def at(text: str, start: Column, length: Column) -> Column:
        return F.substr(F.col(text), start.cast("int") + 1, length.cast("int"))

    x, y, n, one = F.col("start_a"), F.col("start_b"), F.col("length"), F.lit(1)
    before = (x > 0) & (y > 0) & (at("ta", x - 1, one) == at("tb", y - 1, one))
    after = (x + n < F.char_length("ta")) & (y + n < F.char_length("tb")) & (at("ta", x + n, one) == at("tb", y + n, one))
    faults = both.agg(F.count_if(n < 200).alias("short"), F.count_if(at("ta", x, n) != at("tb", y, n)).alias("unlike"), F.count_if(before | after).alias("extendable"))
    return shared.pairs().agg(F.count("*").alias("pairs")).crossJoin(faults)  # a row each


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_runs": p2_runs,
    "p3_found": p3_found,
    "p3_mapped": p3_mapped,
    "p3_joined": p3_joined,
    "p3_unmatched": p3_unmatched,
    "p3_check": p3_check,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_check": p5_check,
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p6_check": p6_check,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_check": p7_check,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p8_shared": p8_shared,
    "p8_check": p8_check,
}
