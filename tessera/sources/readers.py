"""Readers: JSON lines in three strictnesses, JSON envelopes, CSV, archives, documents, images, listings."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; the first malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_with_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``parse_error`` (the malformed line, else null) and ``input_path``."""
    parsed = T._parse_datatype_string(schema).add("parse_error", T.StringType())
    rows = spark.read.schema(parsed).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "parse_error").json(path)
    return rows.withColumn("input_path", F.col("_metadata.file_path"))


def jsonl_numbered(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Objects with ``input_path`` and ``line_no`` (from 1 over non-blank lines of each file), the first ``limit`` per file.

    Each file is numbered on its own, which reads it in one task; many files are read in parallel.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("input_path"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    order = Window.partitionBy("input_path").orderBy("_b", "_i")
    rows = lines.where(F.trim("value") != "").withColumn("line_no", F.row_number().over(order))
    if limit:
        rows = rows.where(F.col("line_no") <= limit)
    return rows.withColumn("_r", F.from_json("value", schema)).where("_r is not null").select("input_path", "line_no", "_r.*")


ENVELOPE_KEYS = ("records", "items", "data", "results", "rows", "documents")


def json_envelope(spark: SparkSession, path: str, schema: str, keys: Sequence[str] = ENVELOPE_KEYS) -> DataFrame:
    """Records of whole-file JSON: a list, the first list under one of ``keys``, or a single object."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{_fields(schema)}>>")
    held = F.coalesce(*(F.from_json(F.get_json_object("value", f"$.{k}"), f"array<struct<{_fields(schema)}>>") for k in keys))
    single = F.array(F.from_json("value", f"struct<{_fields(schema)}>"))
    records = F.when(F.trim("value").startswith("["), listed).otherwise(F.coalesce(held, single))
    return whole.select(F.explode(records).alias("r")).select("r.*")


def _fields(schema: str) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in T._parse_datatype_string(schema).fields)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row; every column is a string."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def select_or_null(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The wanted columns with their types; absent ones are null."""
    return df.select(*((F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, stem, suffix, length and time of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_replace(name, "[.][^.]*$", "").alias("stem"), F.regexp_extract(name, "[.]([^.]*)$", 1).alias("suffix"), "length", F.col("modificationTime").alias("modified"))


def best_file_per_stem(files: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Of the files of a stem the one with the most preferred suffix, then the longest, latest, first by path."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in preferred)), F.lower("suffix")), F.lit(0))
    order = F.struct(F.when(rank == 0, 10**6).otherwise(rank), -F.col("length"), -F.unix_micros("modified"), F.col("path"))
    return files.groupBy("stem").agg(F.min_by("path", order).alias("path"), F.count("*").alias("n_files"))


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Path, paragraph (from 0) and text of the non-blank paragraphs of word-processor files; a broken file gives none."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                texts = (re.sub(r"\s+", " ", "".join(t.text or "" for t in p.iter(f"{w}t"))).strip() for p in body.iter(f"{w}p"))
                rows += [(name, i, t) for i, t in enumerate(x for x in texts if x)]
            yield pd.DataFrame(rows, columns=["path", "paragraph", "text"])

    return _binary(spark, path, "*.docx").mapInPandas(run, "path string, paragraph bigint, text string")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """Path, member and text of the text files within archives; a broken archive gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                rows += [(name, m, archive.read(m).decode("utf-8", "replace")) for m in archive.namelist() if m.endswith((".json", ".jsonl", ".txt", ".csv", ".md"))]
            yield pd.DataFrame(rows, columns=["path", "member", "text"])

    return _binary(spark, path, "*.zip").mapInPandas(run, "path string, member string, text string")


def harvest_tags(members: DataFrame) -> DataFrame:
    """Distinct tag paths (A::B or deeper) that stand in the texts of archive members."""
    return members.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z0-9_]*(?:::[A-Za-z0-9_]+)+"), F.lit(0))).alias("tag")).distinct()


def image_size(content: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, JPEG or JPEG 2000 image."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(content) and content[at] == 0xFF:
            kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", content[at + 5 : at + 9])
                return width, height
            at += 2 + size
    at = content.find(b"ihdr", 0, 4096)
    if at >= 0 and len(content) >= at + 12:
        height, width = struct.unpack(">II", content[at + 4 : at + 12])
        return width, height
    return None


def image_sizes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, width and height of images; both null where the header can't be read; files of no length are not listed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = [image_size(c) or (None, None) for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "width": pd.array([s[0] for s in sizes], "Int32"), "height": pd.array([s[1] for s in sizes], "Int32")})

    return _binary(spark, path, pattern).mapInPandas(run, "path string, width int, height int")


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """A table that must be there already; a missing one is named in the error."""
    from tessera.sources.sinks import exists

    if not exists(spark, path):
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(path)


def literal_arrays(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Path and entry of the quoted strings within every ``name: [...]`` of source files."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    lists = F.explode(F.regexp_extract_all("value", F.lit(rf"\b{re.escape(name)}\s*:\s*\[([^\]]*)\]"), F.lit(1)))
    entry = F.explode(F.regexp_extract_all("l", F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)))
    return whole.select("path", lists.alias("l")).select("path", entry.alias("entry")).select("path", F.regexp_replace("entry", r"\\(.)", "$1").alias("entry"))


def tabbed_sections(spark: SparkSession, path: str, headers: Sequence[str]) -> DataFrame:
    """Path, section, text, url and volume of dumped worksheets: a line without tabs opens a section, header and blank lines are passed over."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    cells = F.split("value", "\t")
    order = Window.partitionBy("path").orderBy("_b", "_i").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.where(F.trim("value") != "").withColumn("section", F.last(F.when(F.size(cells) == 1, F.trim("value")), ignorenulls=True).over(order))
    first = F.trim(cells[0])
    rows = marked.where((F.size(cells) > 1) & ~F.lower(first).isin(*(h.lower() for h in headers)))
    return rows.select("path", "section", first.alias("text"), F.nullif(F.trim(F.try_element_at(cells, F.lit(2))), F.lit("")).alias("url"), F.nullif(F.trim(F.try_element_at(cells, F.lit(3))), F.lit("")).alias("volume"))


_PACKAGE = "package_id string, title string, segments array<struct<segment_id:string,start_sec:double,end_sec:double,text:string>>"


def packages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Transcript packages, one JSON object a file: (rows of their segments, a row per package with what is wrong with it).

    A package without id or segments, with a segment that ends before it starts,
    or with segments out of order is faulty; its segments are left out.
    """
    read = spark.read.schema(_PACKAGE).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    each = F.col("segments")
    starts = F.transform(each, lambda s: s["start_sec"])
    fault = (
        F.when(F.col("package_id").isNull(), "no id")
        .when(F.coalesce(F.size(each), F.lit(0)) <= 0, "no segments")
        .when(F.exists(each, lambda s: s["end_sec"] < s["start_sec"]), "ends before start")
        .when(starts != F.array_sort(starts), "out of order")
    )
    checked = read.withColumn("fault", fault)
    rows = checked.where("fault is null").select("package_id", F.posexplode("segments").alias("place", "s")).select("package_id", "place", "s.*")
    return rows, checked.select("path", "package_id", "title", F.coalesce(F.size(each), F.lit(0)).alias("segments"), "fault")


def load_vectors(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Entries with their vectors, as :func:`tessera.sources.sinks.write_vectors` left them; counts must agree with the manifest."""
    import json

    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    entries, vectors = open_table(spark, f"{path}/entries"), open_table(spark, f"{path}/vectors")
    if not entries.count() == vectors.count() == manifest["rows"]:
        raise RuntimeError(f"entries and vectors at {path} do not agree with the manifest")
    return entries.join(vectors, key)
