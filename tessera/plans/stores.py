"""Named queries that write with a sink, read back with a source, and compare with the table they came from."""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from tessera.operators import requests as R
from tessera.operators.vector import dot
from tessera.plans.registry import Registry
from tessera.session import work_folder
from tessera.sources import readers, sinks
from tessera.sources.tables import read_table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


def _lines(df, path: str, files: int = 1) -> str:
    """Rows of one string column as lines of a file."""
    df.coalesce(files).write.text(path)
    return path


def _whole_files(df, path: str) -> str:
    """Every row a file of its own."""
    df.write.option("maxRecordsPerFile", 1).text(path)
    return path


@register("SRC-02", "SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey)::INT AS line_no FROM nation QUALIFY line_no <= 10")
def numbered_lines(spark, sf):
    nation = read_table(spark, sf, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    path = _lines(nation.select(F.to_json(F.struct("n_nationkey", "n_name"))), work_folder(spark))
    return readers.jsonl_numbered(spark, path, "n_nationkey int, n_name string", limit=10).select("n_nationkey", "line_no")


@register("SRC-03", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def strict_lines(spark, sf):
    path = work_folder(spark)
    sinks.write_jsonl(read_table(spark, sf, "nation"), path)
    return readers.jsonl_strict(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@register("SRC-04", "SELECT p_partkey % 5 = 0 AS broken, count(*) AS n, coalesce(sum(p_size) FILTER (WHERE p_partkey % 5 <> 0), 0)::BIGINT AS size FROM part GROUP BY 1")
def lines_with_errors(spark, sf):
    part = read_table(spark, sf, "part")
    line = F.to_json(F.struct("p_partkey", "p_size"))
    path = _lines(part.select(F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("{broken "), line)).otherwise(line)), work_folder(spark), 4)
    rows = readers.jsonl_with_errors(spark, path, "p_partkey bigint, p_size int")
    return rows.groupBy(F.col("parse_error").isNotNull().alias("broken")).agg(F.count("*").alias("n"), F.coalesce(F.sum("p_size"), F.lit(0)).alias("size"))


@register("SRC-05", "SELECT n_nationkey, n_name FROM nation")
def envelopes(spark, sf):
    by = read_table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    kinds = F.when(F.col("n_regionkey") % 3 == 0, F.col("l")).when(F.col("n_regionkey") % 3 == 1, F.concat(F.lit('{"meta": 1, "rows": '), "l", F.lit("}"))).otherwise(F.concat(F.lit('{"records": '), "l", F.lit("}")))
    return readers.json_envelope(spark, _whole_files(by.select(kinds), work_folder(spark)), "n_nationkey int, n_name string")


@register("SRC-08", "SELECT tag_root, count(*) AS n, false AS missing FROM canonical_tags GROUP BY 1 UNION ALL SELECT 'absent', 0, true")
def opened(spark, sf):
    path = work_folder(spark)
    sinks.write_checked(read_table(spark, sf, "canonical_tags"), path)
    try:
        readers.open_table(spark, path + "-absent")
        missing = False
    except FileNotFoundError:
        missing = True
    there = readers.open_table(spark, path).groupBy("tag_root").agg(F.count("*").alias("n")).withColumn("missing", F.lit(False))
    return there.unionByName(spark.range(1).select(F.lit("absent").alias("tag_root"), F.lit(0).cast("bigint").alias("n"), F.lit(missing).alias("missing")))


@register("SNK-07", "SELECT count(*) AS rows, max(len(embedding))::INT AS dimension FROM embeddings")
def vectors_written(spark, sf):
    path = work_folder(spark)
    found = sinks.write_vectors(read_table(spark, sf, "embeddings"), path, "vec_id", "embedding")
    return spark.createDataFrame([(found["rows"], found["dimension"])], "rows bigint, dimension int")


@register("SRC-09", "SELECT vec_id, label, len(embedding)::INT AS dimension, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def vectors_loaded(spark, sf):
    path = work_folder(spark)
    sinks.write_vectors(read_table(spark, sf, "embeddings"), path, "vec_id", "embedding")
    return readers.load_vectors(spark, path, "vec_id").select("vec_id", "label", F.size("embedding").alias("dimension"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@register("SRC-10", "SELECT tag_id, tag_root AS root, lower(replace(split_part(primary_tag, '::', 3), '_', ' ')) AS leaf, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM canonical_tags JOIN embeddings ON vec_id = tag_id")
def leaf_vectors(spark, sf):
    path = work_folder(spark)
    tags = read_table(spark, sf, "canonical_tags").select("tag_id", "primary_tag", "tag_root")
    sinks.write_vectors(tags.join(read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("tag_id"), "embedding"), "tag_id"), path, "tag_id", "embedding")
    v = F.col("embedding")
    return readers.load_vectors(spark, path, "tag_id").select("tag_id", F.col("tag_root").alias("root"), F.lower(F.replace(F.element_at(F.split("primary_tag", "::"), 3), F.lit("_"), F.lit(" "))).alias("leaf"), F.round(F.sqrt(dot(v, v)), 6).alias("norm"))


def _regions(spark, sf):
    return read_table(spark, sf, "region").orderBy("r_regionkey").collect()  # a fixed table of a few rows


@register("SRC-12", "SELECT lower(replace(r_name, ' ', '_')) AS stem, unnest(['txt', 'json']) AS suffix, length(r_name) + 2::BIGINT AS length FROM region")
def listed(spark, sf):
    path = work_folder(spark)
    for r in _regions(spark, sf):
        for suffix in ("txt", "json"):
            sinks.write_bytes(spark, f"{path}/{r['r_name'].lower().replace(' ', '_')}.{suffix}", f'"{r["r_name"]}"'.encode())
    return readers.listing(spark, path).select("stem", "suffix", "length")


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


@register("SRC-13", "SELECT lower(replace(r_name, ' ', '_')) AS stem, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1)::BIGINT AS paragraph, n_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def paragraphs(spark, sf):
    path = work_folder(spark)
    nations = read_table(spark, sf, "nation").orderBy("n_nationkey").collect()  # a fixed table of a few rows
    for r in _regions(spark, sf):
        body = "".join(f"<w:p><w:r><w:t>{n['n_name'][:3]}</w:t></w:r><w:r><w:t>{n['n_name'][3:]}</w:t></w:r></w:p><w:p/>" for n in nations if n["n_regionkey"] == r["r_regionkey"])
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>')
        sinks.write_bytes(spark, f"{path}/{r['r_name'].lower().replace(' ', '_')}.docx", held.getvalue())
    return readers.docx_paragraphs(spark, path).select(F.regexp_extract("path", r"([^/]*)\.docx$", 1).alias("stem"), "paragraph", "text")


@register("SRC-15", "SELECT DISTINCT unnest(regexp_extract_all(primary_tag, '[A-Za-z][A-Za-z0-9_]*(?:::[A-Za-z0-9_]+)+')) AS tag FROM canonical_tags")
def harvested(spark, sf):
    path = work_folder(spark)
    by: dict[str, list[str]] = {}
    for t in read_table(spark, sf, "canonical_tags").select("primary_tag", "tag_root").collect():  # a fixed table of a few hundred rows
        by.setdefault(t["tag_root"], []).append(t["primary_tag"])
    for root, tags in by.items():
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("tags.json", json.dumps({"tags": tags[::2]}, ensure_ascii=False))
            z.writestr("notes/more.txt", "seen: " + " and ".join(tags[1::2]))
            z.writestr("image.bin", "Not::A::Text")
        sinks.write_bytes(spark, f"{path}/{root}.zip", held.getvalue())
    return readers.harvest_tags(readers.zip_members(spark, path))


@register("SRC-16", "SELECT root, entity_name AS entry FROM canonical_entities")
def literals(spark, sf):
    quoted = F.concat(F.lit('"'), F.replace("entity_name", F.lit('"'), F.lit('\\"')), F.lit('"'))
    one = F.concat(F.lit("const x = {root: '"), "root", F.lit("', entities: ["), F.array_join(F.collect_list(quoted), ", "), F.lit("], other: [\"no\"]};"))
    rows = read_table(spark, sf, "canonical_entities").groupBy("root").agg(one.alias("value"))
    path = work_folder(spark)
    rows.write.partitionBy("root").text(path)
    return readers.literal_arrays(spark, path, "entities").select(F.regexp_extract("path", "root=([^/]*)/", 1).alias("root"), "entry")


@register("SRC-17", "SELECT r_name AS section, n_name AS text, 'https://x.example/' || n_nationkey AS url, CASE WHEN n_nationkey % 2 = 0 THEN 'v' || n_nationkey END AS volume FROM nation JOIN region ON n_regionkey = r_regionkey")
def worksheet(spark, sf):
    nation, region = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    heads = region.select(F.col("r_regionkey").alias("k"), F.lit(-2).alias("o"), F.col("r_name").alias("value"))
    titles = region.select(F.col("r_regionkey").alias("k"), F.lit(-1).alias("o"), F.lit("Entity\tLink\tVolume").alias("value"))
    cells = F.concat("n_name", F.lit("\thttps://x.example/"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("\tv"), F.col("n_nationkey").cast("string"))).otherwise(""))
    rows = nation.select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("o"), cells.alias("value"))
    ordered = heads.unionByName(titles).unionByName(rows).coalesce(1).sortWithinPartitions("k", "o").select("value")
    return readers.tabbed_sections(spark, _lines(ordered, work_folder(spark)), ["entity"]).select("section", "text", "url", "volume")


def _png(width: int, height: int) -> bytes:
    head = b"IHDR" + struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + head + struct.pack(">I", zlib.crc32(head))


@register("SRC-22", "SELECT lower(replace(r_name, ' ', '_')) AS stem, (r_regionkey * 10 + 1)::INT AS width, (length(r_name))::INT AS height FROM region")
def images(spark, sf):
    path = work_folder(spark)
    for r in _regions(spark, sf):
        sinks.write_bytes(spark, f"{path}/{r['r_name'].lower().replace(' ', '_')}.png", _png(r["r_regionkey"] * 10 + 1, len(r["r_name"])))
    return readers.image_sizes(spark, path, "*.png").select(F.regexp_extract("path", r"([^/]*)\.png$", 1).alias("stem"), "width", "height")


@register(
    "SRC-23",
    """SELECT 'r' || r_regionkey AS package_id, CASE WHEN r_regionkey % 5 = 4 THEN 'ends before start' END AS fault, count(*)::BIGINT AS listed, CASE WHEN r_regionkey % 5 = 4 THEN 0 ELSE count(*) END::BIGINT AS taken
       FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey""",
)
def transcript_packages(spark, sf):
    end = F.when(F.col("n_regionkey") % 5 == 4, F.col("n_nationkey") - 1.0).otherwise(F.col("n_nationkey") + 0.5)
    segment = F.struct(F.col("n_nationkey").cast("double").alias("start_sec"), F.col("n_nationkey").cast("string").alias("segment_id"), end.alias("end_sec"), F.col("n_name").alias("text"))
    by = read_table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(segment)).alias("segments"))
    doc = F.to_json(F.struct(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("package_id"), "segments"))
    rows, listed = readers.packages(spark, _whole_files(by.select(doc), work_folder(spark)))
    taken = rows.groupBy("package_id").agg(F.count("*").alias("taken"))
    return listed.join(taken, "package_id", "left").select("package_id", "fault", F.col("segments").cast("bigint").alias("listed"), F.coalesce("taken", F.lit(0)).alias("taken"))


@register("SRC-25", "SELECT abbreviation, entity_name AS expansion, root, entity_id % 7 <> 0 AS enabled FROM canonical_entities WHERE abbreviation IS NOT NULL")
def rules(spark, sf):
    rule = F.struct("abbreviation", F.array("entity_name").alias("expansions"), F.array("root").alias("allowed_roots"), (F.col("entity_id") % 7 != 0).alias("enabled"))
    doc = read_table(spark, sf, "canonical_entities").where("abbreviation is not null").agg(F.to_json(F.struct(F.collect_list(rule).alias("rules"))))
    governed = R.rules_table(spark, _lines(doc, work_folder(spark)))
    return spark.createDataFrame([(r.abbreviation, r.expansions[0], min(r.allowed_roots), r.enabled) for r in governed.rules], "abbreviation string, expansion string, root string, enabled boolean")


@register("SNK-01", """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def sorted_lines(spark, sf):
    path = work_folder(spark)
    sinks.write_jsonl(read_table(spark, sf, "nation"), path, sort_keys=True)
    return spark.read.text(path).select(F.col("value").alias("line"))


@register("SNK-02", """SELECT n_name AS r0, n_nationkey::VARCHAR AS r1, '["' || n_name || '"]' AS r2, NULL::VARCHAR AS r3 FROM nation""")
def union_header(spark, sf):
    path = work_folder(spark)
    df = read_table(spark, sf, "nation").select("n_nationkey", F.array("n_name").alias("names"), "n_name", F.lit(None).cast("string").alias("none"))
    sinks.write_csv(df, path, ["n_name", "absent"])
    back = readers.csv_rows(spark, path)
    return back.toDF(*(f"r{i}" for i in range(len(back.columns))))


@register("SNK-04", "SELECT count(*) AS rows, true AS gzipped FROM orders")
def gzip_copy(spark, sf):
    path = work_folder(spark)
    sinks.write_jsonl(read_table(spark, sf, "orders").select("o_orderkey"), path, gzip=True)
    files = readers.listing(spark, path, "part-*").agg(F.bool_and(F.col("suffix") == "gz").alias("gzipped"))
    return readers.jsonl_strict(spark, path, "o_orderkey bigint").agg(F.count("*").alias("rows")).crossJoin(files)  # a row each


@register("SNK-08", "SELECT 'live' AS place, count(*) AS n FROM nation UNION ALL SELECT 'backup', count(*) FROM region")
def promoted(spark, sf):
    path = work_folder(spark)
    read_table(spark, sf, "region").write.parquet(f"{path}/live")
    read_table(spark, sf, "nation").write.parquet(f"{path}/staged")
    sinks.promote(spark, f"{path}/staged", f"{path}/live", keep_backup=True)
    places = {"live": f"{path}/live", "backup": f"{path}/live.backup"}
    out = [spark.read.parquet(p).agg(F.count("*").alias("n")).select(F.lit(k).alias("place"), "n") for k, p in places.items()]
    return out[0].unionByName(out[1])


@register("SNK-09", "SELECT count(*) AS rows, count(DISTINCT primary_tag) AS tags, count(*) FILTER (WHERE primary_tag IS NULL) AS untagged, count(DISTINCT source) AS sources FROM records")
def audit(spark, sf):
    found = json.loads(sinks.manifest(read_table(spark, sf, "records"), ["primary_tag", "source"]))
    return spark.createDataFrame([(found["rows"], found["primary_tag_values"], found["primary_tag_nulls"], found["source_values"])], "rows bigint, tags bigint, untagged bigint, sources bigint")


@register("SNK-10", "SELECT event_type, count(*) AS n, count(*) AS ids, true AS stamped FROM events GROUP BY 1")
def feedback_log(spark, sf):
    path, events = work_folder(spark), read_table(spark, sf, "events").select("event_id", "event_type")
    for half in (0, 1):
        sinks.append_log(events.where(F.col("event_id") % 2 == half), path)
    rows = spark.read.schema("entry_id string, logged_at string, event_id bigint, event_type string").json(path)
    stamped = F.bool_and(F.col("logged_at").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z$")).alias("stamped")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("entry_id").alias("ids"), stamped)


@register("SNK-11", "SELECT tag_root AS key, tag_root || ': ' || count(*) AS page, tag_root < 'H' AS cached FROM canonical_tags GROUP BY tag_root")
def cached_pages(spark, sf):
    path, tags = work_folder(spark) + "/pages", read_table(spark, sf, "canonical_tags").withColumnRenamed("tag_root", "key")

    def build(keys):
        return tags.join(keys, "key").groupBy("key").agg(F.concat(F.first("key"), F.lit(": "), F.count("*").cast("string")).alias("page"))

    sinks.read_through(spark, path, tags.where("key < 'H'"), build)
    return sinks.read_through(spark, path, tags, build)


@register("SNK-12", "SELECT 'progress' AS event, r_name AS said FROM region UNION ALL SELECT 'result', count(*)::VARCHAR FROM nation")
def event_frames(spark, sf):
    sent = sinks.frames((r["r_name"] for r in _regions(spark, sf)), lambda: str(read_table(spark, sf, "nation").count()))
    rows = [(f.split("\n")[0].removeprefix("event: "), json.loads(f.split("\n")[1].removeprefix("data: "))) for f in sent]
    return spark.createDataFrame(rows, "event string, said string")


@register("SNK-14", "SELECT lower(replace(r_name, ' ', '_')) || '.txt' AS name, length(r_name)::BIGINT AS length, sha256(r_name) AS sha256 FROM region")
def release(spark, sf):
    path = work_folder(spark)
    for r in _regions(spark, sf):
        sinks.write_bytes(spark, f"{path}/{r['r_name'].lower().replace(' ', '_')}.txt", r["r_name"].encode())
    before = sinks.checksums(spark, path)
    return sinks.package(spark, path, path + "-release.zip", protected=before)


@register("ORC-11", "SELECT 'there' AS prefix, count(*) AS files, sum(length(r_name))::BIGINT AS bytes, 'moved' AS outcome FROM region UNION ALL SELECT 'absent', 0, 0, 'missing'")
def archived(spark, sf):
    path = work_folder(spark)
    for r in _regions(spark, sf):
        sinks.write_bytes(spark, f"{path}/there/{r['r_regionkey']}.txt", r["r_name"].encode())
    done = sinks.archive(spark, [f"{path}/there", f"{path}/absent"], f"{path}/archive")
    return done.withColumn("prefix", F.element_at(F.split("prefix", "/"), -1))


@register("STR-05", "SELECT 'first' AS stamp, count(*) AS n, 1 AS reads FROM region UNION ALL SELECT 'again', count(*), 1 FROM region UNION ALL SELECT 'second', count(*), 2 FROM nation")
def refreshed(spark, sf):
    held, rows = sinks.Snapshot(spark, work_folder(spark)), []
    held.publish(read_table(spark, sf, "region").select(F.col("r_name").alias("name")), "v1")
    for stamp in ("first", "again"):
        rows.append((stamp, held.table().count(), held.reads))
    held.publish(read_table(spark, sf, "nation").select(F.col("n_name").alias("name")), "v2")
    rows.append(("second", held.table().count(), held.reads))
    return spark.createDataFrame(rows, "stamp string, n bigint, reads int")


@register("SRC-11", "SELECT r_name AS name, 'copied' AS first, 'kept' AS again, 'copied' AS changed, 'kept' AS gone, length(r_name) + 1 AS length FROM region")
def fetched(spark, sf):
    path, rows = work_folder(spark), []
    for r in _regions(spark, sf):
        source = f"{path}/from/{r['r_regionkey']}.txt"
        sinks.write_bytes(spark, source, r["r_name"].encode())
        steps = [sinks.fetch(spark, source, f"{path}/cache", "newer")[1], sinks.fetch(spark, source, f"{path}/cache", "newer")[1]]
        sinks.write_bytes(spark, source, (r["r_name"] + "!").encode())
        steps.append(sinks.fetch(spark, source, f"{path}/cache", "newer")[1])
        sinks.archive(spark, [source], f"{path}/away")
        held, last = sinks.fetch(spark, source, f"{path}/cache", "keep")
        rows.append((r["r_name"], *steps, last, len(spark.read.text(held, wholetext=True).first()[0])))
    return spark.createDataFrame(rows, "name string, first string, again string, changed string, gone string, length bigint")
