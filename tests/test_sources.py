"""Readers and sinks on small files."""

import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


LINES = '{"a": 1, "b": "x"}\n\n{"a": 2, broken\n{"a": 3}\n'


def test_json_lines_in_three_strictnesses(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text(LINES)
    assert rows(readers.jsonl_tolerant(spark, str(p), "a int, b string")) == [(1, "x"), (3, None)]
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl_strict(spark, str(p), "a int, b string").collect()
    errors = readers.jsonl_with_errors(spark, str(p), "a int, b string").where("parse_error is not null").collect()
    assert [r["parse_error"] for r in errors] == ['{"a": 2, broken']


def test_numbered_lines_with_limit(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"a": i}) + "\n\n" for i in range(5)))
    got = readers.jsonl_numbered(spark, str(tmp_path), "a int", limit=2)
    assert sorted((r["line_no"], r["a"]) for r in got.collect()) == [(1, 0), (1, 0), (2, 1), (2, 1)]


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2}]', '{"records": [{"a": 1}, {"a": 2}]}', '{"meta": 1, "rows": [{"a": 1}, {"a": 2}]}'])
def test_envelopes(spark, tmp_path, text):
    (tmp_path / "e.json").write_text(text)
    assert rows(readers.json_envelope(spark, str(tmp_path / "e.json"), "a int")) == [(1,), (2,)]


def test_single_object_envelope(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"a": 7}')
    assert rows(readers.json_envelope(spark, str(tmp_path / "e.json"), "a int")) == [(7,)]


def test_documents_and_archives(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "bad.docx").write_bytes(b"no")
    assert [r["text"] for r in readers.docx_paragraphs(spark, str(tmp_path)).orderBy("paragraph").collect()] == ["One two", "Three"]
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("a.json", json.dumps({"t": ["GI::Colon::Polyp", "x"]}))
        z.writestr("b.txt", "see GI::Colon::Polyp and HN::Larynx")
        z.writestr("c.bin", "ZZ::Top")
    assert rows(readers.harvest_tags(readers.zip_members(spark, str(tmp_path)))) == [("GI::Colon::Polyp",), ("HN::Larynx",)]


def png(width, height):
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def test_image_sizes(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(30, 20))
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 7, 9) + b"\x03" * 10)
    (tmp_path / "c.jp2").write_bytes(b"\x00\x00\x00\x0cjP  \r\n\x87\n" + b"\x00\x00\x00\x16ihdr" + struct.pack(">II", 5, 6) + b"\x00" * 6)
    (tmp_path / "d.png").write_bytes(b"?")
    got = {r["path"].rpartition("/")[2]: (r["width"], r["height"]) for r in readers.image_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (30, 20), "b.jpg": (9, 7), "c.jp2": (6, 5), "d.png": (None, None)}


def test_listing_prefers_suffix(spark, tmp_path):
    for n, c in (("x.txt", "1"), ("x.json", "1"), ("y.txt", "123")):
        (tmp_path / n).write_text(c)
    best = readers.best_file_per_stem(readers.listing(spark, str(tmp_path)), ["json", "txt"])
    assert sorted((r["stem"], r["path"].rpartition(".")[2], r["n_files"]) for r in best.collect()) == [("x", "json", 2), ("y", "txt", 1)]


def test_select_or_null(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert rows(readers.select_or_null(df, {"y": "string", "z": "double"})) == [("a", None)]


def test_csv_round_trip_with_nested_values(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', ["x", "y"]), (2, None, None)], "n int, t string, l array<string>")
    sinks.write_csv(df, str(tmp_path / "c"), ["t"])
    back = readers.csv_rows(spark, str(tmp_path / "c"))
    assert back.columns == ["t", "n", "l"]
    assert rows(back) == sorted([('a "q", b', "1", '["x","y"]'), (None, "2", None)], key=repr)


def test_checked_write_and_promotion(spark, tmp_path):
    live = str(tmp_path / "live")
    assert sinks.write_checked(spark.range(10), live) == 10
    assert sinks.write_checked(spark.range(4), live) == 4
    assert spark.read.parquet(live).count() == 4
    spark.range(2).write.parquet(str(tmp_path / "next"))
    sinks.promote(spark, str(tmp_path / "next"), live, keep_backup=True)
    assert spark.read.parquet(live).count() == 2 and spark.read.parquet(live + ".backup").count() == 4
    with pytest.raises(FileNotFoundError):
        sinks.promote(spark, str(tmp_path / "nothing"), live)


def test_manifest(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "t string")
    assert json.loads(sinks.manifest(df, ["t"])) == {"rows": 3, "t_values": 1, "t_nulls": 1}


def test_packages_with_faults_are_reported(spark, tmp_path):
    seg = lambda a, b: {"segment_id": f"s{a}", "start_sec": a, "end_sec": b, "text": "t"}
    cases = {"ok": [seg(0, 5), seg(5, 9)], "back": [seg(3, 5), seg(1, 2)], "ends": [seg(4, 3)], "none": []}
    for name, segments in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"package_id": name, "segments": segments}, indent=1))
    (tmp_path / "anon.json").write_text(json.dumps({"segments": [seg(0, 1)]}))
    taken, listed = readers.packages(spark, str(tmp_path))
    assert [(r["package_id"], r["place"], r["segment_id"]) for r in taken.orderBy("place").collect()] == [("ok", 0, "s0"), ("ok", 1, "s5")]
    assert {r["package_id"]: r["fault"] for r in listed.collect()} == {"ok": None, "back": "out of order", "ends": "ends before start", "none": "no segments", None: "no id"}


def test_literals_and_worksheets(spark, tmp_path):
    (tmp_path / "x.js").write_text('a = {entities: ["A \\"b\\"", "C"],\n entities : []}; z = {other: ["D"]}')
    assert rows(readers.literal_arrays(spark, str(tmp_path / "x.js"), "entities").select("entry")) == [('A "b"',), ("C",)]
    (tmp_path / "w.tsv").write_text("stray\tx\nOne\nEntity\tLink\nA\tu\tv1\n\nB\t\nTwo\nC\t u2 \n")
    got = rows(readers.tabbed_sections(spark, str(tmp_path / "w.tsv"), ["entity"]).select("section", "text", "url", "volume"))
    assert got == sorted([(None, "stray", "x", None), ("One", "A", "u", "v1"), ("One", "B", None, None), ("Two", "C", "u2", None)], key=repr)


def test_vectors_must_agree_with_their_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "b", [3.0, 4.0])], "id int, t string, v array<double>")
    assert sinks.write_vectors(df, str(tmp_path / "v"), "id", "v") == {"rows": 2, "dimension": 2}
    assert rows(readers.load_vectors(spark, str(tmp_path / "v"), "id").select("id", "t")) == [(1, "a"), (2, "b")]
    df.select("id", "v").limit(1).write.mode("append").parquet(str(tmp_path / "v" / "vectors"))
    with pytest.raises(RuntimeError):
        readers.load_vectors(spark, str(tmp_path / "v"), "id")
    with pytest.raises(ValueError, match="1 to 2"):
        sinks.write_vectors(df.unionByName(spark.createDataFrame([(3, "c", [1.0])], df.schema)), str(tmp_path / "w"), "id", "v")
    with pytest.raises(FileNotFoundError):
        readers.open_table(spark, str(tmp_path / "nothing"))


def test_pages_are_built_once(spark, tmp_path):
    built = []

    def build(keys):
        built.append(sorted(r["key"] for r in keys.collect()))
        return keys.withColumn("page", F.concat(F.lit("page "), "key"))

    keys = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    path = str(tmp_path / "pages")
    assert rows(sinks.read_through(spark, path, keys, build).select("key", "cached")) == [("a", False), ("b", False)]
    more = keys.unionByName(spark.createDataFrame([("c",)], "key string"))
    assert rows(sinks.read_through(spark, path, more, build).select("key", "page", "cached")) == [("a", "page a", True), ("b", "page b", True), ("c", "page c", False)]
    assert built == [["a", "b"], ["c"]] and {r["cached"] for r in sinks.read_through(spark, path, more, build).collect()} == {True}


def test_releases_archives_and_snapshots(spark, tmp_path):
    folder = tmp_path / "release"
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    before = spark.createDataFrame(sinks.checksums(spark, str(folder)).collect())
    sinks.package(spark, str(folder), str(tmp_path / "r.zip"), before)
    assert sorted(zipfile.ZipFile(tmp_path / "r.zip").namelist()) == ["SHA256SUMS", "a.txt"]
    (folder / "a.txt").write_text("two")
    (folder / "b.txt").write_text("new")
    assert rows(sinks.drift(before, sinks.checksums(spark, str(folder)))) == [("a.txt", "changed"), ("b.txt", "added")]
    with pytest.raises(RuntimeError):
        sinks.package(spark, str(folder), str(tmp_path / "s.zip"), before)
    done = sinks.archive(spark, [str(folder), str(tmp_path / "absent")], str(tmp_path / "old"))
    assert [(r["files"], r["bytes"], r["outcome"]) for r in done.collect()] == [(2, 6, "moved"), (0, 0, "missing")] and (tmp_path / "old" / "release" / "a.txt").exists()
    held = sinks.Snapshot(spark, str(tmp_path / "snap"))
    held.publish(spark.range(2), "v1")
    assert (held.table().count(), held.table().count(), held.reads) == (2, 2, 1)
    held.publish(spark.range(5), "v2")
    assert (held.table().count(), held.reads) == (5, 2)


def test_frames_end_with_a_result_or_an_error():
    assert list(sinks.frames(["x"], lambda: 7)) == ['event: progress\ndata: "x"\n\n', "event: result\ndata: 7\n\n"]
    assert list(sinks.frames([], lambda: 1 / 0))[-1].startswith('event: error\ndata: {"error": "ZeroDivisionError"')
