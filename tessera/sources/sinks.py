"""Sinks: JSON lines, CSV with a union header, checked tables, staged promotion, manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, sort_keys: bool = False, gzip: bool = False) -> None:
    """One object per line; null fields are left out."""
    out = df.select(*sorted(df.columns)) if sort_keys else df
    out.write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


def union_header(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Preferred columns first, then the others as they come; nested values as JSON."""
    columns = [c for c in preferred if c in df.columns] + [c for c in df.columns if c not in preferred]
    kinds = dict(df.dtypes)
    return df.select(*(F.to_json(F.col(f"`{c}`")).alias(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c in columns))


def write_csv(df: DataFrame, path: str, preferred: Sequence[str] = ()) -> None:
    union_header(df, preferred).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def write_checked(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Write a table beside its place, count the written rows against those counted on the way, then move it there."""
    spark = df.sparkSession
    from pyspark.sql import Observation

    seen = Observation()
    staged = path.rstrip("/") + ".staged"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy(*partition_by).parquet(staged)
    written = spark.read.parquet(staged).count()
    if written != seen.get["n"]:
        raise RuntimeError(f"{written} of {seen.get['n']} rows were written")
    promote(spark, staged, path)
    return written


def promote(spark: SparkSession, staged: str, live: str, keep_backup: bool = False) -> None:
    """Put a staged folder in place of the live one, which becomes ``live.backup`` or goes."""
    fs, source, path = _fs(spark, staged)
    target, backup = path(live), path(live.rstrip("/") + ".backup")
    if not fs.exists(source):
        raise FileNotFoundError(staged)
    if fs.exists(target):
        if fs.exists(backup):
            fs.delete(backup, True)
        fs.rename(target, backup)
    if not fs.rename(source, target):
        raise RuntimeError(f"{staged} could not be moved to {live}")
    if not keep_backup and fs.exists(backup):
        fs.delete(backup, True)


def manifest(df: DataFrame, counts: Sequence[str]) -> str:
    """JSON of the number of rows and, per column, its values and nulls, in one pass."""
    measures = [F.count(F.lit(1)).alias("rows")]
    for c in counts:
        measures += [F.countDistinct(c).alias(f"{c}_values"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls")]
    return json.dumps(df.agg(*measures).first().asDict(), sort_keys=True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def modified(spark: SparkSession, path: str) -> int:
    """When a file or folder was last changed, in milliseconds."""
    fs, p, _ = _fs(spark, path)
    return fs.getFileStatus(p).getModificationTime()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, from the driver."""
    fs, p, _ = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_vectors(df: DataFrame, path: str, key: str, vector: str) -> dict:
    """Entries, vectors and a manifest of their number and dimension, each in a folder of its own."""
    spark = df.sparkSession
    df.drop(vector).write.mode("overwrite").parquet(f"{path}/entries")
    df.select(key, vector).write.mode("overwrite").parquet(f"{path}/vectors")
    sizes = spark.read.parquet(f"{path}/vectors").agg(F.count("*").alias("rows"), F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("most")).first()
    if sizes["least"] != sizes["most"]:
        raise ValueError(f"vectors of {sizes['least']} to {sizes['most']} numbers")
    found = {"rows": sizes["rows"], "dimension": sizes["most"]}
    spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return found


def append_log(df: DataFrame, path: str) -> None:
    """Add entries to a log that is never rewritten, each with an id and the time in UTC."""
    df.select(F.expr("uuid()").alias("entry_id"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("logged_at"), *df.columns).write.mode("append").json(path)


def read_through(spark: SparkSession, path: str, keys: DataFrame, build) -> DataFrame:
    """Pages of the wanted ``keys`` (key): those kept at ``path``, and those ``build`` makes of the rest, which are kept from then on.

    Gives key, page and cached (whether it was there before).
    """
    wanted = keys.select("key").distinct()
    if not exists(spark, path):
        build(wanted).select("key", "page").write.mode("append").parquet(path)
        return spark.read.parquet(path).join(wanted, "key", "left_semi").withColumn("cached", F.lit(False))
    kept = spark.read.parquet(path).groupBy("key").agg(F.first("page").alias("page"))
    there = kept.join(wanted, "key", "left_semi").withColumn("cached", F.lit(True))
    fresh = f"{path.rstrip('/')}.fresh-{uuid.uuid4().hex}"
    build(wanted.join(kept, "key", "left_anti")).select("key", "page").write.mode("overwrite").parquet(fresh)
    new = spark.read.schema("key string, page string").parquet(fresh)
    out = there.unionByName(new.withColumn("cached", F.lit(False)))
    new.write.mode("append").parquet(path)
    return out


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, length and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files that came, went or changed between two lists of checksums: name, change."""
    a, b = before.select("name", F.col("sha256").alias("a")), now.select("name", F.col("sha256").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "name", "full_outer").select("name", change.alias("change")).where("change is not null")


def package(spark: SparkSession, path: str, target: str, protected: DataFrame | None = None) -> DataFrame:
    """Zip the files of a release folder (it is small by nature) with a list of their checksums; ``protected`` ones may not have drifted."""
    import io
    import zipfile

    sums = checksums(spark, path)
    if protected is not None:
        moved = drift(protected, sums.join(protected, "name", "left_semi")).limit(5).collect()
        if moved:
            raise RuntimeError(f"protected files differ: {[tuple(m) for m in moved]}")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).orderBy("path").toLocalIterator():
            z.writestr(f["path"].rpartition("/")[2], bytes(f["content"]))
        z.writestr("SHA256SUMS", "".join(f"{s['sha256']}  {s['name']}\n" for s in sums.orderBy("name").toLocalIterator()))
    write_bytes(spark, target, held.getvalue())
    return sums


def archive(spark: SparkSession, prefixes: Sequence[str], target: str) -> DataFrame:
    """Move folders below ``target``: prefix, files and bytes it held, and whether it was moved or missing."""
    rows = []
    for prefix in prefixes:
        fs, p, path = _fs(spark, prefix)
        if not fs.exists(p):
            rows.append((prefix, 0, 0, "missing"))
            continue
        size = fs.getContentSummary(p)
        fs.mkdirs(path(target))
        moved = fs.rename(p, path(f"{target.rstrip('/')}/{p.getName()}"))
        rows.append((prefix, size.getFileCount(), size.getLength(), "moved" if moved else "kept"))
    return spark.createDataFrame(rows, "prefix string, files bigint, bytes bigint, outcome string")


class Snapshot:
    """A table that is read anew when its stamp has changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.stamp, self.reads = spark, path, None, 0
        self._df: DataFrame | None = None

    def publish(self, df: DataFrame, stamp: str) -> None:
        """Write the rows beside the others, then the stamp that names them."""
        df.write.mode("overwrite").parquet(f"{self.path}/{stamp}")
        write_bytes(self.spark, f"{self.path}/STAMP", stamp.encode())

    def table(self) -> DataFrame:
        stamp = self.spark.read.text(f"{self.path}/STAMP").first()[0]
        if stamp != self.stamp:
            self._df, self.stamp = self.spark.read.parquet(f"{self.path}/{stamp}"), stamp
            self.reads += 1
        return self._df


def frames(steps: Iterable, result: Callable) -> Iterator[str]:
    """Server-sent events of a run: one per step, then the result; an error ends them."""

    def frame(event: str, data) -> str:
        return f"event: {event}\ndata: {json.dumps(data, sort_keys=True)}\n\n"

    def run():
        try:
            for step in steps:
                yield frame("progress", step)
            yield frame("result", result())
        except Exception as e:  # noqa: BLE001 - the reader of the stream is told
            yield frame("error", {"error": type(e).__name__, "message": str(e)})

    return run()


def fetch(spark: SparkSession, source: str, cache: str, policy: str = "newer") -> tuple[str, str]:
    """(path of the cached copy of a file, what was done: ``copied`` or ``kept``).

    Policies: ``keep`` a copy that is there, copy if the source is ``newer`` than
    it or of another length, copy ``always``.  A missing source with a copy gives
    the copy unless the policy is ``always``.
    """
    if policy not in ("keep", "newer", "always"):
        raise ValueError(f"unknown policy {policy}")
    fs, p, path = _fs(spark, source)
    target = path(f"{cache.rstrip('/')}/{p.getName()}")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = store.exists(target)
    if held and policy != "always":
        if policy == "keep" or not fs.exists(p):
            return str(target), "kept"
        a, b = fs.getFileStatus(p), store.getFileStatus(target)
        if a.getModificationTime() <= b.getModificationTime() and a.getLen() == b.getLen():
            return str(target), "kept"
    if not fs.exists(p):
        raise FileNotFoundError(source)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, store, target, False, True, spark.sparkContext._jsc.hadoopConfiguration())
    return str(target), "copied"
