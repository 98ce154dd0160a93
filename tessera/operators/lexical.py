"""BM25 over the texts themselves or over postings written once.

Postings hold a row per document and term, in buckets by the term's hash and
sorted by term within a file, so a search reads a few row groups of its terms'
buckets whatever the size of the corpus.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize
from tessera.session import cut_lineage


def query_terms(text: str, stop: Sequence[str], most: int = 12) -> list[str]:
    """Distinct words of a query worth searching, in order."""
    import re

    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(w for w in words if len(w) > 1 and w not in stop))[:most]


def bm25(docs: DataFrame, key: str, text: str, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Scores of the documents with any of the terms: key, n_terms (distinct terms hit), score.

    Texts are read once: that pass keeps the length and term counts of the
    documents with a hit, a few numbers each, and observes the corpus figures
    (documents, mean length, documents per term) on its way.  Counting is done
    on the text itself, without splitting it into words.  Null and empty texts
    count in the corpus with length 0.
    """
    padded = F.concat(F.lit(" "), F.replace(normalize(F.coalesce(F.col(text), F.lit(""))), F.lit(" "), F.lit("  ")), F.lit(" "))
    said = docs.select(key, padded.alias("_p"))
    gaps = F.length("_p") - F.length(F.replace("_p", F.lit("  "), F.lit(" ")))
    counts = [((F.length("_p") - F.length(F.replace("_p", F.lit(f" {t} "), F.lit("")))) / (len(t) + 2)).cast("int").alias(f"_f{i}") for i, t in enumerate(terms)]
    stats = said.select(key, F.when(F.trim("_p") == "", 0).otherwise(gaps + 1).alias("_len"), *counts)
    seen = Observation()
    some = stats.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("_len").alias("len"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in range(len(terms))))
    found = cut_lineage(some.where(" or ".join(f"_f{i} > 0" for i in range(len(terms)))))
    corpus = seen.get
    n, mean = corpus["n"] or 0, (corpus["len"] or 0) / max(1, corpus["n"] or 0)
    hit, score = F.lit(0), F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col(f"_f{i}"), corpus[f"d{i}"] or 0
        idf = math.log(1 + (n - d + 0.5) / (d + 0.5))
        score = score + F.lit(idf) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_len") / F.lit(mean)))
        hit = hit + (f > 0).cast("int")
    return found.select(key, hit.alias("n_terms"), F.round(score, 6).alias("score"))


def tiers(scored: DataFrame, key: str, n_terms: int, k: int) -> DataFrame:
    """Of scored documents the ``k`` best with all terms, or, should none have all, with any: key, tier, score, rank."""
    ranked = scored.withColumn("tier", F.when(F.col("n_terms") == n_terms, 1).otherwise(2)).orderBy("tier", F.desc("score"), key).limit(k)
    best = Window.orderBy("tier", F.desc("score"), key)  # over at most k rows
    return ranked.withColumn("rank", F.row_number().over(best)).withColumn("_best", F.min("tier").over(best)).where("tier = _best").select(key, "tier", "score", "rank")


def tiered_search(docs: DataFrame, key: str, text: str, terms: Sequence[str], k: int) -> DataFrame:
    """The strictest tier with any hit, read from the texts."""
    return tiers(bm25(docs, key, text, terms), key, len(terms), k)


def containing(docs: DataFrame, key: str, text: str, word: str, k: int) -> DataFrame:
    """The tier of last resort: documents that hold the letters of a word anywhere, by key, at score 9999."""
    hits = docs.where(F.contains(F.lower(text), F.lit(word.lower()))).select(key).orderBy(key).limit(k)
    return hits.select(key, F.lit(3).alias("tier"), F.lit(9999.0).alias("score"), F.row_number().over(Window.orderBy(key)).alias("rank"))


class Postings:
    """An inverted index at a path: ``build`` writes it, later sessions open it."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        said = json.loads(spark.read.text(f"{path}/corpus").first()[0])
        self.documents, self.words, self.buckets, self.kind = (said[k] for k in ("documents", "words", "buckets", "kind"))
        self._bucket: dict[str, int] = {}

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, path: str, buckets: int = 64, parts: int = 4, stop: Sequence[str] = ()) -> Postings:
        """Count every text's words once and write them out.

        Null and empty texts count in the corpus with length 0.  A term that
        stands in a third of all documents is written by ``parts`` tasks.
        """
        spark, left_out = docs.sparkSession, frozenset(stop)
        kind = docs.schema[key].dataType.simpleString()
        said = docs.select(F.col(key).alias("_k"), normalize(F.coalesce(F.col(text), F.lit(""))).alias("_t"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, terms, tf, size = [], [], [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    words = t.split()
                    found = Counter(words)
                    for w in found.keys() & left_out:
                        del found[w]
                    at += [i] * len(found)
                    terms += found.keys()
                    tf += found.values()
                    size += [len(words)] * len(found)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(tf, pa.int32()), pa.array(size, pa.int32())], names=[key, "term", "tf", "length"])

        rows = said.mapInArrow(count, f"`{key}` {kind}, term string, tf int, length int").withColumn("bucket", F.pmod(F.hash("term"), F.lit(buckets)))
        placed = rows.withColumn("_p", F.pmod(F.hash(key), F.lit(parts))).repartition("bucket", "_p").sortWithinPartitions("bucket", "term").drop("_p")
        placed.write.mode("overwrite").partitionBy("bucket").option("parquet.block.size", 16 << 20).parquet(f"{path}/postings")
        spaces = F.length("_t") - F.length(F.replace("_t", F.lit(" "), F.lit("")))
        n, words = said.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("_t") == "", 0).otherwise(spaces + 1)), F.lit(0))).first()
        corpus = json.dumps({"documents": n, "words": int(words), "buckets": buckets, "kind": kind})
        spark.createDataFrame([(corpus,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/corpus")
        return cls(spark, path, key)

    def of(self, terms: Sequence[str]) -> DataFrame:
        """The postings of some terms; others aren't read."""
        rows = self.spark.read.schema(f"`{self.key}` {self.kind}, term string, tf int, length int, bucket int").parquet(f"{self.path}/postings")
        new = [t for t in terms if t not in self._bucket]
        if new:  # one row without a table is worked out by the optimizer, not by a job
            hashed = self.spark.sql("SELECT 1").select(*(F.pmod(F.hash(F.lit(t)), F.lit(self.buckets)) for t in new)).first()
            self._bucket |= dict(zip(new, hashed, strict=True))
        return rows.where(F.col("bucket").isin(*{self._bucket[t] for t in terms}) & F.col("term").isin(*terms))

    def frequencies(self, terms: Sequence[str]) -> dict[str, int]:
        """The number of documents of each term that has any."""
        return {r["term"]: r["n"] for r in self.of(terms).groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row per term searched

    def bm25(self, terms: Sequence[str], k1: float = 1.2, b: float = 0.75, df: dict[str, int] | None = None) -> DataFrame:
        """As :func:`bm25` over the texts."""
        found = self.of(terms)
        df = self.frequencies(terms) if df is None else df
        mean = self.words / max(1, self.documents)
        weight = {t: math.log(1 + (self.documents - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in terms}
        part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean or 1.0)))
        each = found.groupBy(self.key).agg(F.count("*").cast("int").alias("n_terms"), *(F.sum(F.when(F.col("term") == t, part)).alias(f"_s{i}") for i, t in enumerate(terms)))
        score = F.lit(0.0)
        for i, t in enumerate(terms):
            score = score + F.lit(weight[t]) * F.coalesce(F.col(f"_s{i}"), F.lit(0.0))
        return each.select(self.key, "n_terms", F.round(score, 6).alias("score"))

    def search(self, docs: DataFrame, text: str, terms: Sequence[str], k: int) -> DataFrame:
        """The strictest of three tiers with any hit: all terms, any term, the first term's letters anywhere in a text."""
        if not terms:
            return containing(docs.limit(0), self.key, text, "", k)
        df = self.frequencies(terms)
        if not df:
            return containing(docs, self.key, text, terms[0], k)
        return tiers(self.bm25(terms, df=df), self.key, len(terms), k)
