"""Fuzzy joins to a list of entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.similarity import token_set_from

#: Words that say too little to match on.
GENERIC = (
    "carcinoma", "carcinomas", "adenocarcinoma", "adenocarcinomas", "tumor", "tumour", "tumors", "tumours", "neoplasm", "neoplasms", "lesion", "lesions",
    "cell", "cells", "clear", "gland", "glands", "malignant", "benign", "carcinosarcoma", "of", "in", "situ",
)


def edit_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def blocked_best(values: DataFrame, entries: DataFrame, value: str, entry: str, entry_id: str, block: Callable[[Column], Column], least: float) -> DataFrame:
    """The most similar entry of each distinct value among those of its block, else among all, if similar enough; ties go to the smaller id.

    Values without an entry in their block, or with a null block, are compared
    with every entry whose length allows the similarity.  The entries are a
    fixed list.  The join is on the block key alone, so a large block may be
    split; the best is an aggregation with map-side combine.
    """
    a = values.select(F.col(value).alias("value")).withColumn("_b", block(F.col("value")))
    b = entries.select(F.col(entry).alias("_e"), F.col(entry_id).alias("_id")).withColumn("_b", block(F.col("_e")))
    alone = a.join(F.broadcast(b.select("_b").distinct()), "_b", "left_anti")
    longer, shorter = F.greatest(F.length("value"), F.length("_e")), F.least(F.length("value"), F.length("_e"))
    near = alone.select("value").join(F.broadcast(b.drop("_b")), longer - shorter <= longer * (1 - least) + 0.001)
    pairs = a.join(b, "_b").select("value", "_e", "_id").unionByName(near.select("value", "_e", "_id"))
    scored = pairs.withColumn("similarity", F.round(edit_similarity(F.col("value"), F.col("_e")), 6)).where(F.col("similarity") >= least)
    best = scored.groupBy("value").agg(F.max(F.struct("similarity", (-F.col("_id")).alias("n"))).alias("x"))
    return best.select("value", (-F.col("x.n")).alias(entry_id), F.col("x.similarity").alias("similarity"))


def distinctive(text: Column) -> Column:
    """Distinct words of a normalised text that have over two letters and are not generic."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: (F.length(w) > 2) & ~w.isin(*GENERIC)))


def conservative_best(values: DataFrame, entries: DataFrame, value: str, entry: str, entry_id: str) -> DataFrame:
    """The best entry of each distinct normalised value: the same text, else the highest score of at least 0.5; ties go to the smaller id.

    Where one text holds the other the score is the shorter length over the longer, elsewhere the shared distinctive words over the larger set of them.
    Either needs a distinctive word in the value.  Blank values and entries match nothing.  The entries are a fixed list.
    """
    a = values.select(F.col(value).alias("value")).where("value <> ''").distinct().withColumn("_w", distinctive(F.col("value")))
    b = entries.select(F.col(entry).alias("_e"), F.col(entry_id).alias("_id")).where("_e <> ''")
    same, inside = F.col("value") == F.col("_e"), F.contains("value", F.col("_e")) | F.contains("_e", F.col("value"))
    lengths = F.least(F.length("value"), F.length("_e")) / F.greatest(F.length("value"), F.length("_e"))
    held = a.join(F.broadcast(b), same | (inside & (F.size("_w") > 0))).select("value", "_id", same.alias("_same"), lengths.alias("score"))
    words = b.withColumn("_v", distinctive(F.col("_e"))).select("_e", "_id", F.size("_v").alias("_m"), F.explode("_v").alias("_t"))
    shared = a.select("value", F.size("_w").alias("_n"), F.explode("_w").alias("_t")).join(F.broadcast(words), "_t").groupBy("value", "_e", "_id").agg((F.count("*") / F.greatest(F.max("_n"), F.max("_m"))).alias("score"))
    pairs = held.unionByName(shared.where(~inside).select("value", "_id", F.lit(False).alias("_same"), "score")).where("score >= 0.5")
    best = pairs.groupBy("value").agg(F.max(F.struct("_same", F.round("score", 6).alias("score"), (-F.col("_id")).alias("n"))).alias("x"))
    return best.select("value", (-F.col("x.n")).alias(entry_id), F.col("x.score").alias("score"))


def token_set_best(values: DataFrame, entries: DataFrame, value: str, entry: str, entry_id: str, least: float) -> DataFrame:
    """The entry of the highest token-set ratio of each distinct normalised value, if it is at least ``least``; ties go to the smaller id.

    Every value meets every entry; only pairs whose lengths and common words show that they can't reach ``least`` are not scored.
    Blank values and entries match nothing.  The entries are a fixed list.
    """
    words = lambda c: F.array_distinct(F.split(c, " "))
    size = lambda c: F.length(F.array_join(c, " "))
    a = values.select(F.col(value).alias("value")).where("value <> ''").distinct().repartition(values.sparkSession.sparkContext.defaultParallelism)
    a = a.withColumn("_w", words(F.col("value"))).withColumn("_n", size(F.col("_w")))
    b = entries.select(F.col(entry).alias("_e"), F.col(entry_id).alias("_id")).where("_e <> ''").withColumn("_v", words(F.col("_e"))).withColumn("_m", size(F.col("_v")))
    lower, shorter = least - 0.001, F.least("_n", "_m")  # scores are rounded
    both, common = F.col("_n") + F.col("_m"), size(F.array_intersect("_w", "_v"))
    pairs = a.join(F.broadcast(b), (200.0 * shorter >= lower * both) | (200.0 * common >= lower * (common + shorter)))
    scored = pairs.withColumn("score", F.round(token_set_from(lower)("value", "_e"), 4)).where(F.col("score") >= least)
    best = scored.groupBy("value").agg(F.max(F.struct("score", (-F.col("_id")).alias("n"))).alias("x"))
    return best.select("value", (-F.col("x.n")).alias(entry_id), F.col("x.score").alias("score"))
