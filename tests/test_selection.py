"""Samples, lookups, low-information verdicts, vectors in batches, outlines."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import quality as Q
from tessera.operators import sampling
from tessera.operators.joins import range_lookup
from tessera.operators.sequence import outline
from tessera.operators.vector import closest_entries, nearest_many


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quota_sample_gives_every_group_its_share_and_fills_up(spark):
    df = spark.createDataFrame([(i, "big" if i < 90 else "small", i) for i in range(93)], "id int, g string, score int")
    got = sampling.quota_sample(df, "g", "id", 20, 1, [F.desc("score")]).collect()
    assert len(got) == len({r["id"] for r in got}) == 20
    assert {90, 91, 92} <= {r["id"] for r in got} and {80, 85, 89} <= {r["id"] for r in got}
    assert rows(sampling.quota_sample(df, "g", "id", 20, 1)) == rows(sampling.quota_sample(df.repartition(5), "g", "id", 20, 1))
    assert sampling.quota_sample(df.limit(0), "g", "id", 20).count() == 0 and sampling.quota_sample(df, "g", "id", 500).count() == 93


def test_required_strata_come_first_and_none_twice(spark):
    df = spark.createDataFrame([(i, i % 10 == 0, i == 30) for i in range(50)], "id int, a boolean, b boolean")
    got = {r["id"]: r["stratum"] for r in sampling.required_first(df, [F.col("b"), F.col("a"), F.lit(False)], "id", 10, 2).collect()}
    assert len(got) == 10 and got[30] == 1 and sorted(got.values()) == [0] * 8 + [1, 2]


def test_range_lookup_against_all_pairs(spark):
    r = random.Random(1)
    values = [(i, r.randint(-20, 120)) for i in range(200)] + [(900, None)]
    ranges = [(r.randint(-20, 100), r.randint(0, 120), f"r{i}") for i in range(20)]
    want = sorted((i, n) for i, v in values for lo, hi, n in ranges if v is not None and lo <= v <= hi)
    got = range_lookup(spark.createDataFrame(values, "id int, v int"), "v", spark.createDataFrame(ranges, "lo int, hi int, name string"), "lo", "hi", 7)
    assert rows(got.select("id", "name")) == sorted(want, key=repr)


@pytest.mark.parametrize(
    ("text", "signal", "context", "hard", "verdict"),
    [
        ("okay.", False, False, "noise", "noise"),
        ("Any questions about this", False, True, "noise", "noise"),
        ("two words", False, False, "too short", "too short"),
        (None, False, False, "too short", "too short"),
        ("okay so well yeah right the gland here", False, False, "filler", "filler"),
        ("a short pause and then the gland goes on", False, False, "housekeeping", "housekeeping"),
        ("see figure with the gland", False, False, "caption", "caption"),
        ("the gland is seen here", False, False, None, "too short without signal"),
        ("the gland is seen here", False, True, None, "short, kept for its context"),
        ("the gland lies here", False, True, None, "too short without signal"),
        ("the gland is seen here and there and in other places too", False, False, None, "very short without signal"),
        ("okay", True, False, None, "short, kept for its words"),
        ("gland " * 50, False, False, None, "kept"),
        ("gland " * 20, False, False, None, "kept"),
    ],
)
def test_verdicts(spark, text, signal, context, hard, verdict):
    df = spark.createDataFrame([(text, signal, context)], "t string, s boolean, c boolean")
    got = df.select(Q.hard_reason(F.col("t"), F.col("s"), F.lit(True)), Q.verdict(F.col("t"), F.col("s"), F.col("c"), F.lit(True))).first()
    assert tuple(got) == (hard, verdict)


def test_contents_lists(spark):
    cases = [("Today's agenda: glands", True), ("starting off with a cyst, b cyst, c cyst", True), ("starting off with a cyst and b cyst", False), (" ".join(f"x{i} cyst," for i in range(9)), True), (None, False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    names = F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(r"\w+ cyst"), F.lit(0))
    assert [r[1] for r in df.select("i", Q.lists_contents(F.col("t"), names)).orderBy("i").collect()] == [w for _, w in cases]


@pytest.mark.parametrize("block", [2, 2048])
def test_vectors_in_batches_against_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (70, 4)).astype(float)  # many ties
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)]
    df = spark.createDataFrame(data, "id int, v array<double>").repartition(4)
    got = nearest_many(df, "id", "v", df.where("id % 20 = 0"), 5, block)
    want = []
    for q in range(0, 70, 20):
        best = sorted(range(70), key=lambda i: (-round(float(v[i] @ v[q]), 6), i))[:5]
        want += [(q, i, round(float(v[i] @ v[q]), 6), n + 1) for n, i in enumerate(best)]
    assert rows(got) == sorted(want, key=repr)
    assert nearest_many(df, "id", "v", df.limit(0), 5).count() == 0 and nearest_many(df.limit(0), "id", "v", df.where("id = 0"), 5).count() == 0


def test_outline_resets_inner_headings_and_joins_wrapped_lines(spark):
    lines = ["stray", "1. One", "- a", "  more", "", "A) Alpha", "- b", "* x", "- c", "B) Beta", "note", "- d", "2. Two", "- e"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc string, n int, t string")
    got = outline(df, "doc", ["n"], "t", [("major", r"^[0-9]+\. (.*)$"), ("organ", r"^[A-Z]\) (.*)$"), ("section", r"^\* (.*)$")], r"^- (.*)$")
    assert [tuple(r)[1:] for r in got.orderBy("major", "number").collect()] == [
        ("One", None, None, "a more", 1),
        ("One", "Alpha", None, "b", 2),
        ("One", "Alpha", "x", "c", 3),
        ("One", "Beta", None, "d", 4),
        ("Two", None, None, "e", 1),
    ]


@pytest.mark.parametrize("block", [3, 2048])
def test_closest_entries_against_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    v, e = (rng.integers(-3, 4, (n, 3)).astype(float) for n in (25, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id int, v array<double>")
    entries = spark.createDataFrame([(f"e{i}", x.tolist()) for i, x in enumerate(e)], "name string, v array<double>")
    want = []
    for i, x in enumerate(v):
        best = sorted(range(8), key=lambda j: (-round(float(e[j] @ x), 6), f"e{j}"))[:2]
        want += [(i, f"e{j}", round(float(e[j] @ x), 6), n + 1) for n, j in enumerate(best)]
    assert rows(closest_entries(df, "id", "v", entries, "name", 2, block)) == sorted(want, key=repr)
    assert closest_entries(df, "id", "v", entries.limit(0), "name", 2).count() == 0
