"""Runs of consecutive events against a plain pass."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.runs import agglomerate, collapse_runs, edits_within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=7), st.text("ab", max_size=7), st.integers(0, 3))
def test_edits_within(a, b, most):
    d = distance(a, b)
    assert edits_within(a, b, most) == (d if d <= most else None)


def plain_runs(rows, gap=20.0):
    import re

    key = lambda t: re.sub("[^a-z0-9]", "", (t or "").lower())
    out = []
    for e in sorted({r[0] for r in rows}, key=str):
        last = None
        for _, item, s, t, tag in sorted((r for r in rows if r[0] == e), key=lambda r: (r[2], r[1])):
            k = key(tag)
            if last and k and last[1] and s - last[0] <= gap + 1e-6 and distance(k, last[1]) <= 1:
                out[-1][2], out[-1][3] = item, out[-1][3] + 1
            else:
                out.append([e, item, item, 1])
            last = (s if t is None else t, k)
    return sorted((tuple(x) for x in out), key=repr)


def data(seed, n):
    r = random.Random(seed)
    rows, at = [], 0.0
    for i in range(n):
        at += r.choice([0.5, 3, 19.9, 25, 90])
        rows.append((r.choice(["hot", "hot", "b", None]), f"s{i:05}", at, r.choice([None, at + 2, at + 7, at - 1]), r.choice(["GI::Polyp", "gi polyp", "GI::Polip", "GI::Polypp", "HN::Cyst", "", None, "--"])))
    return rows


SCHEMA = "entity string, tag_id string, s double, t double, tag string"


@pytest.mark.parametrize("stretch", [7200.0, 60.0, 7.0])
def test_against_plain_pass_whatever_the_stretches(spark, stretch):
    rows = data(int(stretch), 900)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = collapse_runs(df, "entity", "tag_id", "s", "t", "tag", stretch=stretch)
    assert sorted((tuple(r) for r in got.select("entity", "first_item", "last_item", "n_items").collect()), key=repr) == plain_runs(rows)


def test_small_batches_cut_runs_nowhere(spark):
    rows = [("p", f"s{i:03}", i * 5.0, i * 5.0 + 4, "Tag") for i in range(100)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = collapse_runs(spark.createDataFrame(rows, SCHEMA), "entity", "tag_id", "s", "t", "tag", stretch=40.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r["first_item"], r["last_item"], r["n_items"], r["duration_sec"], r["tag"]) for r in got] == [("s000", "s099", 100, 499.0, "Tag")]


def test_null_start_is_a_run_of_its_own_and_empty_tables_pass(spark):
    df = spark.createDataFrame([("p", "a", None, 3.0, "x"), ("p", "b", 1.0, None, "x")], SCHEMA)
    got = {(r["first_item"], r["n_items"], r["duration_sec"]) for r in collapse_runs(df, "entity", "tag_id", "s", "t", "tag").collect()}
    assert got == {("a", 1, None), ("b", 1, 0.0)}
    assert collapse_runs(df.limit(0), "entity", "tag_id", "s", "t", "tag").count() == 0


def test_clashing_column_names(spark):
    df = spark.createDataFrame([("p", "a", 1.0, 2.0, "x", 9)], "key string, entity string, place double, start double, run string, `end` int")
    assert collapse_runs(df, "key", "entity", "place", "start", "run").first()["n_items"] == 1


def plain_typical(keys, starts, ends, gap, edits):
    """Merge the best link first, every similarity worked out anew; as first places."""
    runs = [[i] for i in range(len(keys))]

    def usual(run):
        return min({keys[i] for i in run}, key=lambda t: (-sum(keys[i] == t for i in run), next(i for i in run if keys[i] == t)))

    while True:
        best = None
        for k in range(len(runs) - 1):
            a, b, x, y = usual(runs[k]), usual(runs[k + 1]), runs[k][-1], runs[k + 1][0]
            if a and b and starts[y] - ends[x] <= gap + 1e-6 and (d := distance(a, b)) <= edits:
                best = min(best or (9, 9, 9, 9), (-1 + d / max(len(a), len(b)), starts[y] - ends[x], x, k))
        if best is None:
            return [r[0] for r in runs]
        k = best[3]
        runs[k : k + 2] = [runs[k] + runs[k + 1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["aaaa", "aaab", "aabb", "abbb", "bbbb", ""]), st.integers(1, 30)), min_size=1, max_size=14))
def test_typical_linkage_against_merging_one_by_one(events):
    starts = np.cumsum([g for _, g in events]).astype(float)
    keys = [k for k, _ in events]
    assert agglomerate(keys, starts, starts.copy(), 20.0, 1, "typical").tolist() == plain_typical(keys, starts, starts, 20.0, 1)


def test_the_order_of_merges_matters_under_typical_linkage(spark):
    rows = [("p", f"s{i}", float(at), None, t) for i, (at, t) in enumerate([(0, "aaaa"), (5, "aaab"), (6, "aaab"), (11, "aabb"), (16, "aabb"), (30, "abbb")])]
    df = spark.createDataFrame(rows, SCHEMA)
    touching = {(r["first_item"], r["last_item"]) for r in collapse_runs(df, "entity", "tag_id", "s", "t", "tag").collect()}
    typical = {(r["first_item"], r["last_item"]) for r in collapse_runs(df, "entity", "tag_id", "s", "t", "tag", linkage="typical").collect()}
    assert touching == {("s0", "s5")} and typical != touching
    got = agglomerate([r[4] for r in rows], np.array([r[2] for r in rows]), np.array([r[2] for r in rows]), 20.0, 1, "typical").tolist()
    assert sorted(int(a[1:]) for a, _ in typical) == got == plain_typical([r[4] for r in rows], [r[2] for r in rows], [r[2] for r in rows], 20.0, 1)


def test_typical_linkage_whatever_the_batches(spark):
    rows = [r for r in data(4, 500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    whole = sorted(map(repr, collapse_runs(df, "entity", "tag_id", "s", "t", "tag", linkage="typical").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(repr, collapse_runs(df, "entity", "tag_id", "s", "t", "tag", linkage="typical").collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r["n_items"] for r in collapse_runs(df, "entity", "tag_id", "s", "t", "tag", linkage="typical").collect()) == len(rows)
