"""Small cases of the core operators: nulls, ties, empty tables, clashing names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import cards, joins, lexical, sampling, sequence
from tessera.operators.current import current_rows
from tessera.operators.fuzzy import blocked_best
from tessera.operators.multivalue import delimiter_profile, split_values


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in values.items()))
    return df.select(expression.alias("x")).first()["x"]


def test_current_rows_latest_wins_and_null_keys_stay(spark):
    at = lambda d: dt.datetime(2025, 1, d)
    df = spark.createDataFrame([("a", 1, at(1)), ("a", 2, at(3)), ("a", 2, at(3)), ("b", None, at(1)), (None, 5, at(1)), (None, 6, at(1)), (None, 6, at(1)), ("c", 9, None)], "key string, v int, ingested_at timestamp")
    assert rows(current_rows(df, "key", ["v"])) == sorted([("a", 2), ("b", None), (None, 5), (None, 6), ("c", 9)], key=repr)
    assert rows(current_rows(df.limit(0), "key", ["v"])) == []


def test_current_rows_with_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, dt.datetime(2025, 1, 1), "x"), ("a", 2, dt.datetime(2025, 1, 2), "y")], "key string, `_key` int, ingested_at timestamp, `a.b` string")
    assert rows(current_rows(df, "key", ["_key", "a.b"])) == [("a", 2, "y")]


@pytest.mark.parametrize(
    ("value", "want"),
    [("Ab-Cd  é!", "ab cd"), ("", ""), (None, None), ("--", "")],
)
def test_normalize(spark, value, want):
    assert one(spark, T.normalize(F.col("v")), v=value) == want


def test_plain_number_keeps_null(spark):
    df = spark.createDataFrame([(12.5,), (12.0,), (0.0,), (None,)], "v double")
    assert [r[0] for r in df.select(T.plain_number(F.col("v"))).collect()] == ["12.5", "12", "0", None]
    linked = spark.createDataFrame([("u", 1.0, None), (None, 1.0, 2.0)], "u string, a double, b double").select(T.time_link(F.col("u"), F.col("a"), F.col("b")))
    assert [r[0] for r in linked.collect()] == ["u#t=1", None]


def test_loose_int_and_json_list(spark):
    df = spark.createDataFrame([("12",), ("12.0",), ("",), (None,), ("x",)], "v string")
    assert [r[0] for r in df.select(T.loose_int(F.col("v"))).collect()] == [12, 12, None, None, None]
    df = spark.createDataFrame([('["a","b"]',), ("[]",), ("nope",), (None,)], "v string")
    assert [r[0] for r in df.select(T.json_list(F.col("v"))).collect()] == [["a", "b"], [], [], []]


def test_excerpt_follows_query_order(spark):
    text = "x" * 50 + " beta " + "y" * 50 + " alpha " + "z" * 50
    assert "alpha" in one(spark, T.excerpt(F.col("v"), ["alpha", "beta"], 30), v=text)
    assert one(spark, T.excerpt(F.col("v"), ["alpha"], 30), v="short") == "short"
    assert one(spark, T.excerpt(F.col("v"), ["alpha"], 30), v=None) is None


def test_fallback_join_prefers_the_first_chain_and_never_multiplies(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "a", "q"), (3, "z", None), (4, None, None)], "id int, s string, r string")
    right = spark.createDataFrame([("a", "x", "u1"), ("a", "x", "u2"), ("a", "y", "u0"), (None, None, "bad")], "s string, r string, url string")
    out = joins.fallback_join(left, right, [[("s", "s"), ("r", "r")], [("s", "s")]], ["url"], [F.col("url")])
    assert rows(out.select("id", "url", "matched_by")) == [(1, "u1", 1), (2, "u0", 2), (3, None, None), (4, None, None)]


def test_merge_sides(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, None), (1, None)], "k int, v string")
    assert rows(joins.merge_sides(a, b, "k", ["v"])) == [(1, "x", True, True), (2, "y", True, True), (3, None, False, True)]


def test_inherit_last_respects_limits(spark):
    df = spark.createDataFrame([("p", 1, 0.0, "t"), ("p", 2, 10.0, None), ("p", 3, 900.0, None), ("q", 1, 0.0, None)], "s string, n int, p double, v string")
    out = joins.inherit_last(df, "s", ["n"], "p", "v", 12, 600)
    assert rows(out.select("s", "n", "inherited", "inherited_from")) == [("p", 1, "t", "own"), ("p", 2, "t", "before"), ("p", 3, None, None), ("q", 1, None, None)]


def cards_of(spark, groups):
    return spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "pos int, g string")


@pytest.mark.parametrize(
    ("groups", "cap", "floor", "want"),
    [
        ("ttt v j".replace(" ", ""), 3, 0, ["t", "v", "j"]),
        ("p" * 100 + "vv", 10, 3, ["p"] * 3 + ["v"] * 2 + ["p"] * 5),
        ("a" * 20 + "b" * 20 + "c" * 20 + "d" * 20, 5, 6, ["a"] * 5),
        ("ab", 5, 1, ["a", "b"]),
    ],
)
def test_capped_with_floor(spark, groups, cap, floor, want):
    out = cards.capped_with_floor(cards_of(spark, groups), "g", ["pos"], cap, floor)
    assert [r["g"] for r in out.orderBy("position").collect()] == want


def test_interleave(spark):
    out = cards.interleave(cards_of(spark, "aaab"), "g", ["pos"], 10)
    assert [r["g"] for r in out.orderBy("position").collect()] == ["a", "b", "a", "a"]
    assert cards.interleave(cards_of(spark, "aaab"), "g", ["pos"], 2).count() == 2


def test_first_seen_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, None)], "pos int, u string")
    assert rows(cards.first_seen(df, F.col("u"), ["pos"])) == [(1, "k"), (3, None), (4, None)]


def test_smoothing_uses_original_neighbours(spark):
    tags = ["a"] * 4 + ["b"] + ["c"] + ["d"] * 4
    df = spark.createDataFrame([("p", i, i * 10.0, i * 10.0 + 9, t) for i, t in enumerate(tags)], "e string, n int, s double, t double, v string")
    out = sequence.smooth_islands(df, "e", ["n"], "v", "s", "t", 2, 1.0).orderBy("n")
    assert [r["smoothed"] for r in out.collect()] == ["a"] * 5 + ["b"] + ["d"] * 4


def test_sticky_expires_and_resets(spark):
    df = spark.createDataFrame([("p", 1, "t", False), ("p", 2, None, False), ("p", 3, None, False), ("p", 4, None, True), ("p", 5, None, False)], "e string, n int, v string, r boolean")
    out = sequence.sticky(df, "e", ["n"], "v", 5, F.col("r")).orderBy("n")
    assert [r["carried"] for r in out.collect()] == ["t", "t", "t", None, None]
    out = sequence.sticky(df, "e", ["n"], "v", 1, F.lit(False)).orderBy("n")
    assert [r["carried"] for r in out.collect()] == ["t", "t", None, None, None]


def merged_plainly(rows, max_gap=20.0, max_span=140.0, max_chars=2600, min_chars=0):
    out, window, last = [], None, None
    for s, e, text in sorted(rows):
        c = len(text or "")
        if window and s - last <= max_gap and e - window[0] <= max_span and window[3] + 1 + c <= max_chars:
            window = (window[0], max(window[1], e), window[2] + 1, window[3] + 1 + c)
        else:
            if window:
                out.append(window)
            window = (s, e, 1, c)
        last = e
    return [w for w in [*out, window] if w and w[3] >= min_chars]


def test_merge_by_budget_against_plain_loop(spark):
    import random

    r = random.Random(3)
    data, at = [], 0.0
    for _ in range(300):
        at += r.choice([1, 5, 30])
        data.append((at, at + r.choice([1, 4]), "w" * r.randint(0, 900)))
    df = spark.createDataFrame([("p", *x) for x in data], "e string, s double, t double, x string")
    got = [tuple(x)[1:] for x in sequence.merge_by_budget(df, "e", "s", "t", "x", min_chars=0).orderBy("window_start").collect()]
    assert got == merged_plainly(data)


def test_split_values_on_every_notation(spark):
    cases = {
        "json": '["A::B::C", "A::B::D,_x"]',
        "list": "['A::B::C', 'A::B::D,_x']",
        "bare": "[A::B::C, A::B::D,_x]",
        "semi": 'A::B::C; "A::B::D,_x";',
        "mixed": "A::B::C\t;A::B::D,_x | ",
        "slash": "A::B::C / A::B::D,_x",
    }
    df = spark.createDataFrame([(k, "s", v) for k, v in cases.items()] * 3 + [("none", "s", None), ("blank", "s", " "), ("empty", "s", "[]"), ("one", None, "A::B::C")], "id string, source string, f string")
    out = split_values(df.distinct(), "id", "source", ["f"])
    want = [(k, "f", i, 2, t) for k in cases for i, t in ((1, "A::B::C"), (2, "A::B::D,_x"))] + [("one", "f", 1, 1, "A::B::C")]
    assert rows(out) == sorted(want, key=repr)
    assert rows(split_values(df.limit(0), "id", "source", ["f"])) == []


def test_split_plain_text_outside_quotes(spark):
    df = spark.createDataFrame([("a", "s", 'red;"blue; green";red'), ("b", "s", "x;y")], "id string, source string, f string")
    got = rows(split_values(df, "id", "source", ["f"]).select("record_id", "pos", "tag"))
    assert got == [("a", 1, "red"), ("a", 2, "blue; green"), ("a", 3, "red"), ("b", 1, "x"), ("b", 2, "y")]


def test_bm25_counts_null_texts_in_the_corpus(spark):
    df = spark.createDataFrame([(1, "granuloma granuloma x"), (2, "granuloma"), (3, None), (4, "")], "id int, t string")
    got = {r["id"]: r["score"] for r in lexical.bm25(df, "id", "t", ["granuloma"]).collect()}
    assert set(got) == {1, 2} and got[2] > 0
    assert lexical.query_terms("The X of a granuloma, Granuloma", T.STOPWORDS) == ["granuloma"]


def test_blocked_best_breaks_ties_by_id(spark):
    v = spark.createDataFrame([("abc def",), ("zzz",)], "v string")
    e = spark.createDataFrame([(2, "abc deg"), (1, "abc deh"), (3, "qqq")], "id int, e string")
    assert rows(blocked_best(v, e, "v", "e", "id", lambda c: F.split(c, " ")[0], 0.5)) == [("abc def", 1, 0.857143)]


def test_per_group_sample_is_stable(spark):
    df = spark.range(200).select("id", (F.col("id") % 3).alias("g"))
    a = rows(sampling.per_group(df, ["g"], "id", 5, 1))
    assert a == rows(sampling.per_group(df.repartition(7), ["g"], "id", 5, 1)) and len(a) == 15


def test_consolidation_absorbs_short_chunks(spark):
    from tessera.operators.scan import consolidate

    data = [("p", 0.0, 60.0, "x" * 10, "a"), ("p", 61.0, 70.0, "y", "b"), ("p", 71.0, 130.0, "z", "a"), ("p", 400.0, None, "w", None), ("q", 5.0, 9.0, None, "a")]
    df = spark.createDataFrame(data, "e string, s double, t double, x string, g string")
    plain = rows(consolidate(df, "e", "s", "t", "x", "g", same=0.0, any_tag=0.0))
    assert [r[1:4] for r in plain if r[0] == "p"] == [(0.0, 60.0, 1), (400.0, 400.0, 1), (61.0, 70.0, 1), (71.0, 130.0, 1)]
    joined = rows(consolidate(df, "e", "s", "t", "x", "g"))
    assert [r[1:4] for r in joined if r[0] == "p"] == [(0.0, 70.0, 2), (400.0, 400.0, 1), (71.0, 130.0, 1)]
    assert [r for r in joined if r[0] == "q"] == [("q", 5.0, 9.0, 1, 0, "a")]
    assert consolidate(df.limit(0), "e", "s", "t", "x", "g").count() == 0


def test_hold_keeps_a_close_choice_and_resets(spark):
    from tessera.operators.scan import sticky_hold

    data = [("p", 1, "r1", [("a", 0.9), ("b", 0.8)], False), ("p", 2, "r2", [("a", 0.60), ("b", 0.62)], False), ("p", 3, "r3", [("a", 0.5), ("b", 0.9)], False), ("p", 4, "r4", [], False), ("p", 5, "r5", [("a", 1.0)], True), ("p", 6, "r6", None, False)]
    df = spark.createDataFrame(data, "e string, n int, id string, scores array<struct<tag string, score double>>, r boolean")
    got = [(r["id"], r["tag"], r["basis"]) for r in sticky_hold(df, "e", ["n"], "id", "scores", "r").orderBy("id").collect()]
    assert got == [("r1", "a", "best"), ("r2", "a", "held"), ("r3", "b", "best"), ("r4", "b", "carried"), ("r5", None, "reset"), ("r6", None, "none")]


def test_profile_decides_which_signs_cut(spark):
    """A sign cuts in the sources where pieces begin behind it, and belongs to the value in others."""
    data = [(f"a{i}", "a", "Red, dark;Blue, light;Sky") for i in range(30)] + [(f"b{i}", "b", "Red;dark,Blue,Sky;pale") for i in range(30)]
    rows_ = [(k, s, ",".join(f"X::{p.strip()}" for p in v.split(","))) if s == "b" else (k, s, ";".join(f"X::{p.replace(' ', '_')}" for p in v.split(";"))) for k, s, v in data]
    df = spark.createDataFrame(rows_, "id string, source string, f string")
    profile = {r["source"]: r for r in delimiter_profile(df.select("source", F.lit("f").alias("field"), F.col("f").alias("value")), lean=0.0).collect()}
    assert (profile["a"]["delimiters"], profile["b"]["delimiters"]) == ([";"], [","])
    got = {r["source"]: r["v"] for r in split_values(df, "id", "source", ["f"], lean=0.0).where("record_id in ('a0', 'b0')").groupBy(F.substring("record_id", 1, 1).alias("source")).agg(F.sort_array(F.collect_list("tag")).alias("v")).collect()}
    assert got == {"a": ["X::Blue,_light", "X::Red,_dark", "X::Sky"], "b": ["X::Blue", "X::Red;dark", "X::Sky;pale"]}


def test_uneven_cuts_lower_the_score(spark):
    even = [("e", "f", "1;2;3")] * 20
    uneven = [("u", "f", "1;2")] * 10 + [("u", "f", ";".join("1" * 12))] * 10
    scores = {r["source"]: r["scores"][";"] for r in delimiter_profile(spark.createDataFrame(even + uneven, "source string, field string, value string")).collect()}
    assert scores["e"] > scores["u"] > 0.5


def test_split_values_joins_many_sources(spark):
    df = spark.createDataFrame([(f"r{i}", f"s{i % 5}" if i % 6 else None, "A::B::C;A::B::D") for i in range(30)], "id string, source string, f string")
    assert rows(split_values(df, "id", "source", ["f"], most_sources=2)) == rows(split_values(df, "id", "source", ["f"]))
