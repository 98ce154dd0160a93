"""Cutting, packing and mixing: round trips and limits."""

import itertools
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.mix import fit_budget, mix_sources
from tessera.llm.pack import fill_report, pack_containers, pack_documents, sum_of_squares
from tessera.llm.split import cut_text, split_oversized
from tessera.llm.tokens import VOCABULARY, TokenCounter, count_tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


@settings(max_examples=200, deadline=None)
@given(st.text("ab .,\n\ŕ", max_size=900), st.sampled_from([(50, 10), (120, 12), (30, 0), (12, 8)]))
def test_pieces_cover_within_limits(text, sizes):
    limit, overlap = sizes
    pieces = cut_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b in pieces)
    assert all(0 <= b - c <= overlap and c > a and d > b for (a, b), (c, d) in itertools.pairwise(pieces))


def test_cuts_fall_on_paragraphs_before_words():
    text = "word " * 110 + "end.\n\n" + "word " * 140
    first = cut_text(text, 1200, 120)[0]
    assert text[: first[1]].endswith("end.\n\n")


def test_split_round_trip(spark):
    r = random.Random(2)
    texts = {"long": "Sätze über 漢字. " * 300, "solid": "x" * 5000, "null": None, "empty": "", "edge": "y" * 1200, "over": "z" * 1201, "lines": "\r\n".join("a" * r.randint(1, 200) for _ in range(60))}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [(None, "q " * 700, 2)], "k string, t string, piece int")
    got = {}
    for row in split_oversized(df, "k", "t", "x").orderBy("record_key", "piece").collect():
        assert len(row["text"]) <= 1200 and row["overlap"] <= 120
        got[row["record_key"]] = got.get(row["record_key"], "") + row["text"][row["overlap"] :]
    assert got == {k: v for k, v in texts.items() if v and len(v) > 1200} | {None: "q " * 700}
    assert split_oversized(df.limit(0), "k", "t", "x").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=60), st.integers(1, 30))
def test_packing_places_everything_within_capacity(sizes, capacity):
    rows = pack_documents(sizes, capacity)
    fill, placed = {}, [0] * len(sizes)
    for i, _, first, n, box in rows:
        fill[box] = fill.get(box, 0) + n
        assert first == placed[i]
        placed[i] += n
    assert placed == sizes and all(f <= capacity for f in fill.values())
    assert {i for i, *_ in rows} == set(range(len(sizes)))
    split = {i for i, piece, *_ in rows if piece}
    assert all(sizes[i] > capacity for i in split)


def plain_squares(sizes, capacity):
    """The rule by trying every choice."""
    fills, where = [], []
    for s in sizes:
        options = []
        for b in [*range(len(fills)), None]:
            new = [*fills, 0] if b is None else list(fills)
            k = len(fills) if b is None else b
            if new[k] + s > capacity:
                continue
            new[k] += s
            gaps = [capacity - f for f in new if 0 < f < capacity]
            options.append((sum(gaps.count(g) ** 2 for g in set(gaps)), -(new[k] - s), new, k))
        _, _, fills, k = min(options, key=lambda o: o[:2])
        where.append(k)
    return fills, where


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=25), st.just(12))
def test_sum_of_squares_rule(sizes, capacity):
    where = sum_of_squares(sizes, capacity)
    fill = {}
    for s, b in zip(sizes, where, strict=True):
        fill[b] = fill.get(b, 0) + s
    assert sorted(fill.values()) == sorted(plain_squares(sizes, capacity)[0])


def test_pack_table(spark):
    r = random.Random(4)
    sizes = [(i, r.choice([0, 3, 90, 333, 1500])) for i in range(400)] + [(400, None), (None, 7)]
    caps = spark.createDataFrame([(1, 512), (2, 100), (3, None), (4, 0)], "capacity_id int, capacity_tokens int")
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint")
    packed = pack_containers(df, caps, shard_docs=60)
    rows = packed.collect()
    assert {x["capacity_id"] for x in rows} == {1, 2}
    for cid, room in ((1, 512), (2, 100)):
        mine = [x for x in rows if x["capacity_id"] == cid]
        fill, total, places = {}, {}, {}
        for x in mine:
            fill[x["container"]] = fill.get(x["container"], 0) + x["tokens"]
            total[x["doc_id"]] = total.get(x["doc_id"], 0) + x["tokens"]
            places.setdefault(x["container"], []).append(x["place"])
        assert max(fill.values()) <= room
        assert total == {d: t or 0 for d, t in sizes}
        assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    report = {x["capacity_id"]: x for x in fill_report(packed, caps).collect()}
    assert report[1]["tokens"] == sum(t or 0 for _, t in sizes) and report[1]["room_left"] == report[1]["containers"] * 512 - report[1]["tokens"]
    assert pack_containers(df.limit(0), caps).count() == 0


def best_sum(lengths, counts, rest):
    reach = {0}
    for n, c in zip(lengths, counts, strict=True):
        reach = {s + n * k for s in reach for k in range(c + 1)}
    return min(abs(s - rest) for s in reach)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 3)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 120), st.integers(1, 3))
def test_budget_is_met_as_nearly_as_can_be(stock, budget, repeats):
    lengths, counts = zip(*stock, strict=True)
    base, more = fit_budget(list(lengths), list(counts), budget, repeats)
    total = sum(n * c for n, c in stock)
    assert all(0 <= m <= c for m, c in zip(more, counts, strict=True)) and base + (max(more) > 0) <= max(repeats, base)
    got = base * total + sum(n * m for n, m in zip(lengths, more, strict=True))
    if total and base < repeats:
        assert abs(got - budget) == best_sum(lengths, counts, budget - base * total)
    elif total:
        assert got == repeats * total <= budget


def test_budget_beyond_the_window():
    r = random.Random(1)
    lengths, counts = list(range(5, 400)), [r.randint(1, 40) for _ in range(395)]
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    for share in (0.1, 0.5, 0.93):
        base, more = fit_budget(lengths, counts, int(total * share), 3, window=2000)
        assert base == 0 and sum(n * m for n, m in zip(lengths, more, strict=True)) == int(total * share)


def test_mix_table(spark):
    r = random.Random(5)
    docs = [(i, "hot" if i % 3 else f"s{i % 5}", r.choice([0, 10, 10, 37, 200])) for i in range(900)] + [(900, None, 50), (901, "untargeted", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("hot", 0.3, 1), ("s0", 0.5, 2), ("s3", 0.01, 4), ("absent", 0.1, 2), ("s1", None, None)], "source string, target_share double, max_repeats int")
    mix, report = mix_sources(df, targets)
    total = sum(t or 0 for *_, t in docs)
    shares = {x["source"]: x for x in report.collect()}
    rows = mix.collect()
    assert len({x["doc_id"] for x in rows}) == len(rows)
    by = {}
    for x in rows:
        by[x["source"]] = by.get(x["source"], 0) + x["tokens"] * x["copies"]
        assert x["copies"] <= shares[x["source"]]["max_repeats"]
    for s, x in shares.items():
        assert x["mixed_tokens"] == by.get(s, 0) and abs(x["actual_share"] - by.get(s, 0) / total) < 1e-6
    assert abs(by["hot"] - round(0.3 * total)) <= 2 and abs(by["s3"] - round(0.01 * total)) <= 5
    assert by["s0"] == 2 * shares["s0"]["available_tokens"] and shares["absent"]["mixed_tokens"] == 0 and shares["s1"]["mixed_tokens"] == 0 and shares[None]["mixed_tokens"] == 0
    again = {x["doc_id"]: x["copies"] for x in mix_sources(df.repartition(9), targets)[0].collect()}
    assert again == {x["doc_id"]: x["copies"] for x in rows}
    empty, report = mix_sources(df.limit(0), targets)
    assert empty.count() == 0 and {x["mixed_tokens"] for x in report.collect()} == {0}


@needs_vocabulary
def test_token_counts_are_exact():
    with open(VOCABULARY, "rb") as f:
        count = TokenCounter(f.read())
    r = random.Random(0)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "b", "'s", "12", "é", ".", "\x1c", " ", "漢", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert count(text) == len(count.encode(text)), repr(text)
    assert count(None) == count("") == 0


@needs_vocabulary
def test_count_tokens_table(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (None, "", "z")], "doc_id bigint, text string, tokens string")
    assert sorted(map(tuple, count_tokens(df, "text", {"doc_id": "bigint"}).collect()), key=repr) == sorted([(1, 2), (2, 0), (None, 0)], key=repr)
    assert count_tokens(df.limit(0), "text", {"doc_id": "bigint"}).agg(F.count("*")).first()[0] == 0
