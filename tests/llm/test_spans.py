"""Verbatim spans against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.grams import codes_of, gram_hashes, sliding_min
from tessera.llm.spans import Block, SharedSpans


def plain(docs, least):
    grams = {d: {t[i : i + least] for i in range(len(t) - least + 1)} for d, t in docs.items() if t}
    pairs = sorted((a, b) for a in grams for b in grams if a < b and grams[a] & grams[b])
    covered = {}
    for d, t in docs.items():
        others = set().union(*(g for o, g in grams.items() if o != d)) if len(grams) > 1 else set()
        spots = {i + k for i in range(len(t or "") - least + 1) if t[i : i + least] in others for k in range(least)}
        covered[d] = len(spots)
    return pairs, covered


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=60), st.lists(st.text("ab", max_size=40), min_size=1, max_size=4), st.integers(2, 9))
def test_parse_finds_every_shared_stretch_of_a_block(text, references, least):
    block = Block(list(enumerate(references)), least)
    factors, spans = block.parse(99, text)
    assert all(references[k][x : x + n] == text[y : y + n] and n >= least for k, x, y, n in spans)
    for k, reference in enumerate(references):
        spots = {p for d, _, y, n in spans if d == k for p in range(y, y + n)}
        assert spots == {i + p for i in range(len(text) - least + 1) if text[i : i + least] in reference for p in range(least)}
        spots = {p for d, x, _, n in spans if d == k for p in range(x, x + n)}
        assert spots == {i + p for i in range(len(reference) - least + 1) if reference[i : i + least] in text for p in range(least)}
    q = max(1, least // 2)
    for at, n in factors:  # each factor is the longest match from its place
        assert any(text[at : at + n] in r for r in references) and n >= q
        assert at + n == len(text) or not any(text[at : at + n + 1] in r for r in references)
    assert Block(list(enumerate(references)), least).parse(0, text) == ([], [])


def test_parse_of_periodic_texts_ends():
    assert len(Block([(1, "-" * 3000)], 200).parse(2, "-" * 3000)[1]) == 2 * 2800 + 1


def test_gram_hashes_and_sliding_min():
    codes = codes_of("abcabcabc漢abc")
    h = gram_hashes(codes, 3)
    assert h[0] == h[3] == h[6] == h[10] and len(set(h.tolist())) == 6
    v = np.random.default_rng(1).integers(0, 50, 40).astype(np.uint64)
    assert sliding_min(v, 7).tolist() == [v[i : i + 7].min() for i in range(34)]
    assert len(sliding_min(v, 41)) == 0 and len(gram_hashes(codes, 99)) == 0


def corpus(seed, n=60, least=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij é") for _ in range(r.randint(3, 60)))
    footer = "".join(r.choice("klmnop") for _ in range(least - 8))  # recurs, too short to count
    quote = "".join(r.choice("qrstuv") for _ in range(least + 15))
    docs = {}
    for d in range(n):
        parts = [word() for _ in range(r.randint(0, 6))]
        if r.random() < 0.8:
            parts.append(footer)
        if r.random() < 0.3:
            parts.append(quote[r.randint(0, 10) : len(quote) - r.randint(0, 12)])
        if docs and r.random() < 0.3:
            source = docs[r.choice(list(docs))]
            a = r.randint(0, max(0, len(source) - 10))
            parts.append(source[a : a + r.randint(20, 120)])
        r.shuffle(parts)
        docs[d] = "".join(parts)
    return docs | {900: "", 901: None, 902: "z" * 300, 903: "z" * 120}


@pytest.mark.parametrize(("seed", "most"), [(1, 32), (2, 2), (3, 5)])
def test_against_brute_force_with_and_without_hot_marks(spark, seed, most):
    docs = corpus(seed)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    shared = SharedSpans(df, "doc_id", "text", least=40, most=most)
    pairs, covered = plain(docs, 40)
    assert sorted(map(tuple, shared.pairs().collect())) == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in shared.coverage(df, "doc_id", "text").collect()} == covered
    for r in shared.spans.collect():
        a, b = docs[r["doc_a"]], docs[r["doc_b"]]
        assert r["length"] >= 40 and a[r["start_a"] :][: r["length"]] == b[r["start_b"] :][: r["length"]]


def test_copies_and_empty_tables(spark):
    df = spark.createDataFrame([(i, "abcdefghij" * 30) for i in range(20)] + [(None, "abcdefghij" * 30)], "doc_id bigint, text string")
    assert SharedSpans(df, "doc_id", "text", most=3).pairs().count() == 190
    none = SharedSpans(df.limit(0), "doc_id", "text")
    assert none.pairs().count() == 0 and none.coverage(df.limit(0), "doc_id", "text").count() == 0


def test_repeated_ids_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "q" * 300, 7), (1, "q" * 300, 8), (2, "q" * 250, 9)], "doc bigint, text string, doc_id int")
    assert sorted(map(tuple, SharedSpans(df, "doc", "text").pairs().collect())) == [(1, 2)]


def test_stretches_sharing_a_hash_are_told_apart(spark, monkeypatch):
    from tessera.llm import spans

    docs = corpus(2)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    monkeypatch.setattr(spans, "stretch_hashes", lambda codes, least: gram_hashes(codes, least).view(np.int64) % 997)
    shared = SharedSpans(df, "doc_id", "text", least=40, most=2)
    pairs, covered = plain(docs, 40)
    assert sorted(map(tuple, shared.pairs().collect())) == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in shared.coverage(df, "doc_id", "text").collect()} == covered


def test_small_blocks_give_the_same(spark):
    docs = corpus(5)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    pairs, covered = plain(docs, 40)
    shared = SharedSpans(df, "doc_id", "text", least=40, block_docs=2, block_visits=3)
    assert sorted(map(tuple, shared.pairs().collect())) == pairs
    spans = shared.spans.collect()
    assert len(spans) == len(set(map(tuple, spans)))
    assert {r["doc_id"]: r["shared_chars"] for r in shared.coverage(df, "doc_id", "text").collect()} == covered
