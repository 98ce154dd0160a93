"""Postings against reading the texts, and the tiers of a search."""

import random

from tessera.operators import lexical


def corpus(spark):
    r = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "the", "x1"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 12))).upper() if i % 7 else None) for i in range(200)]
    return spark.createDataFrame([*rows, (900, ""), (901, "Alphabet soup")], "id int, t string")


def test_postings_score_as_the_texts_do(spark, tmp_path):
    docs = corpus(spark)
    index = lexical.Postings.build(docs, "id", "t", str(tmp_path / "i"), buckets=5, stop=["the"])
    assert (index.documents, index.buckets) == (202, 5)
    for terms in (["alpha"], ["alpha", "delta", "absent"], ["absent"]):
        assert sorted(map(tuple, index.bm25(terms).collect())) == sorted(map(tuple, lexical.bm25(docs, "id", "t", terms).collect()))
    again = lexical.Postings(spark, str(tmp_path / "i"), "id")
    assert (again.documents, again.words) == (index.documents, index.words)
    assert index.of(["the"]).count() == 0


def test_a_search_reads_its_terms_only(spark, tmp_path):
    index = lexical.Postings.build(corpus(spark), "id", "t", str(tmp_path / "i"), buckets=5)
    plan = index.of(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,alpha)" in plan


def test_the_strictest_tier_with_hits_answers(spark, tmp_path):
    docs = corpus(spark)
    index = lexical.Postings.build(docs, "id", "t", str(tmp_path / "i"))
    both = index.search(docs, "t", ["alpha", "beta"], 300).collect()
    assert {r["tier"] for r in both} == {1} and [r["rank"] for r in sorted(both, key=lambda r: r["rank"])] == list(range(1, len(both) + 1))
    some = index.search(docs, "t", ["alpha", "soup", "beta"], 5).collect()
    assert {r["tier"] for r in some} == {2} and len(some) == 5
    last = index.search(docs, "t", ["phabe"], 5).collect()
    assert [(r["id"], r["tier"], r["score"]) for r in last] == [(901, 3, 9999.0)]
    assert index.search(docs, "t", [], 5).count() == 0 and index.search(docs, "t", ["zzz"], 5).count() == 0


def test_an_empty_corpus(spark, tmp_path):
    docs = corpus(spark).limit(0)
    index = lexical.Postings.build(docs, "id", "t", str(tmp_path / "i"))
    assert index.documents == 0 and index.bm25(["alpha"]).count() == 0 and index.search(docs, "t", ["alpha"], 3).count() == 0
