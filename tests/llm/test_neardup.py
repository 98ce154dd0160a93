"""Near-duplicates against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.neardup import NearDuplicates, least_matches, triples, word_text


def plain_pairs(rows, threshold=0.7, least=20):
    import re

    sets = {}
    for tbl, key, text in rows:
        words = re.findall("[a-z0-9]+", (text or "").lower())
        if len(words) >= least:
            sets[tbl, key] = set(zip(words, words[1:], words[2:]))
    keys = sorted(sets)
    return sorted((a[0], a[1], b[1]) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9)


def families(seed, n=14, size=5):
    r = random.Random(seed)
    rows = []
    for f in range(n):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.randint(25, 90))]
        for m in range(size):
            w = list(words)
            for _ in range(r.randint(0, 6)):
                i = r.randrange(len(w))
                r.choice([lambda: w.__setitem__(i, f"x{r.randint(0, 99)}"), lambda: w.insert(i, "new"), lambda: w.pop(i)])()
            text = " ".join(w)
            rows.append(("a" if f % 3 else "b", f"k{f:02}_{m}", text.upper() if m % 2 else text.replace(" ", ",  ")))
    return rows


EDGES = [("a", "null", None), ("a", "empty", ""), ("a", "short", "one two three"), ("a", "c1", "same " * 30), ("a", "c2", "Same, " * 30), ("b", "c3", "same " * 30)]


@pytest.mark.parametrize("most", [64, 2])
def test_against_brute_force(spark, most):
    rows = families(most) + EDGES
    found = NearDuplicates(spark.createDataFrame(rows, "tbl string, key string, text string"), most=most).pairs()
    assert sorted(map(tuple, found.collect())) == plain_pairs(rows)


def test_hot_copies_are_one_class_and_groups_are_whole(spark):
    rows = families(9, n=4) + [("a", f"copy{i:03}", "quick brown fox " * 9) for i in range(120)]
    near = NearDuplicates(spark.createDataFrame(rows, "tbl string, key string, text string"), most=4)
    groups = near.groups().collect()
    copies = [g for g in groups if g["key"].startswith("copy")]
    assert len(copies) == 120 and {g["group_id"] for g in copies} == {"copy000"} and {g["n_links"] for g in copies} == {0}
    linked = {}
    for _, a, b in plain_pairs(rows):
        linked.setdefault(a, set()).add(b)
    where = {g["key"]: g["group_id"] for g in groups}
    assert all(where[a] == where[b] for a in linked for b in linked[a])


def test_empty_table(spark):
    near = NearDuplicates(spark.createDataFrame([], "tbl string, key string, text string"))
    assert near.pairs().count() == 0 and near.groups().count() == 0


def test_limits_miss_hardly_anything():
    for n, least in least_matches(0.7, 1e-5, 32, 200):
        assert 0 <= least <= 0.7 * n
    assert least_matches(0.7, 1e-5, 32, 200)[-1][0] == 200


def test_word_text(spark):
    df = spark.createDataFrame([("Ab-12 é C",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(word_text(F.col("t"))).collect()] == ["ab 12 c", "", None]
    assert triples("a b") == set()


def test_components_of_chains_hubs_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200, 202: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_classes_sharing_a_number_are_told_apart(spark, monkeypatch):
    from tessera.llm import neardup

    rows = families(3, n=5) + EDGES
    monkeypatch.setattr(neardup, "class_id", lambda *c: F.pmod(F.xxhash64(*c), F.lit(4)))
    found = NearDuplicates(spark.createDataFrame(rows, "tbl string, key string, text string")).pairs()
    assert sorted(map(tuple, found.collect())) == plain_pairs(rows)


def test_signature_bytes_and_limits_keep_likely_pairs():
    import numpy as np
    import pyarrow as pa

    from tessera.llm.neardup import _Signer

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:55]), "one two", None, "", "a b c", " ".join(words * 400)]
    rows = _Signer(112)(pa.array(texts))
    alone = [_Signer(112)(pa.array([t], pa.string())) for t in texts]
    assert all((r == a[0]).all() for r, a in zip(rows, alone))
    assert (_Signer(112)(pa.array(texts), strip=7) == rows).all()
    same = (rows[0].astype(np.uint8) == rows[1].astype(np.uint8)).sum()
    limits = least_matches(0.7, 1e-5, 28, 112)
    assert [n for n, _ in limits] == [28, 56, 84, 112] and same >= limits[-1][1]
