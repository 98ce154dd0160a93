"""Mapping typed values to a list."""

import itertools

import pytest

from tessera.llm.canon import _allowed, covers, match_values
from tessera.llm.runs import edits_within

ENTRIES = [
    (1, "Giant cell adenoma of the liver", "GCAL", "Giant cell adenoma"),
    (2, "Ulcerated adenoma of the bile duct", "UABD", "Ulcerated adenoma"),
    (3, "Plexiform gastritis of the bile duct", None, "Plexiform gastritis"),
    (4, "Hemosiderotic edema of the anal canal", "", "Hemosiderotic edema"),
    (5, "GI::Colon::Polyp,_Mixed_Type", None, "Polyp,_Mixed_Type"),
    (6, "GU::Bladder::Serrated_Cyst", None, "Serrated_Cyst"),
    (7, "HN::Larynx::Serrated_Cyst", None, "Serrated_Cyst"),
    (8, None, None, None),
    (None, "x", None, "x"),
]
CASES = {
    "Giant cell adenoma of the liver": 1,
    "GIANT CELL  ADENOMA OF THE LIVER": 1,
    "adenoma, giant cell, liver": 1,
    "Giant cell adoeloma of the liver": 1,
    "g.c.a.l.": 1,
    "uabd ": 2,
    "Ulcerated adenoma (bile duct), NOS": 2,
    "Entity: Plexiform gastritis - bile duct": 3,
    "Haemosiderotic oedema of the anal canal?": 4,
    "gi > colon > polyp mixed type": 5,
    "Larynx::SerratedCyst": 7,
    "Serrated_Cyst::Bladder::GU": 6,
    "Amebic web of the bile duct": -1,
    "GI::Colon::Parasitic_Stricture": -1,
    "XYZ": -1,
    "???": -1,
    "漢字": -1,
}


@pytest.mark.parametrize("most_entries", [100, 3])
def test_match_values(spark, most_entries):
    values = spark.createDataFrame([(v,) for v in [*CASES, *CASES, None, "", "  ", "\t"]], "value string")
    entries = spark.createDataFrame(ENTRIES, "id int, name string, alias string, core string")
    got = {r["value"]: r["canon_id"] for r in match_values(values, entries, most_entries=most_entries).collect()}
    assert got == CASES


@pytest.mark.parametrize("empty", ["values", "entries"])
def test_empty_tables(spark, empty):
    values = spark.createDataFrame([("a",)], "value string")
    entries = spark.createDataFrame(ENTRIES, "id int, name string, alias string, core string")
    if empty == "values":
        assert match_values(values.limit(0), entries).count() == 0
    else:
        assert [tuple(r) for r in match_values(values, entries.limit(0)).collect()] == [("a", -1, None)]


def test_covers():
    assert covers(["serrated", "cyst"], ["larynx", "serated", "cyst"])
    assert not covers(["serrated", "cyst"], ["serrated", "polyp"])
    assert not covers(["cell", "cell"], ["cell"])
    assert covers([], ["x"])


def test_covers_finds_a_matching_wherever_there_is_one():
    assert covers(["cystic", "cyst"], ["endo", "parathyroid", "cyst", "cusic"])
    pool = ["cyst", "cysts", "cystic", "cusic", "cell", "cells", "bell"]
    for core in itertools.product(pool, repeat=2):
        for words in itertools.product(pool, repeat=3):
            want = any(all(edits_within(c, w, _allowed(c)) is not None for c, w in zip(core, some, strict=True)) for some in itertools.permutations(words, 2))
            assert covers(core, words) == want


@pytest.mark.parametrize("most_entries", [100, 0])
def test_words_run_together_are_decided_by_similarity(spark, most_entries):
    entries = spark.createDataFrame([(1, "Heme::Node::T/NK_Cell_Proliferation", None, "T/NK_Cell_Proliferation"), (2, "Heme::Node::Ulcerated_Atypia", None, "Ulcerated_Atypia")], "id int, name string, alias string, core string")
    values = spark.createDataFrame([("Heme::Node::T/NKCellProliferation",), ("Heme::Node::Radiated_Tophus",)], "value string")
    got = {r["value"]: r["canon_id"] for r in match_values(values, entries, most_entries=most_entries).collect()}
    assert got == {"Heme::Node::T/NKCellProliferation": 1, "Heme::Node::Radiated_Tophus": -1}
    unsure = match_values(values, entries, sure=1.1, most_entries=most_entries).collect()
    assert {r["canon_id"] for r in unsure} == {-1}
