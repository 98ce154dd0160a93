"""Fuzzy joins against brute force over all pairs."""

import re

from pyspark.sql import functions as F

from tessera.functions.similarity import token_set
from tessera.operators.fuzzy import GENERIC, blocked_best, conservative_best, token_set_best

ENTRIES = [
    (1, "plexiform neoplasm of the esophagus"),
    (2, "sclerosing edema of the stomach"),
    (3, "clear cell carcinoma"),
    (4, "plexiform esophagus"),
    (5, "esophagus plexiform"),
    (6, "fibroma"),
    (7, "carcinoma of the fibroma"),
    (8, ""),
    (9, None),
]


def conservative(value, entries):
    def distinctive(text):
        return {w for w in text.split(" ") if len(w) > 2} - set(GENERIC)

    best, score, mine = None, 0.0, distinctive(value)
    for ident, entry in entries:
        if not entry:
            continue
        if entry == value:
            return ident, 1.0
        if value in entry or entry in value:
            s = min(len(value), len(entry)) / max(len(value), len(entry)) if mine else 0.0
        else:
            theirs = distinctive(entry)
            s = len(mine & theirs) / max(len(theirs), len(mine), 1)
        if s > score:
            best, score = ident, s
    return (best, round(score, 6)) if score >= 0.5 else None


def test_conservative_match_takes_shared_words(spark):
    values = ["neoplasm plexiform esophagus", "stomach sclerosing edema", "esophagus plexiform", "clear cell", "clear cell carcinoma", "fibroma x", "carcinoma of the liver", "fibro", "edema", "", None]
    df = spark.createDataFrame([(v,) for v in [*values, *values]], "v string")
    got = {r["value"]: (r["id"], r["score"]) for r in conservative_best(df, spark.createDataFrame(ENTRIES, "id int, e string"), "v", "e", "id").collect()}
    assert got == {v: m for v in values if v and (m := conservative(v, ENTRIES))}
    assert got["neoplasm plexiform esophagus"] == (5, 1.0) and got["stomach sclerosing edema"] == (2, 0.75) and got["esophagus plexiform"] == (5, 1.0)
    assert "clear cell" not in got


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edit_best(value, entries, least):
    def first(text):
        return (re.findall("[a-z0-9]+", text) or [None])[0]

    pool = [(i, e) for i, e in entries if first(e) is not None and first(e) == first(value)] or entries
    s, ident = max((round(1 - edits(value, e) / max(len(value), len(e), 1), 6), -i) for i, e in pool)
    return (-ident, s) if s >= least else None


def test_values_without_block_mate_meet_all_entries(spark):
    entries = [(1, "verrucous mesothelioma of the gallbladder"), (2, "giant cell adenoma of the liver"), (3, "giant cell adenomas of the liver"), (4, "cyst of the liver"), (5, "abcd")]
    values = ["verrducous mesothelioma of the gallbladder", "x giant cell adenoma of the liver", "giant cyst of the liver", "cyst, of the liver", "??? of the liver", "zbcde", "nothing near"]
    v, e = spark.createDataFrame([(x,) for x in [*values, None]], "v string"), spark.createDataFrame([*entries, (6, None)], "id int, e string")
    out = blocked_best(v, e, "v", "e", "id", lambda c: F.nullif(F.regexp_extract(c, "[a-z0-9]+", 0), F.lit("")), 0.6).collect()
    assert {r["value"]: (r["id"], r["similarity"]) for r in out} == {x: m for x in values if (m := edit_best(x, entries, 0.6))}
    assert {r["value"]: r["id"] for r in out}["verrducous mesothelioma of the gallbladder"] == 1 and len(out) == 6


def test_token_sets_meet_all_entries(spark):
    entries = [(1, "lipomatous blastoma of the pancreas"), (2, "myxoid choristoma of the bile duct"), (3, "cholangiocarcinoma"), (4, "choristoma of the bile duct myxoid"), (5, "edema"), (6, "of the liver of"), (7, "")]
    values = [
        "lipomatous blastoma of the panclreas", "pancreas lipomatous blastoma of the", "myxoid choristoma of the bile duct 2nd opinion", "bile duct of the myxoid choristoma choristoma",
        "cholangiocarcinomo", "hepatic edema", "of the liver", "of the", "oedema", "quite other words", "",
    ]
    v = spark.createDataFrame([(x,) for x in [*values, None]], "v string")
    want = {}
    for x in filter(None, values):
        score, ident = max((round(token_set(x, e), 4), -i) for i, e in entries if e)
        if score >= 90:
            want[x] = (-ident, score)
    out = token_set_best(v, spark.createDataFrame([*entries, (8, None)], "id int, e string"), "v", "e", "id", 90).collect()
    assert {r["value"]: (r["id"], r["score"]) for r in out} == want
    assert {x: i for x, (i, _) in want.items()} == {x: i for x, i in zip(values, (1, 1, 2, 2, 3, 5, 6, 1, 5), strict=False) if x in want} and len(want) >= 7
