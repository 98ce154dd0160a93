"""Request understanding and string similarity."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.similarity import ratio, token_set
from tessera.operators import requests as R

RULES = (
    R.Rule("HCC", ("hepatocellular carcinoma",), allowed_roots=frozenset({"GI"})),
    R.Rule("CLL", ("chronic lymphocytic leukemia",), allowed_roots=frozenset({"Heme"}), blocked_roots=frozenset({"GI"}), mode="replace", standalone=True),
    R.Rule("CIS", ("carcinoma in situ",), allowed_roots=frozenset({"GU", "GYN"}), required_terms=frozenset({"bladder", "cervix"}), guarded=True),
    R.Rule("DC", ("ductal carcinoma", "duct cancer"), required_terms=frozenset({"breast"}), mode="either"),
    R.Rule("OFF", ("nothing",), enabled=False),
    R.Rule("TB", ("title only",), mode="boost"),
    R.Rule("AB", ("HD of x",)),
    R.Rule("HD", ("hodgkin disease",)),
)
GOVERNED = R.Governance(RULES, {"liver": "GI", "node": "Heme", "breast": "Breast", "bladder": "GU", "cervix": "GYN"}, frozenset({"carcinoma", "fibroma"}))


@pytest.mark.parametrize(
    ("query", "root", "want", "skipped"),
    [
        ("HCC of liver", None, "HCC of liver hepatocellular carcinoma", {}),
        ("HCC in node", None, "HCC in node", {"HCC": "root not allowed"}),
        ("HCC", None, "HCC", {"HCC": "root not allowed"}),
        ("HCC grading scheme", None, "HCC grading scheme", {"HCC": "root not allowed"}),  # several words, no context
        ("HCC grading", "GI", "HCC grading hepatocellular carcinoma", {}),
        ("cll", None, "chronic lymphocytic leukemia", {}),
        ("cll and CLL", None, "chronic lymphocytic leukemia and CLL", {}),  # the first mention only
        ("CLL of liver", None, "CLL of liver", {"CLL": "blocked root"}),
        ("CIS bladder", None, "CIS bladder carcinoma in situ", {}),
        ("CIS", "GU", "CIS", {"CIS": "no context"}),
        ("CIS carcinoma of bladder", None, "CIS carcinoma of bladder", {"CIS": "generic term"}),
        ("breast DC", None, "breast DC (ductal carcinoma OR duct cancer)", {}),
        ("DC grade", None, "DC grade", {"DC": "no context"}),
        ("OFF switch", None, "OFF switch", {}),
        ("TB x", None, "TB x", {}),
        ("AB", None, "AB HD of x hodgkin disease", {}),  # an expansion may hold a later abbreviation
        ("  two   words ", None, "two words", {}),
        (None, None, "", {}),
    ],
)
def test_expansion(query, root, want, skipped):
    out = R.expand_query(query, GOVERNED, root)
    assert (out.query, out.skipped) == (want, skipped)


def test_switches_and_metadata():
    assert R.expand_query("HCC", R.Governance(RULES, gated=False)).query == "HCC hepatocellular carcinoma"
    assert R.expand_query("HCC of liver", R.Governance(RULES, {"liver": "GI"}, enabled=False)).query == "HCC of liver"
    assert R.expand_query("HCC", GOVERNED, organ="the Liver").roots == ["GI"]
    assert R.expand_query("TB", GOVERNED).applied == ["TB"]


def test_rules_document():
    doc = '{"rules": [{"abbreviation": " HCC ", "expansions": ["hepatocellular carcinoma", " "], "allowed_roots": ["GI"]}, {"abbreviation": ""}], "hints": {"liver": "GI"}, "generic": ["tumor"]}'
    governed = R.governance(doc, "yes", None)
    assert governed.rules == (R.Rule("HCC", ("hepatocellular carcinoma",), frozenset({"GI"})),) and governed.gated
    assert not R.governance(doc, "off").enabled and R.flag(" TRUE ") and not R.flag("0") and R.flag(None, True)


def test_expanding_a_table_is_expanding_each_row(spark):
    df = spark.createDataFrame([(1, "HCC of liver", None), (2, None, "GI"), (3, "HCC", "GI")], "id int, q string, root string")
    got = {r["id"]: (r["expanded"]["query"], r["expanded"]["applied"]) for r in R.expand_queries(df, "q", GOVERNED, "root").collect()}
    assert got == {1: ("HCC of liver hepatocellular carcinoma", ["HCC"]), 2: ("", []), 3: ("HCC hepatocellular carcinoma", ["HCC"])}
    assert R.expand_queries(df.limit(0), "q", GOVERNED).count() == 0


def test_search_falls_back_to_the_query_as_given():
    def search(q):
        if "hepatocellular" in q:
            raise ValueError(q)
        return q

    assert R.search_or_fall_back(search, "HCC of liver", GOVERNED) == ("HCC of liver", ["expanded query failed: ValueError"])
    assert R.search_or_fall_back(search, "plain", GOVERNED) == ("plain", [])
    with pytest.raises(ZeroDivisionError):
        R.search_or_fall_back(lambda q: 1 / 0, "plain", GOVERNED)


def test_grammar(spark):
    cases = {"root: GI": ("root", "GI"), "TAG:GI::Colon": ("tag", "GI::Colon"), "GI::Colon": ("path", "GI::Colon"), " colon polyp": ("text", "colon polyp"), None: ("text", "")}
    assert {k: R.parse_tag_query(k) for k in cases} == cases
    df = spark.createDataFrame([(k,) for k in cases], "q string").select("q", R.tag_query(F.col("q")).alias("p"))
    assert {r["q"]: tuple(r["p"]) for r in df.collect()} == cases


def test_variants():
    aspects = ["histology", "IHC", "differential"]
    assert R.variants("HGSC", "GYN — Ovary > Carcinomas", aspects) == ["HGSC", "HGSC Ovary", "HGSC Ovary histology", "HGSC Ovary IHC"]
    assert R.variants("Fibroadenoma", "Breast > Benign Changes", aspects)[1] == "Fibroadenoma Breast"
    assert R.variants("high grade serous carcinoma", "GYN — Ovary", aspects) == ["high grade serous carcinoma", *(f"high grade serous carcinoma {a}" for a in aspects)]
    assert R.variants("  LCIS ", None, aspects)[0] == "LCIS" and R.variants("", "x", aspects) == [""]
    assert R.with_suffixes("a", ["b", "B", "c"]) == ["a", "a b", "a c"]
    assert R.mentions("see @Villous polyp; and @x; @y") == ["Villous polyp", "x", "y"] and R.without_marks("see @Villous polyp;  now") == "see Villous polyp now"
    assert R.route("compare A vs B", [("vs", "compare"), ("page", "topic")], "search") == "compare"
    assert R.route("zzz", [("vs", "compare")], "search") == "search"


def test_roots_and_safe_terms(spark):
    df = spark.createDataFrame([("Wrapped::cyto::Lung", None), ("GI::Colon", "Heme "), ("Cyto_Lung::X", "cyto"), ("plain", None), (None, "HN"), ("::A::", "")], "t string, b string")
    got = [r[0] for r in df.select(R.page_root(F.col("t"), F.col("b"), "wrapped", "cyto")).collect()]
    assert got == ["cyto", "heme", "cytolung", None, "hn", "a"]
    pairs = spark.createDataFrame([("thoracic", "thoraxmediastinum"), ("gi", "gi"), ("gi", None), ("", ""), ("gi", "gu")], "a string, b string")
    assert [r[0] for r in pairs.select(R.same_root(F.col("a"), F.col("b"), [("thoracic", "thoraxmediastinum")])).collect()] == [True, True, False, False, False]
    assert spark.range(1).select(R.plain_terms(F.lit('("a" and b) W/3 [c] nota'))).first()[0] == "a b c nota"


def test_similarity():
    assert ratio("abcd", "abcd") == 100 and ratio(None, "a") is None and ratio("", "") == 100
    assert token_set("cell giant adenoma", "Adenoma giant cell cell") == 100
    assert token_set("", "a") == 0 and token_set("a b", "c d") < 50
