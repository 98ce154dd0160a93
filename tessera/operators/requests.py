"""Understanding requests: grammar, variants, governed expansion, routing.

A single request is understood on the driver; a table of them by the same
functions over Arrow batches, or by Column expressions where those suffice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD = re.compile("[a-z0-9]+")

MODES = ("append", "replace", "either", "boost")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Rule:
    """One governed abbreviation.

    ``mode``: append the expansions, replace the first mention by the first of
    them, offer them as ``either`` of several in brackets, or only mark the
    query for a title ``boost``.
    """

    abbreviation: str
    expansions: tuple[str, ...]
    allowed_roots: frozenset[str] = frozenset()
    blocked_roots: frozenset[str] = frozenset()
    required_terms: frozenset[str] = frozenset()
    mode: str = "append"
    standalone: bool = False
    enabled: bool = True
    guarded: bool = False  # not beside a generic term


@dataclass(frozen=True)
class Governance:
    """The rules in order, the words that hint at a root, and terms too generic to expand beside."""

    rules: tuple[Rule, ...] = ()
    hints: Mapping[str, str] = field(default_factory=dict)
    generic: frozenset[str] = frozenset()
    enabled: bool = True
    gated: bool = True


@dataclass
class Expanded:
    query: str
    applied: list[str] = field(default_factory=list)
    skipped: dict[str, str] = field(default_factory=dict)
    roots: list[str] = field(default_factory=list)


def flag(value: str | None, default: bool = False) -> bool:
    """A setting as a truth value: 1, true, yes and on are true."""
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


def governance(document: str, enabled: str | None = None, gated: str | None = None) -> Governance:
    """From the JSON of a rules document and the values of its two switches."""
    doc = json.loads(document)
    rules = tuple(
        Rule(
            r["abbreviation"].strip(),
            tuple(e.strip() for e in r.get("expansions") or () if e.strip()),
            *(frozenset(r.get(k) or ()) for k in ("allowed_roots", "blocked_roots", "required_terms")),
            r.get("mode") or "append",
            bool(r.get("standalone")),
            r.get("enabled") is not False,
            bool(r.get("guarded")),
        )
        for r in doc.get("rules") or ()
        if (r.get("abbreviation") or "").strip()
    )
    return Governance(rules, dict(doc.get("hints") or {}), frozenset(doc.get("generic") or ()), flag(enabled, True), flag(gated, True))


def infer_roots(query: str, hints: Mapping[str, str], root: str | None = None, organ: str | None = None) -> set[str]:
    """Roots that the words of a query, a given root and the words of an organ speak for."""
    found = {hints[w] for w in (*words(query), *words(organ or "")) if w in hints}
    return found | ({root.strip()} if root and root.strip() else set())


def _verdict(rule: Rule, original: str, roots: set[str], governed: Governance) -> str | None:
    """Why a rule doesn't apply, or None."""
    sure = rule.standalone and len(rule.allowed_roots) == 1
    if governed.gated and roots & rule.blocked_roots:
        return "blocked root"
    if governed.gated and rule.allowed_roots and not sure and not roots & rule.allowed_roots:
        return "root not allowed"
    plain = " ".join(words(original))
    if rule.required_terms and not sure and not any(t.lower() in plain for t in rule.required_terms):
        return "no context"
    if rule.guarded and rule.mode != "boost" and set(words(original)) & governed.generic:
        return "generic term"
    return None


def expand_query(query: str | None, governed: Governance, root: str | None = None, organ: str | None = None) -> Expanded:
    """Apply the rules in order.

    An abbreviation counts wherever it stands as a word of the query as it
    evolves, expansions of earlier rules included; roots and context are those
    of the query as given.  A rule that may stand alone, having one allowed root,
    brings that root along for the rules after it.
    """
    original = (query or "").strip()
    out = Expanded(original)
    if not governed.enabled or not original:
        return out
    roots = infer_roots(original, governed.hints, root, organ)
    for rule in governed.rules:
        mention = re.compile(rf"\b{re.escape(rule.abbreviation)}\b", re.I)
        if not rule.enabled or not rule.expansions or not mention.search(out.query):
            continue
        if rule.standalone and len(rule.allowed_roots) == 1:
            roots = roots | rule.allowed_roots
        if reason := _verdict(rule, original, roots, governed):
            out.skipped[rule.abbreviation] = reason
            continue
        if rule.mode == "replace":
            changed = mention.sub(lambda _, to=rule.expansions[0]: to, out.query, count=1)
        elif rule.mode == "either":
            changed = f"{out.query} ({' OR '.join(rule.expansions)})"
        elif rule.mode == "boost":
            changed = out.query
        else:
            changed = " ".join((out.query, *rule.expansions))
        if changed != out.query or rule.mode == "boost":
            out.applied.append(rule.abbreviation)
        out.query = changed
    out.query, out.roots = " ".join(out.query.split()), sorted(roots)
    return out


def expand_queries(df: DataFrame, query: str, governed: Governance, root: str | None = None) -> DataFrame:
    """``df`` with expanded (query, applied, roots) of every row; a null query gives an empty one."""

    @F.arrow_udf("struct<query:string,applied:array<string>,roots:array<string>>")
    def run(queries: pa.Array, roots: pa.Array) -> pa.Array:
        found = [expand_query(q, governed, r) for q, r in zip(queries.to_pylist(), roots.to_pylist(), strict=True)]
        kind = pa.struct([("query", pa.string()), ("applied", pa.list_(pa.string())), ("roots", pa.list_(pa.string()))])
        return pa.array([{"query": e.query, "applied": e.applied, "roots": e.roots} for e in found], kind)

    return df.withColumn("expanded", run(F.col(query).cast("string"), F.col(root).cast("string") if root else F.lit(None).cast("string")))


def roots_of(df: DataFrame, key: str, text: str, hints: DataFrame, most_hints: int = 100_000) -> DataFrame:
    """``key`` and the roots its words hint at (sorted), of rows with any; ``hints`` has term and root.

    The hints are counted, and sent to every task if few.
    """
    from tessera.functions.text import tokens

    few = hints.limit(most_hints + 1).count() <= most_hints
    said = df.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return said.join(F.broadcast(hints) if few else hints, "term").groupBy(key).agg(F.array_sort(F.collect_set("root")).alias("roots"))


def search_or_fall_back(search: Callable[[str], DataFrame], query: str, governed: Governance, root: str | None = None) -> tuple[DataFrame, list[str]]:
    """``search`` of the expanded query, of the query as given should that fail; and the warnings."""
    warnings: list[str] = []
    try:
        expanded = expand_query(query, governed, root).query
    except Exception as e:  # noqa: BLE001 - a faulty rule must not cost the search
        expanded, warnings = query, [f"expansion failed: {type(e).__name__}"]
    try:
        return search(expanded), warnings
    except Exception as e:
        if expanded == query:
            raise
        return search(query), [*warnings, f"expanded query failed: {type(e).__name__}"]


def parse_tag_query(text: str) -> tuple[str, str]:
    """(mode, value): ``root:X`` and ``tag:X`` by prefix, a path by its separator, else free text."""
    text = (text or "").strip()
    for mode in ("root", "tag"):
        if text.lower().startswith(f"{mode}:"):
            return mode, text[len(mode) + 1 :].strip()
    return ("path", text) if "::" in text else ("text", text)


def tag_query(text: Column) -> Column:
    """The same as a struct of mode and value."""
    q = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(q)
    mode = F.when(low.startswith("root:"), "root").when(low.startswith("tag:"), "tag").when(F.contains(q, F.lit("::")), "path").otherwise("text")
    return F.struct(mode.alias("mode"), F.when(mode.isin("root", "tag"), F.trim(F.regexp_replace(q, "^[^:]*:", ""))).otherwise(q).alias("value"))


def organ_of_context(context: str | None) -> str:
    """The organ of a breadcrumb: its first part, and of that what stands behind the last dash."""
    head = re.split(r"\s*>\s*", (context or "").strip(), maxsplit=1)[0].strip()
    return " ".join(re.split(r"\s*[—–-]\s*", head)[-1].split()) if head else ""


def _once(candidates: Iterable[str], most: int | None = None) -> list[str]:
    """Without blanks and repeats, whatever their case."""
    kept: dict[str, str] = {}
    for c in candidates:
        if c.strip():
            kept.setdefault(c.strip().lower(), c.strip())
    return list(kept.values())[:most]


def variants(query: str, context: str | None, aspects: Sequence[str], most: int = 4) -> list[str]:
    """The bare query, with its organ behind it if it is of up to three words, and that with each aspect."""
    base, organ = (query or "").strip(), organ_of_context(context)
    if not base:
        return [base]
    full = f"{base} {organ}" if organ and len(base.split()) <= 3 and organ.lower() not in base.lower() else base
    return _once([base, full, *(f"{full} {a}" for a in aspects)], most)


def with_suffixes(query: str, suffixes: Sequence[str]) -> list[str]:
    """The query and the query with each suffix."""
    base = (query or "").strip()
    return _once([base, *(f"{base} {s}" for s in suffixes)]) or [base]


def each(function: Callable[..., list[str]], *columns: Column) -> Column:
    """A function of strings to a list, row by row over Arrow batches."""

    @F.arrow_udf("array<string>")
    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array([function(*row) for row in zip(*(a.to_pylist() for a in arrays), strict=True)], pa.list_(pa.string()))

    return run(*columns)


def organ_hint(text: Column, organs: Mapping[str, Sequence[str]], first: Mapping[str, str]) -> Column:
    """The organ of the first pattern of ``first`` that occurs, else the first of ``organs`` any of whose words occur."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(None).cast("string")
    for organ, said in reversed(organs.items()):
        out = F.when(low.rlike("|".join(map(re.escape, said))), organ).otherwise(out)
    for pattern, organ in reversed(first.items()):
        out = F.when(low.rlike(pattern), organ).otherwise(out)
    return out


def scoped(text: Column, organ: Column, organs: Mapping[str, Sequence[str]], anchors: Mapping[str, str]) -> Column:
    """The query with its organ's anchor word, unless it has one of the organ's first three words."""
    q = F.trim(text)
    out = q
    for name, said in organs.items():
        has = F.lower(q).rlike("|".join(map(re.escape, said[:3])))
        out = F.when((organ == name) & ~has & (q != ""), F.concat(q, F.lit(" " + anchors.get(name, name)))).otherwise(out)
    return out


def match_queries(terms: Column, most: int = 12) -> Column:
    """Search expressions of a list of terms, strictest first: all of them, any of them."""
    quoted = F.transform(F.slice(terms, 1, most), lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    return F.when(F.size(quoted) > 1, F.array(F.array_join(quoted, " AND "), F.array_join(quoted, " OR "))).otherwise(quoted)


def page_root(tag: Column, browse: Column, wrapper: str, family: str) -> Column:
    """The root a page is narrowed to: that it was browsed under, else its tag's, which behind ``wrapper`` is the second part.

    A tag of a member of ``family`` (its name begins with the family's) stays when the family was browsed.
    """

    def token(c: Column) -> Column:
        return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")

    parts = F.filter(F.split(tag, "::"), lambda p: p != "")
    head = token(F.try_element_at(parts, F.lit(1)))
    of_tag = F.when(F.contains(tag, F.lit("::")), F.when((head == wrapper) & (F.size(parts) > 1), token(F.try_element_at(parts, F.lit(2)))).otherwise(head))
    browsed = F.nullif(token(browse), F.lit(""))
    return F.when((browsed == family) & of_tag.startswith(family), of_tag).otherwise(F.coalesce(browsed, of_tag))


def same_root(a: Column, b: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Whether two root tokens are one or of one group; not if either is null or empty."""
    same = a == b
    for group in groups:
        same = same | (a.isin(*group) & b.isin(*group))
    return F.coalesce(same & (a != "") & (b != ""), F.lit(False))


def rules_table(spark: SparkSession, path: str) -> Governance:
    """A rules document from a file, its switches from the session's settings."""
    document = spark.read.text(path, wholetext=True).first()[0]
    return governance(document, spark.conf.get("tessera.expansion.enabled", None), spark.conf.get("tessera.expansion.gated", None))


def mentions(text: str) -> list[str]:
    """Labels marked as ``@label;`` in order; the last one's semicolon may be missing."""
    return [m.strip() for m in re.findall(r"@([^;@]+);?", text or "") if m.strip()]


def without_marks(text: str) -> str:
    """The text with its marked labels as plain words."""
    return " ".join(re.sub(r"@([^;@]+);?", lambda m: m.group(1).strip(), text or "").split())


def plain_terms(text: Column) -> Column:
    """Provider-safe queries: no brackets, quotes, or boolean and proximity operators."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[(){}\[\]\"'\\]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?i)\b(?:AND|OR|NOT|W/[0-9]+|PRE/[0-9]+)\b", " "), r"\s+", " "))


def route(text: str, rules: Sequence[tuple[str, str]], default: str) -> str:
    """The name of the first pattern that occurs."""
    return next((name for pattern, name in rules if re.search(pattern, text, re.I)), default)


def tagged(df: DataFrame, tags: Sequence[str], match: str, column: str = "primary_tag", root: str = "tag_root") -> DataFrame:
    """Rows of any of the tags: ``exact``, by ``prefix`` or by ``root``; no tags leave the rows as they are."""
    if not tags:
        return df
    if match == "exact":
        return df.where(F.col(column).isin(*tags))
    if match == "root":
        return df.where(F.col(root).isin(*(t.split("::")[0] for t in tags)))
    hit = F.lit(False)
    for t in tags:
        hit = hit | F.col(column).startswith(t.rstrip(":"))
    return df.where(hit)


def with_keywords(df: DataFrame, query: str, columns: Sequence[str], most: int = 6) -> DataFrame:
    """Rows in which each of the first ``most`` words of ``query`` stands in one of the columns."""
    for word in query.split()[:most]:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(word.lower())), F.lit(False))
        df = df.where(hit)
    return df
