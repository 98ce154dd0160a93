"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words no search looks for.
STOPWORDS = ("the", "and", "or", "of", "in", "to", "for", "with", "a", "an", "on", "by", "from", "is", "are", "as")


def present(value: Column) -> Column:
    """The value without outer spaces, null if nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def first_present(*values: Column) -> Column:
    return F.coalesce(*(present(v) for v in values))


def normalize(value: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def slug(value: Column, limit: int | None = None) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.substring(out, 1, limit) if limit else out


def phrase(value: Column) -> Column:
    """Words of a label: camel case parted, underscores and hyphens as spaces, lower case."""
    parted = F.regexp_replace(F.regexp_replace(value, "[_-]+", " "), "([a-z])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(parted, "\\s+", " ")))


def tokens(value: Column) -> Column:
    """Words of a-z and 0-9 in lower case, in order."""
    return F.filter(F.split(normalize(value), " "), lambda t: t != "")


def content_tokens(value: Column, stop: Sequence[str] = STOPWORDS) -> Column:
    return F.filter(tokens(value), lambda t: ~t.isin(*stop))


def ngrams(words: Column, n: int) -> Column:
    """Phrases of ``n`` consecutive words; none if there are fewer words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def label_key(value: Column, stop: Sequence[str] = ("of", "the", "and", "nos", "type")) -> Column:
    """Order-free key of a label: no parentheses, & as and, plural s dropped, words sorted."""
    text = F.replace(F.regexp_replace(F.lower(value), "\\([^)]*\\)", " "), F.lit("&"), F.lit(" and "))
    words = F.filter(F.split(normalize(text), " "), lambda t: (t != "") & ~t.isin(*stop))
    single = F.transform(words, lambda t: F.when((F.length(t) > 4) & t.endswith("s") & ~t.endswith("ss"), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t))
    return F.array_join(F.array_sort(single), " ")


def expand_tokens(value: Column, table: Mapping[str, str]) -> Column:
    """Words with abbreviations replaced by their phrases."""
    lookup = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.array_join(F.transform(tokens(value), lambda t: F.coalesce(F.try_element_at(lookup, t), t)), " ")


def excerpt(text: Column, terms: Sequence[str], limit: int) -> Column:
    """The text if short, else a window that starts a third of it before the first term, in the terms' order, that occurs."""
    found = F.filter(F.array(*(F.locate(t, F.lower(text)) for t in terms)), lambda p: p > 0)
    at = F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(1))
    start = F.greatest(at - F.lit(limit // 3), F.lit(1))
    window = F.trim(F.substr(text, start, F.lit(limit)))
    cut = F.concat(F.when(start > 1, F.lit("...")).otherwise(F.lit("")), window, F.when(start + limit - 1 < F.length(text), F.lit("...")).otherwise(F.lit("")))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def earliest_excerpt(text: Column, terms: Sequence[str], limit: int) -> Column:
    """A window from a quarter of it before the earliest place of any term."""
    first = F.array_min(F.filter(F.array(*(F.locate(t, F.lower(text)) for t in terms)), lambda p: p > 0))
    return F.substr(text, F.greatest(F.coalesce(first, F.lit(1)) - F.lit(limit // 4), F.lit(1)), F.lit(limit))


def has_phrase(text: Column, wanted: str) -> Column:
    """Whether the words of ``wanted`` stand in the text as whole consecutive words."""
    return F.contains(F.concat(F.lit(" "), normalize(text), F.lit(" ")), F.lit(f" {wanted} "))


def terms_near(text: Column, terms: Sequence[str], within: int) -> Column:
    """Whether the first places of two terms lie within so many characters."""
    spots = F.array_sort(F.filter(F.array(*(F.locate(t, F.lower(text)) for t in terms)), lambda p: p > 0))
    steps = F.when(F.size(spots) > 1, F.zip_with(F.slice(spots, 2, F.size(spots)), F.slice(spots, 1, F.size(spots) - 1), lambda a, b: a - b))
    return F.coalesce(F.exists(steps, lambda d: d <= within), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets, null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def title_case(value: Column) -> Column:
    """Initial capitals where at least 70 % of the letters are capitals, else unchanged."""
    upper = F.length(F.regexp_replace(value, "[^A-Z]", ""))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    return F.when(letters.cast("double") * 0.7 <= upper, F.initcap(F.lower(value))).otherwise(value)


def json_list(value: Column) -> Column:
    """A JSON list of strings, or an empty list for anything else."""
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def loose_int(value: Column) -> Column:
    """The integer a field spells, be it as 12 or 12.0; null for anything else."""
    return F.floor(F.trim(value).try_cast("double")).cast("bigint")


def flatten_tags(value: Column) -> Column:
    """Distinct non-empty parts of a text split at bars, semicolons and commas, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(value, "[|;,]"), lambda p: F.trim(p)), lambda p: p != ""))


def html_escape(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


# --- hierarchical tags, Root::Organ::Leaf


def tag_part(tag: Column, i: int) -> Column:
    """The i-th segment, negative from the end, null if there is none."""
    return F.try_element_at(F.split(tag, "::"), F.lit(i))


def tag_branch(tag: Column, depth: int) -> Column:
    return F.array_join(F.slice(F.split(tag, "::"), 1, depth), "::")


def tag_prefixes(tag: Column) -> Column:
    """All paths from the root to the tag."""
    parts = F.split(tag, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "::"))


# --- links


def plain_number(value: Column) -> Column:
    """Seconds without trailing zeros: 12.50 as 12.5, 12.0 as 12; null stays null."""
    return F.when(value.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), "0+$", ""), "[.]$", ""))


def time_link(url: Column, start: Column, end: Column) -> Column:
    """A media fragment link, url#t=start[,end]; null without url or start."""
    return F.concat(url, F.lit("#t="), plain_number(start), F.coalesce(F.concat(F.lit(","), plain_number(end)), F.lit("")))


def page_link(url: Column, page: Column, offset: int = 0) -> Column:
    return F.concat(url, F.lit("#page="), F.greatest(F.lit(1), page + offset).cast("string"))
