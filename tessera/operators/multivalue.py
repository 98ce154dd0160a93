r"""Splitting fields that pack several values with inconsistent delimiters.

Method.  For each source and field the type of a piece is inferred from how
values begin (``path``: ``Word::``, ``number``, ``text``).  Every candidate
delimiter is then scored on the source's values by two terms: type regularity,
the share of the pieces behind it that begin as that type, and piece-count
consistency, one over one more than the relative spread of the number of pieces
it makes.  The score is their weighted geometric mean.  Delimiters above
``least_score`` are the source's; small sources lean on the regularity over all
sources.  Plain text does not show where a piece begins, so there only the
delimiter that cuts most values counts.  A value is cut at the source's
delimiters alone, where a piece of the type begins after them, or, for plain
text, outside double quotes.  So a comma within a value is no cut, and values
that mix delimiters are cut at each.

Scale.  Scores are one aggregation with map-side combine over the packed rows;
all else happens on its result of a row per source, field and candidate.  The
profile goes to every task if its sources, counted first, are at most
``most_sources``; otherwise rows meet it by a join that may split a hot source.
Everything is built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = ("\n", "\t", "|", ";", ",", "/", "&", "_")

#: How a piece of each type begins.
_BEGINS = {"path": r"[A-Za-z][A-Za-z0-9_]*::[A-Za-z]", "number": r"[+-]?[0-9]", "text": r"[^\s]"}
_SKIP = r"[\s\"'\\\[\]]*"


def _head(value: Column) -> Column:
    """Type of the piece a value begins with."""
    return (
        F.when(value.rlike("^" + _SKIP + _BEGINS["path"]), "path")
        .when(value.rlike("^" + _SKIP + r"[+-]?[0-9]+([.][0-9]+)?[\s\"']*$"), "number")
        .otherwise("text")
    )


#: Signs around a piece that never belong to it.
_AROUND = " \t\n\x0b\f\r\"'\\[]"


#: Signs at either end of a field that belong to no value where blanks set them off.
_STRAY = ";,|/&"


def _clean(piece: Column, around: Column) -> Column:
    """A piece without the signs around it, doubled or escaped ones within undone."""
    bare = F.btrim(piece, around)
    bare = F.when(F.contains(bare, F.lit('""')), F.replace(bare, F.lit('""'), F.lit('"'))).otherwise(bare)
    return F.when(F.contains(bare, F.lit("\\")), F.regexp_replace(bare, r"\\(.)", "$1")).otherwise(bare)


def _sign(d: str) -> str:
    return {"\n": "\\n", "\t": "\\t"}.get(d) or re.escape(d)


def _counts(value: Column, d: str) -> Column:
    """Of a value that holds ``d``: the pieces behind it, and those of them that begin as each type."""
    cut = rf"{_sign(d)}[\s\"'\\\[\]&&[^{_sign(d)}]]*"
    n = F.regexp_count(value, F.lit(rf"{cut}(?=[^\s\"'\\\[\]{_sign(d)}])"))
    path, number = (F.regexp_count(value, F.lit(f"{cut}(?={_BEGINS[k]})")) for k in ("path", "number"))
    return F.when(F.contains(value, F.lit(d)), F.struct(F.lit(d).alias("d"), n.alias("n"), path.alias("path"), number.alias("number")))


def _heads() -> Column:
    return F.struct(F.lit("").alias("d"), F.lit(1).alias("n"), *((F.col("head") == k).cast("int").alias(k) for k in ("path", "number")))


def _same(*columns: str) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return same


def delimiter_profile(values: DataFrame, candidates: Sequence[str] = CANDIDATES, least_score: float = 0.3, lean: float = 20.0) -> DataFrame:
    """``values`` (source, field, value) -> source, field, kind, delimiters, scores, cut (the pattern of a cut).

    Scores map each candidate to its score.  A source without any delimited
    value has the delimiters of all sources together.  The kind is that of most
    values; equal counts: path before number before text.
    """
    said = values.where("value is not null and value rlike '\\\\S'")
    marks = F.explode(F.array(_heads(), *(_counts(F.col("value"), d) for d in candidates)))
    counted = (
        said.withColumn("head", _head(F.col("value")))
        .select("source", "field", marks.alias("m"))
        .where("m.n > 0")
        .groupBy("source", "field", "m.d")
        .agg(F.count("*").alias("held"), F.sum("m.n").alias("n"), F.sum(F.col("m.n") * F.col("m.n")).alias("squares"), F.sum("m.path").alias("path"), F.sum("m.number").alias("number"))
        .withColumn("text", F.when(F.col("d") == "", F.col("n") - F.col("path") - F.col("number")).otherwise(F.col("n")))
    )
    each = counted.groupBy("source", "field").agg(
        F.max_by(F.struct("held", *_BEGINS), F.col("d") == "").alias("all"), F.map_from_entries(F.collect_list(F.struct("d", F.struct("held", "n", "squares", *_BEGINS)))).alias("by")
    )
    most = F.greatest(*(F.col(f"all.{k}") for k in _BEGINS))
    each = each.withColumn("kind", F.when(F.col("all.path") == most, "path").when(F.col("all.number") == most, "number").otherwise("text"))
    rows = each.select("source", "field", "kind", F.col("all.held").alias("values"), "by", F.explode(F.array(*(F.lit(d) for d in candidates))).alias("d")).withColumn("c", F.element_at("by", F.col("d")))
    good = F.when(F.col("kind") == "path", F.col("c.path")).when(F.col("kind") == "number", F.col("c.number")).otherwise(F.col("c.text"))
    rows = rows.select("source", "field", "kind", "values", "d", F.coalesce("c.held", F.lit(0)).alias("held"), F.coalesce("c.n", F.lit(0)).alias("n"), F.coalesce("c.squares", F.lit(0)).alias("squares"), F.coalesce(good, F.lit(0)).alias("good"))
    over = Window.partitionBy("d")  # a row per source and field
    mean = F.col("n") / F.nullif(F.col("held"), F.lit(0))
    spread = F.sqrt(F.greatest(F.col("squares") / F.nullif(F.col("held"), F.lit(0)) - mean * mean, F.lit(0.0))) / mean
    everywhere = F.coalesce(F.try_divide(F.sum("good").over(over), F.sum("n").over(over)), F.lit(0.0))
    regularity = F.coalesce(F.try_divide(F.col("good") + lean * everywhere, F.col("n") + lean), F.lit(0.0))
    consistency = 1 / (1 + F.coalesce(spread, F.lit(0.0)))
    scored = rows.select("source", "field", "kind", "d", (F.col("held") / F.col("values")).alias("reach"), F.round(F.pow(regularity, F.lit(0.75)) * F.pow(consistency, F.lit(0.25)), 6).alias("score"))
    quoted = F.create_map(*(x for d in candidates for x in (F.lit(d), F.lit(_sign(d)))))
    profile = scored.groupBy("source", "field", "kind").agg(
        F.sort_array(F.collect_list(F.when(F.col("score") >= least_score, F.col("d")))).alias("delimiters"),
        F.max_by(F.when(F.col("reach") > 0, F.col("d")), F.struct(F.col("score") * F.col("reach"), "d")).alias("widest"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("d", "score")))).alias("scores"),
    )
    profile = profile.withColumn("delimiters", F.when(F.col("kind") == "text", F.filter(F.array("widest"), lambda d: d.isNotNull())).otherwise(F.col("delimiters"))).drop("widest")
    signs = F.concat(F.lit("["), F.array_join(F.transform("delimiters", lambda d: F.element_at(quoted, d)), ""), F.lit("]"))
    around = F.concat(signs, F.lit(r"[\s\"'\\\["), F.array_join(F.transform("delimiters", lambda d: F.element_at(quoted, d)), ""), F.lit(r"\]]*"))
    cut = F.when(F.size("delimiters") == 0, F.lit(None).cast("string")).when(F.col("kind") == "path", F.concat(around, F.lit("(?=" + _BEGINS["path"] + ")"))).otherwise(F.concat(signs, F.lit(r'(?=(?:[^"]*"[^"]*")*[^"]*$)')))
    return profile.withColumn("cut", cut)


def split_values(df: DataFrame, key: str, source: str, fields: Sequence[str], most_sources: int = 20_000, sources: DataFrame | None = None, **inference) -> DataFrame:
    """One row per record, field, position and value: record_id, field_name, pos (from 1), n_values, tag.

    Positions count the non-empty values; repeats are kept.  Null, empty and
    blank fields give no rows, a field with one value gives one.  Rows with a
    null key or source are split as any other; repeated keys are each split.
    ``sources``, of one column that holds at least the sources of ``df``, spares
    counting them in ``df`` where that costs more than a read.
    """
    few = (df.select(F.col(f"`{source}`")) if sources is None else sources).distinct().limit(most_sources + 1).count() <= most_sources
    packed = df.select(
        F.col(f"`{key}`").cast("string").alias("record_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields))).alias("x"),
    ).select("record_id", "source", "x.field", "x.value")
    packed = packed.where("value is not null and value rlike '\\\\S'")
    profile = delimiter_profile(packed, **inference).select(F.col("source").alias("_source"), F.col("field").alias("_field"), F.concat(F.lit(_AROUND), F.array_join("delimiters", "")).alias("around"), "cut")
    known = packed.join(F.broadcast(profile) if few else profile, _same("source", "field"), "left")
    ends = F.btrim("value")
    stray = F.substring(ends, 1, 1).isin(*_STRAY) | F.substring(ends, -1, 1).isin(*_STRAY)
    value = F.when(stray, F.regexp_replace("value", rf"^\s*[{_STRAY}]+(?=\s)|(?<=\s)[{_STRAY}]+\s*$", "")).otherwise(F.col("value"))
    known = known.select("record_id", "field", value.alias("value"), "cut", F.coalesce("around", F.lit(_AROUND)).alias("around"))
    # replacing keeps its compiled pattern from row to row, splitting by a pattern does not
    marked = F.split(F.regexp_replace("value", F.col("cut"), F.lit("\x1e")), "\x1e")
    pieces = F.when(F.col("cut").isNull(), F.array("value")).when(F.contains("value", F.lit("\x1e")), F.split("value", F.col("cut"))).otherwise(marked)
    values = known.select("record_id", "field", F.filter(F.transform(pieces, lambda p: _clean(p, F.col("around"))), lambda p: p != "").alias("v"))
    return values.select("record_id", F.col("field").alias("field_name"), F.size("v").alias("n_values"), F.posexplode("v").alias("pos", "tag")).select(
        "record_id", "field_name", (F.col("pos") + 1).cast("int").alias("pos"), "n_values", "tag"
    )
