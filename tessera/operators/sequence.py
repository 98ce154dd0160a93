"""Operators on ordered sequences within an entity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, entity: str, order: Sequence[str], value: str) -> DataFrame:
    """Adds ``run``: the number, within the entity, of the run of equal ``value`` a row lies in (null equals null)."""
    over = Window.partitionBy(entity).orderBy(*order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(over)) | (F.row_number().over(over) == 1)
    return df.withColumn("run", F.sum(changed.cast("bigint")).over(over.rowsBetween(Window.unboundedPreceding, 0)))


def smooth_islands(
    df: DataFrame, entity: str, order: Sequence[str], value: str, start: str, end: str, min_rows: int, min_span: float, place: Column | None = None
) -> DataFrame:
    """Adds ``smoothed``: a run with fewer than ``min_rows`` rows or a shorter span than ``min_span`` takes the value of the run before it, else of the one after.

    The neighbours' original values count, so short runs in a row do not chain.
    With ``place``, as in :func:`beside`, runs are found stretch by stretch and
    named by their first row; what is then ordered within an entity is its runs.
    """
    if place is None:
        rows = islands(df, entity, order, value)
    else:
        near = beside(df.withColumn("_v", F.struct(F.col(value).alias("v"))), entity, order, "_v", place).drop("_after", "_v")
        begins = F.when(F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col(value)), F.struct(*order))
        near = near.withColumns({"_begin": begins, "_place": place}).drop("_before")
        last = near.groupBy(F.col(entity).alias("_e"), F.col("_place").alias("_q")).agg(F.max("_begin").alias("_l"))
        before = Window.partitionBy("_e").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.select("_e", "_q", F.max("_l").over(before).alias("_carried"))
        near = near.join(carried, F.col(entity).eqNullSafe(F.col("_e")) & F.col("_place").eqNullSafe(F.col("_q")))
        upto = Window.partitionBy(entity, "_place").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        rows = near.withColumn("run", F.coalesce(F.last("_begin", ignorenulls=True).over(upto), "_carried")).drop("_begin", "_place", "_e", "_q", "_carried")
    runs = rows.groupBy(entity, "run").agg(F.min(value).alias("_v"), F.count("*").alias("_n"), (F.max(end) - F.min(start)).alias("_span"))
    over = Window.partitionBy(entity).orderBy("run")
    short = (F.col("_n") < min_rows) | (F.col("_span") < min_span)
    painted = F.when(short & F.lag("run").over(over).isNotNull(), F.lag("_v").over(over)).when(short & F.lead("run").over(over).isNotNull(), F.lead("_v").over(over)).otherwise(F.col("_v"))
    named = runs.withColumn("smoothed", painted).select(F.col(entity).alias("_e"), F.col("run").alias("_r"), "smoothed")
    return rows.join(named, F.col(entity).eqNullSafe(F.col("_e")) & (F.col("run") == F.col("_r"))).drop("_e", "_r")


def sessions(df: DataFrame, entity: str, at: str, gap_seconds: float) -> DataFrame:
    """Adds ``session`` (from 1 within the entity): a new one begins after more than ``gap_seconds`` without a row."""
    over = Window.partitionBy(entity).orderBy(at)
    second = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    breaks = F.coalesce((second - F.lag(second).over(over) > gap_seconds).cast("bigint"), F.lit(1))
    return df.withColumn("session", F.sum(breaks).over(over.rowsBetween(Window.unboundedPreceding, 0)))


def sticky(df: DataFrame, entity: str, order: Sequence[str], value: str, most_rows: int, resets: Column) -> DataFrame:
    """Adds ``carried``: rows without ``value`` keep the last one for at most ``most_rows`` rows, until a row that ``resets``."""
    over = Window.partitionBy(entity).orderBy(*order)
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumn("_n", F.row_number().over(over)).withColumn("_reset", F.coalesce(resets, F.lit(False)))
    seen = F.last(F.when(F.col(value).isNotNull() & ~F.col("_reset"), F.struct(F.col(value).alias("v"), F.col("_n").alias("n"))), ignorenulls=True).over(upto)
    reset = F.last(F.when(F.col("_reset"), F.col("_n")), ignorenulls=True).over(upto)
    live = numbered.withColumn("_s", seen).withColumn("_r", reset)
    keep = (F.col("_n") - F.col("_s.n") <= most_rows) & (F.col("_r").isNull() | (F.col("_r") < F.col("_s.n")))
    return live.withColumn("carried", F.when(keep, F.col("_s.v"))).drop("_n", "_reset", "_s", "_r")


def merge_by_budget(df: DataFrame, entity: str, start: str, end: str, text: str, max_gap: float = 20.0, max_span: float = 140.0, max_chars: int = 2600, min_chars: int = 400, stretch_gap: float | None = None) -> DataFrame:
    """Greedy windows over time-coded rows: entity, window_start, window_end, n_rows, n_chars.

    A window takes rows in order until the next would follow a gap over
    ``max_gap``, stretch it beyond ``max_span`` seconds or its text beyond
    ``max_chars``; windows under ``min_chars`` are dropped.  Gaps over
    ``max_gap`` always end a window, so the rows between two such gaps are the
    unit of work, not the entity; rows pass as a sorted stream.  Rows without
    start are left out, a null text counts as empty.
    """
    over = Window.partitionBy("entity").orderBy("start", "end")
    rows = df.select(F.col(entity).cast("string").alias("entity"), F.col(start).cast("double").alias("start"), F.coalesce(F.col(end), F.col(start)).cast("double").alias("end"), F.coalesce(F.char_length(F.col(text)), F.lit(0)).alias("chars")).where("start is not null")
    breaks = F.coalesce((F.col("start") - F.lag("end").over(over) > max_gap).cast("bigint"), F.lit(1))
    rows = rows.withColumn("part", F.sum(breaks).over(over.rowsBetween(Window.unboundedPreceding, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, window, out = None, None, []

        def close():
            if window and window[3] >= min_chars:
                out.append((key[0], *window))

        for batch in batches:
            for e, s, t, c, p in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if window and (e, p) == key and t - window[0] <= max_span and window[3] + 1 + c <= max_chars:
                    window = (window[0], max(window[1], t), window[2] + 1, window[3] + 1 + c)
                else:
                    close()
                    key, window = (e, p), (s, t, 1, c)
            if out:
                yield _windows(out)
                out = []
        close()
        if out:
            yield _windows(out)

    ordered = rows.select("entity", "start", "end", "chars", "part").repartition("entity", "part").sortWithinPartitions("entity", "part", "start", "end")
    return ordered.mapInArrow(run, "entity string, window_start double, window_end double, n_rows bigint, n_chars bigint")


def _windows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["entity", "window_start", "window_end", "n_rows", "n_chars"])


def beside(df: DataFrame, entity: str, order: Sequence[str], column: str, place: Column | None = None) -> DataFrame:
    """Adds ``_before`` and ``_after``: ``column`` of the rows before and after each in its entity's order.

    ``place``, a number that never falls in that order, cuts an entity into
    stretches that are tasks of their own; only the ends of stretches, a row
    each, meet in the order of the whole entity.
    """
    if place is None:
        over = Window.partitionBy(entity).orderBy(*order)
        return df.withColumns({"_before": F.lag(column).over(over), "_after": F.lead(column).over(over)})
    rows = df.withColumn("_place", place)
    key = F.struct(*order)
    ends = rows.groupBy(F.col(entity).alias("_e"), F.col("_place").alias("_q")).agg(F.min_by(F.struct(column), key).alias("_first"), F.max_by(F.struct(column), key).alias("_last"))
    whole = Window.partitionBy("_e").orderBy("_q")
    ends = ends.select("_e", "_q", F.lag("_last").over(whole).alias("_prior"), F.lead("_first").over(whole).alias("_next"))
    joined = rows.join(ends, F.col(entity).eqNullSafe(F.col("_e")) & F.col("_place").eqNullSafe(F.col("_q")))
    over = Window.partitionBy(entity, "_place").orderBy(*order)
    n, of = F.row_number().over(over), F.count(F.lit(1)).over(Window.partitionBy(entity, "_place"))
    before = F.when(n == 1, F.col(f"_prior.{column}")).otherwise(F.lag(column).over(over))
    after = F.when(n == of, F.col(f"_next.{column}")).otherwise(F.lead(column).over(over))
    return joined.withColumns({"_before": before, "_after": after}).drop("_place", "_e", "_q", "_prior", "_next")


def neighbour_context(df: DataFrame, partition: str, order: Sequence[str], text: str, most: int = 700, place: Column | None = None) -> DataFrame:
    """Adds ``context``: the previous, own and next text of each row, parted by single spaces.

    When that is over ``most`` letters the own text stays whole; the previous
    keeps its end, of at most half the room, the next its beginning.  Texts are
    stripped; null and blank ones are left out, and a space stands for nothing.
    ``place`` cuts a long partition as in :func:`beside`.
    """
    strip = F.regexp_replace(F.col(text), "^\\s+|\\s+$", "")
    near = beside(df.withColumn("_own", F.nullif(strip, F.lit(""))), partition, order, "_own", place)
    room = F.greatest(most - F.coalesce(F.length("_own"), F.lit(0)) - 2, F.lit(0))
    half = F.floor(room / 2).cast("int")
    left = F.when(F.length("_before") <= half, F.col("_before")).otherwise(F.substring(F.col("_before"), F.length("_before") - half + 1, half))
    cut = near.withColumn("_left", left).withColumn("_right", F.substring(F.col("_after"), F.lit(1), room - F.coalesce(F.length("_left"), F.lit(0))))
    whole = F.concat_ws(" ", "_before", "_own", "_after")
    trimmed = F.concat_ws(" ", F.nullif("_left", F.lit("")), "_own", F.nullif("_right", F.lit("")))
    context = F.when(F.length(whole) > most, trimmed).otherwise(whole)
    return cut.withColumn("context", F.when(context == "", " ").otherwise(context)).drop("_own", "_before", "_after", "_left", "_right")


def outline(df: DataFrame, document: str, order: Sequence[str], text: str, levels: Sequence[tuple[str, str]], item: str) -> DataFrame:
    """Items of outlined documents with the headings they stand under: document, one column per level, number, item.

    ``levels`` are names and patterns from the outermost in, each with one group
    for the title; ``item`` is the pattern of a line that begins an item.  A
    heading ends those of its own and inner levels.  Other lines that aren't
    blank continue the item before them; before any item they are passed over.
    ``number`` counts the items under an outermost heading.  An outline is
    ordered by nature: a document is one sorted stream.
    """
    over = Window.partitionBy(document).orderBy(*order)
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    level = F.lit(None).cast("int")
    for i, (_, pattern) in reversed(list(enumerate(levels))):
        level = F.when(F.col(text).rlike(pattern), i).otherwise(level)
    rows = df.where(F.trim(F.col(text)) != "").withColumn("_n", F.row_number().over(over)).withColumn("_level", level)
    rows = rows.withColumn("_item", F.col("_level").isNull() & F.col(text).rlike(item))
    for i, (name, pattern) in enumerate(levels):
        held = F.last(F.when(F.col("_level") == i, F.struct(F.col("_n").alias("n"), F.trim(F.regexp_extract(F.col(text), pattern, 1)).alias("t"))), ignorenulls=True).over(upto)
        outer = F.coalesce(F.last(F.when(F.col("_level") < i, F.col("_n")), ignorenulls=True).over(upto), F.lit(0))
        rows = rows.withColumn(f"_h{i}", held).withColumn(f"_o{i}", outer)
    for i, (name, _) in enumerate(levels):
        rows = rows.withColumn(name, F.when(F.col(f"_h{i}.n") > F.col(f"_o{i}"), F.col(f"_h{i}.t")))
    # a heading ends an item as well: what follows it continues nothing
    rows = rows.withColumn("_start", F.last(F.when(F.col("_item"), F.col("_n")).when(F.col("_level").isNotNull(), F.lit(-1)), ignorenulls=True).over(upto))
    rows = rows.where(F.col("_level").isNull() & (F.col("_start") > 0))
    said = F.when(F.col("_item"), F.regexp_extract(F.col(text), item, 1)).otherwise(F.col(text))
    names = [n for n, _ in levels]
    items = rows.groupBy(document, *names, "_start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.trim(said).alias("t")))), lambda x: x["t"]), " ").alias("item"))
    return items.withColumn("number", F.row_number().over(Window.partitionBy(document, names[0]).orderBy("_start"))).drop("_start")
