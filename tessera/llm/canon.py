"""Mapping freely typed values to a canonical list by a prefix-filter set-similarity join.

Method.  Values and entries become sets of character trigrams of their words.
Trigrams are ordered by global rarity; two sets of Jaccard similarity >= t must
share one of their rarest few (the prefix), have lengths within a factor t, and
leave room after the shared place (positional filter).  Only such pairs are
joined; their Jaccard similarity is computed exactly and the best is kept.  An
entry stands if each word of its core (what tells it from its neighbours) is
found among the value's words but for a few letters, so that a value naming
another thing of the same place matches nothing.  If none stands so, the most
similar entry does if its similarity is ``sure``, since words run together or
torn apart hide from any comparison by words.  A value that is an entry's alias
but for case and punctuation is that entry.

Scale.  Work is done per distinct value (one aggregation with map-side combine,
so a value of a third of all rows costs as much as any).  A list of up to
``most_entries`` entries, counted first, goes to every task with the rarity of
its own trigrams (others match nothing and count as rarest), and values are
matched where they are, without a shuffle.  A longer list is joined by shuffling
prefixes.  The result is joined back to the rows, where a hot value may be split
by the skew handling of the join.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.runs import edits_within
from tessera.session import cut_lineage

#: Words that only join others, and British spellings read as American ones.
JOINING = ("of", "the")
SPELLINGS = (("ae", "e"), ("oe", "e"), ("our", "or"), ("ising", "izing"))


def words_of(value: Column) -> Column:
    """Lower-case words of a value; runs of capitals and camel case are parted."""
    text = F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2"))
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    words = F.split(F.regexp_replace(F.regexp_replace(text, "['’]", ""), "[^\\p{L}\\p{N}]+", " "), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*JOINING))


def trigrams(words: Column) -> Column:
    """Distinct trigrams of each word between marks of its ends."""
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit("^"), w, F.lit("$")), i, F.lit(3))))))


def alias_of(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^\\p{L}\\p{N}]", "")


def _allowed(word: str) -> int:
    return 1 if len(word) <= 4 else 2 if len(word) <= 6 else 3


def covers(core: Sequence[str], words: Sequence[str]) -> bool:
    """Each core word is among ``words`` but for 1, 2 or 3 letters, by its length; a word serves once (a matching, by augmenting paths)."""
    near = [[i for i, w in enumerate(words) if edits_within(c, w, _allowed(c)) is not None] for c in core]
    serves: dict[int, int] = {}

    def place(c: int, tried: set[int]) -> bool:
        for i in near[c]:
            if i not in tried:
                tried.add(i)
                if i not in serves or place(serves[i], tried):
                    serves[i] = c
                    return True
        return False

    return all(place(c, set()) for c in range(len(core)))


def chosen(hits: list[tuple[float, int, Sequence[str]]], words: Sequence[str], sure: float) -> tuple[int, float] | None:
    """Of (similarity, id, core) the best that stands, as (id, similarity)."""
    hits = sorted(hits, key=lambda h: (-h[0], h[1]))
    best = next((h for h in hits if covers(h[2], words)), hits[0] if hits and hits[0][0] >= sure else None)
    return best and (best[1], best[0])


def _choose(sure: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, words, hits = (batch.column(i).to_pylist() for i in range(3))
            best = [chosen([(h["similarity"], h["id"], h["core"]) for h in near], said, sure) or (None, None) for said, near in zip(words, hits, strict=True)]
            ids, scores = zip(*best, strict=True) if best else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(ids, pa.int32()), pa.array(scores, pa.float64())], names=["value", "canon_id", "similarity"])

    return run


def grams_of(words: Sequence[str]) -> set[str]:
    """The same trigrams as :func:`trigrams`."""
    return {f"^{w}$"[i : i + 3] for w in words for i in range(len(w))}


class _Index:
    """Entries by their prefix trigrams, rarest first."""

    def __init__(self, entries: list[tuple[int, list[str], list[str]]], rarity: dict[str, int], threshold: float, sure: float):
        self.rarity, self.threshold, self.sure = rarity, threshold, sure
        self.ids, self.cores = [e[0] for e in entries], [e[2] for e in entries]
        self.sets = [grams_of(e[1]) for e in entries]
        self.by_gram: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, grams in enumerate(self.sets):
            for j, g in enumerate(self.prefix(grams)):
                self.by_gram[g].append((k, j))

    def prefix(self, grams: set[str]) -> list[str]:
        n = len(grams)
        ordered = sorted(grams, key=lambda g: (self.rarity.get(g, 0), g))
        return ordered[: n - math.ceil(n * self.threshold - 1e-9) + 1]

    def best(self, words: list[str]) -> tuple[int, float] | None:
        grams, t = grams_of(words), self.threshold
        n, seen, hits = len(grams), set(), []
        for i, g in enumerate(self.prefix(grams)):
            for k, j in self.by_gram.get(g, ()):
                if k in seen:
                    continue
                seen.add(k)
                m = len(self.sets[k])
                if m < n * t or n < m * t or 1 + min(n - i - 1, m - j - 1) < t / (1 + t) * (n + m) - 1e-9:
                    continue
                both = len(grams & self.sets[k])
                if both >= t * (n + m - both) - 1e-9:
                    hits.append((both / (n + m - both), self.ids[k], self.cores[k]))
        return chosen(hits, words, self.sure)


def _match_here(typed: DataFrame, entries: list[tuple[int, list[str], list[str]]], threshold: float, sure: float) -> DataFrame:
    """Match against a list of checked size, held by every task."""
    context = typed.sparkSession.sparkContext
    known = context.broadcast(sorted({g for e in entries for g in grams_of(e[1])}))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, n = set(known.value), Counter()
        for batch in batches:
            for words in batch.column(1).to_pylist():
                n.update(grams_of(words) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["g", "n"])

    rarity = Counter(g for e in entries for g in grams_of(e[1]))
    for g, n in typed.mapInArrow(count, "g string, n bigint").groupBy("g").agg(F.sum("n")).collect():  # at most the list's own trigrams
        rarity[g] += n
    shared = context.broadcast((entries, dict(rarity)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(*shared.value, threshold, sure)
        for batch in batches:
            found = [index.best(w) for w in batch.column(1).to_pylist()]
            keep = [i for i, f in enumerate(found) if f]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array([found[i][0] for i in keep], pa.int32()), pa.array([found[i][1] for i in keep], pa.float64())], names=["value", "canon_id", "similarity"]
            )

    return typed.mapInArrow(match, "value string, canon_id int, similarity double")


def _match_shuffled(typed: DataFrame, known: DataFrame, threshold: float, sure: float) -> DataFrame:
    """Match against a list of any size."""
    typed, known = (df.withColumn("grams", trigrams(F.col("words"))) for df in (typed, known))
    rarity = typed.select(F.explode("grams").alias("g")).unionByName(known.select(F.explode("grams").alias("g"))).groupBy("g").agg(F.count("*").alias("df"))

    def prefix(df: DataFrame, key: str) -> DataFrame:
        each = df.select(key, F.size("grams").alias("n"), F.explode("grams").alias("g")).join(rarity, "g")
        ranked = each.groupBy(key, "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("r"))
        keep = F.slice("r", 1, (F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1).cast("int"))
        return ranked.select(key, "n", F.posexplode(keep).alias("i", "p")).select(key, "n", "i", F.col("p.g").alias("g"))

    a, b = prefix(typed, "value"), prefix(known, "id").withColumnsRenamed({"n": "m", "i": "j"})
    t = F.lit(threshold)
    room = 1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1  # what can still be shared from this place on
    pairs = a.join(b, "g").where((F.col("m") >= F.col("n") * t) & (F.col("n") >= F.col("m") * t))
    # the first shared prefix place of a pair bounds what the pair can share
    pairs = pairs.groupBy("value", "id").agg(F.min_by(F.struct(room.alias("room"), F.col("n").alias("n"), F.col("m").alias("m")), F.col("i")).alias("f"))
    pairs = pairs.where(F.col("f.room") >= t / (1 + t) * (F.col("f.n") + F.col("f.m")) - 1e-9).select("value", "id")
    both = F.size(F.array_intersect("grams", "entry_grams"))
    near = (
        pairs.join(typed, "value")
        .join(known.select("id", "core", F.col("grams").alias("entry_grams")), "id")
        .withColumn("similarity", both / (F.size("grams") + F.size("entry_grams") - both))
        .where(F.col("similarity") >= t)
        .groupBy("value")
        .agg(F.first("words").alias("words"), F.collect_list(F.struct("id", "core", "similarity")).alias("hits"))  # those similar enough
    )
    return near.mapInArrow(_choose(sure), "value string, canon_id int, similarity double").where("canon_id is not null")


def match_values(values: DataFrame, entries: DataFrame, threshold: float = 0.3, sure: float = 0.45, most_entries: int = 20_000, task_values: int = 2_000) -> DataFrame:
    """``values`` (value) -> distinct value, canon_id, similarity; -1 and null where no entry is meant.

    ``entries``: id int, name, alias (or null), core (the part of the name whose
    words must be found); of any length.  Null and blank values give no
    rows; entries with null id or name count as absent.  Equal names: the
    smallest id.  Equal similarity: the smallest id.
    """
    said = cut_lineage(values.select(F.col("value").cast("string").alias("value")).where("value is not null and value rlike '\\\\S'").distinct())
    known = entries.where("id is not null and name is not null").select("id", "name", "alias", words_of(F.col("name")).alias("words"), words_of(F.coalesce("core", "name")).alias("core"))
    typed = said.select("value", words_of(F.col("value")).alias("words"))
    some = known.select("id", "words", "core").limit(most_entries + 1).collect()
    if len(some) <= most_entries:
        # few bytes but much work a value: as many tasks as the number of values asks for, not as their bytes do
        typed = typed.repartition(max(1, -(-said.count() // task_values)))
        matched = _match_here(typed, [(r["id"], r["words"], r["core"]) for r in some], threshold, sure)
    else:
        matched = _match_shuffled(typed, known, threshold, sure)
    same = known.groupBy("name").agg(F.min("id").alias("same_id"))
    short = known.where("alias is not null").groupBy(alias_of(F.col("alias")).alias("short")).agg(F.min("id").alias("alias_id")).where("short <> ''")
    return (
        said.join(same, F.col("value") == F.col("name"), "left")
        .join(short, alias_of(F.col("value")) == F.col("short"), "left")
        .join(matched, "value", "left")
        .select(
            "value",
            F.coalesce("same_id", "alias_id", "canon_id", F.lit(-1)).alias("canon_id"),
            F.when(F.coalesce("same_id", "alias_id").isNotNull(), 1.0).otherwise(F.col("similarity")).alias("similarity"),
        )
    )
