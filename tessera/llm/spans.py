"""Long verbatim spans shared between documents, by relative Lempel-Ziv parsing.

Method.  Documents are factored greedily against indexed reference blocks.  A
block is a run of reference documents with an index of the grams of half the
wanted length at all their places.  From each place of a document that the block
holds, the longest match becomes a factor, and parsing goes on at its end.  At
factor boundaries, and within factors as often as a wanted stretch could slip
through, every place of the block that holds the gram there is extended both
ways; what reaches the wanted length is a duplicate span.

A document needs to be factored only against blocks that could hold a factor of
the wanted length, and then it shares a mark with a document of the block (see
:mod:`tessera.llm.grams`): the least hashes of all its stretches.  So the marks
are the index that tells which documents visit which blocks, and no other block
could add a span.

Scale.  Marks of a few dozen bytes per document are shuffled once, texts only
of documents that share a mark: once per block they stand in or visit, and
documents that share marks with one another stand in one block.  A block has at
most ``block_docs`` reference documents and ``block_visits`` visits, so a
document that a third of all others quote is indexed in many tasks.  Marks are
read as a sorted stream.  A mark of more than ``most`` documents (a recurring
footer, say) would give a square of pairs that mostly share nothing longer; for
those documents every stretch of the wanted length around the mark is hashed
instead, equal stretches form classes, and each document is factored against its
class's first document.  Factoring compares characters, so it also proves the
classes; documents that a chance hash put into one are set apart and classed
again.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.grams import codes_of, gram_hashes, marks_of
from tessera.llm.meet import meet
from tessera.session import written_table


def _common(a: str, i: int, b: str, j: int, most: int) -> int:
    """Length, at most ``most``, of the common beginning of a[i:] and b[j:]."""
    have, step, grow = 0, 64, True
    while have < most:
        s = min(step, most - have)
        if a[i + have : i + have + s] == b[j + have : j + have + s]:
            have += s
            step = s * 2 if grow else step
        elif s == 1:
            break
        else:
            grow, step = False, s // 2
    return have


class Block:
    """Reference documents with an index of all their grams."""

    def __init__(self, docs: list[tuple[int, str]], least: int):
        self.least, self.gram = least, max(1, least // 2)
        self.ids = [d for d, _ in docs]  # rising
        sizes = np.array([len(t) for _, t in docs], np.int64)
        ends = np.cumsum(sizes)
        self.starts, self.ends = (ends - sizes).tolist(), ends.tolist()
        self.text = "".join(t for _, t in docs)
        self.back = self.text[::-1]
        hashes = gram_hashes(codes_of(self.text), self.gram)
        at = np.arange(len(hashes))
        inside = at + self.gram <= np.repeat(ends, sizes)[: len(at)]  # no gram across two documents
        hashes, at = hashes[inside], at[inside]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], at[order]

    def parse(self, doc: int, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """(the factors of ``text`` as place and length; the spans as reference document, start there, start in ``text``, length).

        Only reference documents of a smaller id than ``doc`` count.
        """
        limit = self.starts[k] if (k := bisect_right(self.ids, doc - 1)) < len(self.ids) else len(self.text)
        q, n = self.gram, len(text)
        hashes = gram_hashes(codes_of(text), q)
        if not limit or not len(hashes) or not len(self.hashes):
            return [], []
        first = np.searchsorted(self.hashes, hashes)
        known = np.minimum(first, len(self.hashes) - 1)
        hits = np.flatnonzero((self.hashes[known] == hashes) & (self.places[known] < limit)).tolist()
        stride, back = self.least - q + 1, text[::-1]
        factors, spans, reached = [], [], {}  # reached: by diagonal, how far the text is known to run with the block
        h, at, end = 0, 0, 0
        while h < len(hits):
            if hits[h] < at:
                h = bisect_right(hits, at - 1, h)
                continue
            i = hits[h]
            places = self.places[first[i] : np.searchsorted(self.hashes, hashes[i], "right")]
            furthest = 0
            for j in places[: np.searchsorted(places, limit)].tolist():
                to = reached.get(j - i, 0)
                if to < i + q:
                    if text[i : i + q] != self.text[j : j + q]:
                        continue
                    k = bisect_right(self.starts, j) - 1
                    right = q + _common(text, i + q, self.text, j + q, min(n - i, self.ends[k] - j) - q)
                    left = _common(back, n - i, self.back, len(self.text) - j, min(i, j - self.starts[k]))
                    to = reached[j - i] = i + right
                    if left + right >= self.least:
                        spans.append((self.ids[k], j - left - self.starts[k], i - left, left + right))
                furthest = max(furthest, to)
            if furthest and i >= end:
                factors.append((i, furthest - i))
            end = max(end, furthest)
            at = min(i + stride, max(i + 1, end - q + 1))
        return factors, spans


def _marks(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for owner, marks in marks_of(batch.column(1).to_pylist(), least):
                yield pa.RecordBatch.from_arrays([pa.array(marks), pa.array(ids[owner])], names=["mark", "doc_id"])

    return run


def stretch_hashes(codes: np.ndarray, least: int) -> np.ndarray:
    """Hashes of all stretches of ``least`` characters."""
    return gram_hashes(codes, least).view(np.int64)


def _around(least: int):
    """Hashes of all stretches of ``least`` characters that hold one of a document's hot marks."""
    k = least // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, marks, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                codes = codes_of(text)
                hits = np.flatnonzero(np.isin(gram_hashes(codes, k).view(np.int64), np.array(marks, np.int64)))
                starts = np.unique((hits[:, None] - np.arange(least - k + 1)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(codes) - least)]
                if len(starts):
                    stretch = stretch_hashes(codes, least)[starts]
                    yield pa.RecordBatch.from_arrays([pa.array(stretch), pa.array(np.full(len(starts), doc)), pa.array(starts)], names=["stretch", "doc_id", "start"])

    return run


_SPANS = "doc_a bigint, doc_b bigint, start_a bigint, start_b bigint, length bigint"


def _visit(least: int):
    """Blocks as they come, reference documents before visitors -> spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, refs, both, block, last = None, [], [], None, None
        rows: list[tuple] = []

        def parse(doc, text):
            rows.extend((a, doc, x, y, n) for a, x, y, n in block.parse(doc, text)[1])

        def index():
            built = Block(refs, least)
            return built, [d for d in refs if d[0] in both]

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_a", "doc_b", "start_a", "start_b", "length"])
            rows.clear()
            return found

        for batch in batches:
            for label, part, turn, doc, ref, visit, text in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (label, part, turn) != place:
                    if refs and block is None:
                        block, own = index()
                        for d in own:
                            parse(*d)
                    place, refs, both, block, last = (label, part, turn), [], set(), None, None
                if doc == last:  # of repeated ids the first, greatest text counts
                    continue
                last = doc
                if ref:
                    refs.append((doc, text))
                    if visit:
                        both.add(doc)
                    continue
                if block is None:
                    block, own = index()
                    for d in own:
                        parse(*d)
                parse(doc, text)
                if len(rows) > 10_000:
                    yield out()
            if rows:
                yield out()
        if refs and block is None:
            block, own = index()
            for d in own:
                parse(*d)
        if rows:
            yield out()

    return run


def _factored(pairs: DataFrame, docs: DataFrame, least: int, block_docs: int, block_visits: int) -> DataFrame:
    """The spans of ``pairs`` (a, b, own): ``a`` stands in a block that ``b`` visits."""
    ends = pairs.where("not own").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"))
    labels = ends.groupBy(F.col("e.x").alias("x")).agg(F.min("e.y").alias("y")).select("x", F.least("x", "y").alias("label"))
    placed = pairs.select("a", "b").join(labels, F.col("a") == F.col("x"), "left").select("a", "b", F.coalesce("label", "a").alias("label"))
    sizes = placed.groupBy("label", "a").agg(F.count("*").alias("n")).groupBy("label").agg(F.count("*").alias("refs"), F.sum("n").alias("visits"))
    parts, turns = F.ceil(F.col("refs") / block_docs), F.ceil(F.col("visits") / F.ceil(F.col("refs") / block_docs) / block_visits)
    placed = placed.join(sizes, "label").select("a", "b", "label", F.pmod(F.xxhash64("a"), parts).alias("part"), F.pmod(F.xxhash64("b"), turns).alias("turn"))
    each = placed.select("label", "part", "turn", F.explode(F.array(F.struct(F.col("a").alias("doc"), F.lit(1).alias("ref"), F.lit(0).alias("visit")), F.struct(F.col("b").alias("doc"), F.lit(0).alias("ref"), F.lit(1).alias("visit")))).alias("e"))
    each = each.groupBy("label", "part", "turn", F.col("e.doc").alias("doc")).agg(F.max("e.ref").alias("ref"), F.max("e.visit").alias("visit"))
    rows = each.join(docs, F.col("doc") == F.col("doc_id")).select("label", "part", "turn", "doc", "ref", "visit", "text")
    rows = rows.repartition("label", "part", "turn").sortWithinPartitions("label", "part", "turn", F.desc("ref"), "doc", F.desc("text"))
    return rows.mapInArrow(_visit(least), _SPANS)


class SharedSpans:
    """The spans of at least ``least`` characters that documents share.

    ``df`` has a document id (bigint, unique; of repeated ids the greatest text
    counts, rows with a null id are left out as they can't be named) and a text.
    Null, empty and shorter texts share nothing.

    ``spans``: doc_a < doc_b, start_a, start_b, length, for every pair that
    shares a span, each stretch as long as it runs in both; of documents that
    meet only in hot marks, the pair with the first document of each class of
    equal stretches.  ``members``: stretch, doc_id, the documents of those
    classes.
    """

    def __init__(self, df: DataFrame, doc: str, text: str, least: int = 200, most: int = 32, block_docs: int = 64, block_visits: int = 512):
        docs = df.select(F.col(f"`{doc}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
        docs = docs.where(f"doc_id is not null and char_length(text) >= {least}")
        met = written_table(meet(docs.mapInArrow(_marks(least), "mark bigint, doc_id bigint"), most))
        pairs = met.where("b is not null").select("a", "b", F.lit(False).alias("own"))
        hot = met.where("b is null")
        self.members = None
        if hot.isEmpty():
            self.spans = written_table(_factored(pairs.distinct(), docs, least, block_docs, block_visits))
            return
        wanted = hot.groupBy(F.col("a").alias("doc_id")).agg(F.collect_set("mark").alias("marks"))
        rest = written_table(wanted.join(docs, "doc_id").select("doc_id", "marks", "text").mapInArrow(_around(least), "stretch bigint, doc_id bigint, start bigint"))
        turn = 0
        while True:
            classes = rest.groupBy("stretch").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
            classed = rest.join(classes.select("stretch", F.col("first.doc_id").alias("first"), F.col("first.start").alias("first_start")), "stretch")
            classed = written_table(classed.where("doc_id >= first"))
            wanted = classed.where("doc_id > first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"), F.lit(True).alias("own")).distinct()
            if turn == 0:  # one parse for both kinds of pairs
                wanted = pairs.unionByName(wanted).groupBy("a", "b").agg(F.min("own").alias("own"))
            found = written_table(_factored(wanted, docs, least, block_docs, block_visits))
            self.spans = found if turn == 0 else self.spans.unionByName(found).distinct()
            s = found.select("doc_a", F.col("doc_b"), "start_a", "start_b", "length")
            holds = (F.col("first") == F.col("doc_a")) & (F.col("doc_id") == F.col("doc_b")) & (F.col("start") - F.col("first_start") == F.col("start_b") - F.col("start_a"))
            holds = holds & (F.col("start") >= F.col("start_b")) & (F.col("start") + least <= F.col("start_b") + F.col("length"))
            named = F.concat_ws(" ", F.lit(turn), "stretch").alias("stretch")
            firsts = classed.select(named, F.col("first").alias("doc_id")).distinct()
            members = classed.where("doc_id > first").join(s, holds, "left_semi").select(named, "doc_id").distinct().unionByName(firsts)
            self.members = members if self.members is None else self.members.unionByName(members)
            rest = written_table(classed.where("doc_id > first").join(s, holds, "left_anti").select("stretch", "doc_id", "start"))
            if rest.isEmpty():
                break
            turn += 1
        self.members = written_table(self.members)

    def pairs(self) -> DataFrame:
        """All pairs doc_a < doc_b that share a span; members of a class are expanded, each set of members once."""
        found = self.spans.select("doc_a", "doc_b")
        if self.members is not None:
            members = self.members
            sets = members.groupBy("stretch").agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("x"))
            kept = members.join(sets.groupBy("n", "s", "x").agg(F.min("stretch").alias("stretch")).select("stretch"), "stretch")
            a, b = kept.withColumnRenamed("doc_id", "doc_a"), kept.withColumnRenamed("doc_id", "doc_b")
            found = found.unionByName(a.join(b, "stretch").where("doc_a < doc_b").select("doc_a", "doc_b"))
        return found.distinct()

    def coverage(self, df: DataFrame, doc: str, text: str) -> DataFrame:
        """doc_id, n_chars and shared_chars (characters that stand in another document too) of every document."""
        pieces = self.spans.select(F.explode(F.array(F.struct(F.col("doc_a").alias("doc_id"), F.col("start_a").alias("a"), F.col("length")), F.struct(F.col("doc_b").alias("doc_id"), F.col("start_b").alias("a"), F.col("length")))).alias("p"))
        pieces = pieces.groupBy(F.col("p.doc_id").alias("doc_id"), F.col("p.a").alias("a")).agg(F.max(F.col("p.a") + F.col("p.length")).alias("b"))
        order = Window.partitionBy("doc_id").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
        pieces = pieces.withColumn("covered", F.coalesce(F.max("b").over(order), F.lit(0)))
        shared = pieces.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest("a", "covered"))).alias("shared_chars"))
        sizes = df.where(F.col(f"`{doc}`").isNotNull()).groupBy(F.col(f"`{doc}`").cast("bigint").alias("doc_id")).agg(F.coalesce(F.max(F.char_length(F.col(f"`{text}`"))), F.lit(0)).cast("bigint").alias("n_chars"))
        return sizes.join(shared, "doc_id", "left").na.fill(0, ["shared_chars"])
