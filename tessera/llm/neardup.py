"""Near-duplicate records by sequential Bayesian verification of banded candidates.

Method.  A text's words are its longest runs of a-z and 0-9 in lower case, its
features the triples of consecutive words.  Minhash signatures are cut into
bands; texts that agree on a band are candidates.  A candidate pair's
signatures are compared batch by batch, and it is given up as soon as the
posterior probability (uniform prior) that its similarity reaches the threshold
falls below the chosen miss probability; the survivors' similarity is computed
exactly.

Scale.  Texts of equal words form one class, named by a 64-bit hash of them
that is checked to be theirs alone, so copies need no pass of their own and each
task sends a class once.  What is shuffled is a band key and an id per band,
then a byte per hash of the candidates, then the texts of survivors.  A band
key of more than ``most`` classes gives no pairs; its classes are joined exactly
instead, on the rarest of their features (prefix and length filter).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.meet import meet, with_sides
from tessera.session import cut_lineage, written_table

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def word_text(text: Column) -> Column:
    """The words of a text, parted by one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def triples(words: str) -> set[tuple[str, str, str]]:
    w = words.split(" ")
    return set(zip(w, w[1:], w[2:], strict=False))


def least_matches(threshold: float, miss: float, batch: int, total: int) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on): fewer leave P(similarity >= threshold) under ``miss``.

    With a uniform prior the posterior after m of n matches is Beta(m + 1,
    n - m + 1), whose upper tail is that of a binomial of n + 1 trials.
    """
    out = []
    for n in [*range(batch, total, batch), total]:
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


class _Signer:
    """Features and minhash signatures of word texts, a batch at a time."""

    def __init__(self, hashes: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 32, hashes, dtype=np.uint32)[:, None] | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)[:, None]

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the triples of all texts in a row, how many each text has); repeats within a text stay."""
        import xxhash

        split = pc.split_pattern(texts, " ")
        sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = split.flatten().dictionary_encode()
        table = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
        c = table[words.indices.to_numpy(zero_copy_only=False)]
        h = c[:-2] * _M1 + c[1:-1] * _M2 + c[2:] * _M3
        h ^= h >> np.uint64(32)
        h *= _M2
        h ^= h >> np.uint64(29)
        inside = np.ones(len(c), bool)  # no triple across two texts
        ends = np.cumsum(sizes)
        for back in (1, 2):
            inside[ends[sizes >= back] - back] = False
        return h[inside[: len(h)]], np.maximum(sizes - 2, 0)

    def __call__(self, texts: pa.Array, strip: int = 8192) -> np.ndarray:
        """A row of 16-bit hashes per text."""
        h, sizes = self.features(texts)
        h = (h >> np.uint64(32)).astype(np.uint32)
        low = np.full((len(texts), len(self.a)), np.iinfo(np.uint32).max, np.uint32)
        ends = np.cumsum(sizes)
        some = np.flatnonzero(sizes)
        at = 0
        while at < len(some):  # whole texts, in strips that fit the cache
            start = int(ends[some[at]] - sizes[some[at]])
            to = max(at + 1, int(np.searchsorted(ends[some], start + strip, "right")))
            rows, stop = some[at:to], int(ends[some[to - 1]])
            if to == at + 1:
                for i in range(start, stop, strip):
                    np.minimum(low[rows[0]], (self.a * h[i : min(i + strip, stop)] + self.b).min(axis=1), out=low[rows[0]])
            else:
                low[rows] = np.minimum.reduceat(self.a * h[start:stop] + self.b, ends[rows] - sizes[rows] - start, axis=1).T
            at = to
        return low.astype("<u2")


def _signature(hashes: int, least_words: int):
    """Words -> their signature, two bytes a hash; null for texts of fewer words."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        signer = _Signer(hashes)
        for texts in batches:
            enough = pc.fill_null(pc.greater_equal(pc.count_substring(texts, " "), least_words - 1), False).to_pylist()
            yield pa.array([row.tobytes() if e else None for row, e in zip(signer(texts), enough, strict=True)], pa.binary())

    return run.asNondeterministic()  # lest a filter on it be pushed before it and have it worked out twice


class _Once:
    """Which rows hold an id not met before in this task, as far as ``most`` ids are kept in mind."""

    def __init__(self, most: int = 1_000_000):
        self.seen: set[int] = set()
        self.most = most

    def __call__(self, ids: pa.Array) -> pa.Array:
        if len(self.seen) > self.most:
            self.seen.clear()
        keep = []
        for i, x in enumerate(ids.to_pylist()):
            if x not in self.seen:
                self.seen.add(x)
                keep.append(i)
        return pa.array(keep, pa.int64())


def _bands(bands: int, rows: int):
    """A key per band of a signature: id, salt, signature -> mark, doc_id; copies within a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, once = np.random.default_rng(5).integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1), _Once()
        for batch in batches:
            batch = batch.take(once(batch.column(0)))
            if not batch.num_rows:
                continue
            signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(-1, bands, rows)
            keys = (signatures.astype(np.uint64) * mixer).sum(axis=2, dtype=np.uint64)
            keys += (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * _M3
            keys ^= batch.column("salt").to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
            keys ^= keys >> np.uint64(31)
            keys *= _M1
            keys ^= keys >> np.uint64(30)
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["mark", "doc_id"])

    return run


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The low byte of every hash: id, signature -> id, short."""
    once = _Once()
    for batch in batches:
        batch = batch.take(once(batch.column(0)))
        if batch.num_rows:
            low = [x[::2] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.binary())], names=["id", "short"])


def _texts_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once = _Once()
    for batch in batches:
        batch = batch.take(once(batch.column(0)))
        if batch.num_rows:
            yield batch


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signer = _Signer(1)
    for batch in batches:
        if batch.num_rows:
            h, sizes = signer.features(batch.column(batch.schema.get_field_index("words")))
            found = [np.unique(x).view(np.int64) for x in np.split(h, np.cumsum(sizes)[:-1])]
            sizes = np.array([len(f) for f in found], np.int32)
            ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))], names=["id", "n", "features"])


def _prune(limits: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
            for n, least in limits:
                matches = matches + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
                going = matches >= least
                alive, matches, done = alive[going], matches[going], n
                if not len(alive):
                    break
            if len(alive):
                keep = pa.array(alive)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, known = [], {}
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x, y = (known[i] if i in known else known.setdefault(i, triples(t)) for i, t in ((a, x), (b, y)))
                both = len(x & y)
                either = len(x) + len(y) - both
                if either and both >= threshold * either - 1e-9:
                    rows.append((a, b, both / either))
                if len(known) > 2_000:
                    known.clear()
            if rows:
                a, b, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    return run


def _hot_pairs(classes: DataFrame, hot: DataFrame, threshold: float) -> DataFrame:
    """Pairs of hot classes that could reach the threshold: they share one of their rarest features."""
    wide = classes.join(hot, "id", "left_semi").mapInArrow(_features, "id bigint, n int, features array<bigint>")
    each = cut_lineage(wide.select("id", "n", F.explode("features").alias("feature")))
    common = each.groupBy("feature").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(common, "feature", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    ranked = ranked.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "feature"))).alias("f"))
    prefix = F.slice("f", 1, (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int"))
    rare = ranked.select("id", "n", F.explode(prefix).alias("p")).where("p.df > 1").select("id", "n", F.col("p.feature").alias("feature"))
    x, y = rare.select(F.col("id").alias("a"), F.col("n").alias("na"), "feature"), rare.select(F.col("id").alias("b"), F.col("n").alias("nb"), "feature")
    near = (F.col("na") >= F.col("nb") * threshold - 1e-9) & (F.col("nb") >= F.col("na") * threshold - 1e-9)
    return x.join(y, "feature").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def class_id(*columns: str | Column) -> Column:
    """The 64-bit name of a class of equal texts."""
    return F.xxhash64(*columns)


def _named_apart(said: DataFrame) -> DataFrame:
    """``said`` with another id where two classes share one by chance (expected once in some 10**19 pairs)."""
    for turn in range(1, 9):
        shared = said.groupBy("id").agg(F.min(F.xxhash64("words", F.lit(turn))).alias("x"), F.max(F.xxhash64("words", F.lit(turn))).alias("y"), F.min("salt").alias("s"), F.max("salt").alias("t"))
        shared = cut_lineage(shared.where("x <> y or s <> t").select(F.col("id").alias("shared")))
        if shared.isEmpty():
            return said
        said = written_table(said.join(shared, F.col("id") == F.col("shared"), "left").withColumn("id", F.when(F.col("shared").isNull(), F.col("id")).otherwise(F.xxhash64("words", "salt", F.lit(-turn)))).drop("shared"))
    raise RuntimeError("classes of texts could not be told apart")


class NearDuplicates:
    """Records whose texts are alike.

    ``df`` has tbl, key and text, one row per record; records are compared
    within a tbl.  Texts under ``least_words`` words, null and empty ones take
    no part.  Rows with a null key take part as any other and come out with it;
    repeated keys are each a record.

    ``members``: tbl, key, id (its class of equal words).  ``links``: a < b (class
    ids) and their exact similarity >= ``threshold``.
    """

    def __init__(self, df: DataFrame, threshold: float = 0.7, least_words: int = 20, bands: int = 28, rows: int = 4, miss: float = 1e-5, batch: int = 28, most: int = 64):
        said = df.select("tbl", "key", word_text(F.col("text")).alias("words")).withColumn("signature", _signature(bands * rows, least_words)("words")).where("signature is not null")
        said = _named_apart(written_table(said.select("tbl", "key", class_id("tbl", "words").alias("id"), F.xxhash64("tbl").alias("salt"), "words", "signature")))
        marks = said.select("id", "salt", "signature").mapInArrow(_bands(bands, rows), "mark bigint, doc_id bigint")
        met = written_table(meet(marks, most))
        candidates = met.where("b is not null").select("a", "b").distinct()
        short = said.select("id", "signature").mapInArrow(_bytes_of, "id bigint, short binary").dropDuplicates(["id"])
        pruned = with_sides(candidates, short, "short").mapInArrow(_prune(least_matches(threshold, miss, batch, bands * rows)), "a bigint, b bigint")
        texts = said.select("id", "words").mapInArrow(_texts_once, "id bigint, words string").dropDuplicates(["id"])
        hot = met.where("b is null").select(F.col("a").alias("id")).distinct()
        if not hot.isEmpty():
            salts = said.select("id", "salt").distinct()
            exact = _hot_pairs(texts, hot, threshold).join(salts.withColumnsRenamed({"id": "a", "salt": "sa"}), "a").join(salts.withColumnsRenamed({"id": "b", "salt": "sb"}), "b")
            pruned = pruned.unionByName(exact.where("sa = sb").select("a", "b")).distinct()
        self.links = cut_lineage(with_sides(pruned, texts, "words").mapInArrow(_verify(threshold), "a bigint, b bigint, similarity double"))
        self.members = said.select("tbl", "key", "id")

    def pairs(self) -> DataFrame:
        """tbl, key_a < key_b of all pairs of records alike, copies expanded."""
        members = cut_lineage(self.members)
        a, b = (members.select("tbl", F.col("key").alias(f"key_{s}"), F.col("id").alias(s)) for s in "ab")
        linked = self.links.select("a", "b").join(a, "a").join(b.drop("tbl"), "b").select("tbl", "key_a", "key_b")
        twins = members.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
        twin = members.join(twins, "id")
        same = twin.select("tbl", F.col("key").alias("key_a"), "id").join(twin.select(F.col("key").alias("key_b"), "id"), "id").where("key_a < key_b").select("tbl", "key_a", "key_b")
        out = linked.unionByName(same)
        return out.select("tbl", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).where("key_a < key_b").distinct()

    def groups(self) -> DataFrame:
        """tbl, key, group_id, group_size, n_links of every record with a like; n_links counts linked classes of other words."""
        members = cut_lineage(self.members)
        ends = self.links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
        placed = members.join(components(self.links), "id", "left").join(ends, "id", "left").select("tbl", "key", F.coalesce("component", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
        sizes = placed.groupBy("group_id").agg(F.count("*").alias("group_size"), F.min("key").alias("first_key")).where("group_size > 1")
        return placed.join(sizes, "group_id").select("tbl", "key", F.col("first_key").alias("group_id"), "group_size", "n_links")
