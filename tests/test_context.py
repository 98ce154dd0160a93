"""Neighbour context against the rule written out."""

from tessera.operators.sequence import neighbour_context


def context(before, own, after, most):
    joined = " ".join(filter(None, (before, own, after)))
    if len(joined) > most:
        room = max(most - len(own) - 2, 0)
        left = before[len(before) - min(room // 2, len(before)) :]
        joined = " ".join(filter(None, (left, own, after[: room - len(left)])))
    return joined or " "


def test_own_text_stays_whole_and_neighbours_are_trimmed(spark):
    long = lambda c, n: "".join(f"{c}{i}," for i in range(n))[:n]
    texts = [long("a", 500), long("b", 300), long("c", 20), long("d", 695), long("e", 698), long("f", 699), long("g", 900), "x", None, " \t ", "y ", long("h", 130), long("i", 130), long("j", 130), None, None, None]
    df = spark.createDataFrame([("p", n, t) for n, t in enumerate(texts)] + [("q", 0, "alone")], "p string, n int, t string")
    got = {(r["p"], r["n"]): r["context"] for r in neighbour_context(df, "p", ["n"], "t").collect()}
    plain = ["", *((t or "").strip() for t in texts), ""]
    want = {("p", n): context(*plain[n : n + 3], 700) for n in range(len(texts))} | {("q", 0): "alone"}
    assert got == want
    assert all((t or "").strip() in got["p", n] for n, t in enumerate(texts))
    assert all(len(c) <= 700 or c == texts[n] for (_, n), c in got.items())


def test_stretches_cut_nothing(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(5)
    df = spark.createDataFrame([(r.choice(["p", "q", None]), r.choice([None, *range(50)]) if i % 9 else i, i, f"t{i}" if i % 7 else None) for i in range(200)], "p string, n int, i int, t string")
    whole = neighbour_context(df, "p", ["n", "i"], "t")
    for width in (1, 7, 1000):
        assert sorted(map(repr, neighbour_context(df, "p", ["n", "i"], "t", place=F.floor(F.col("n") / width)).collect())) == sorted(map(repr, whole.collect()))


def test_smoothing_over_stretches_is_smoothing_over_the_whole(spark):
    import random

    from pyspark.sql import functions as F

    from tessera.operators.sequence import smooth_islands

    r = random.Random(6)
    df = spark.createDataFrame([(r.choice(["p", "q", None]), float(i), i, float(i + 1), r.choice(["a", "a", "a", "b", None])) for i in range(250)], "e string, s double, i int, t double, v string")
    whole = sorted(map(repr, smooth_islands(df, "e", ["s", "i"], "v", "s", "t", 2, 2.0).select("i", "smoothed").collect()))
    assert len(whole) == 250  # rows without an entity form one sequence
    for width in (1, 9, 1000):
        got = smooth_islands(df, "e", ["s", "i"], "v", "s", "t", 2, 2.0, place=F.floor(F.col("s") / width))
        assert sorted(map(repr, got.select("i", "smoothed").collect())) == whole
