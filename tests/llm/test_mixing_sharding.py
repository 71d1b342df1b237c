"""Mixing and sharding: targets, copies, limits, odd input."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexispark.llm import mixing, sharding


def targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_targets_and_copies(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "é", None, "z", "tiny"] if i % 9 else ["tiny"])) for i in range(900)]
    rows = [r if r[2] != "tiny" else (r[0], "w", "tiny") for r in rows] + [(1, None, "empty"), (2, None, "empty"), (None, "x y", "a")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, source string, size int, rank string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, biggest = Counter(), Counter(), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * biggest[s]
    assert taken["tiny"] == 3 * sizes["tiny"] and taken["empty"] == 0
    again = mixing.mix(df.repartition(7)).select("doc_id", "source", "size", "taken")
    assert sorted(map(str, again.collect())) == sorted(map(str, mixing.mix(df).select("doc_id", "source", "size", "taken").collect()))


def test_mix_of_an_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def shards(df, limit):
    return sharding.shard(df, limit=limit)


def test_shards_fit_and_cover(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(0, 200), "k", 3) for i in range(700)] + [(7, "same" * 50, "k", 3)] * 30 + [(8, "y" * 5000, "k", 3), (9, None, "k", 3), (None, "z", "k", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, cell int")
    got = shards(df, 2000).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for name, some in by.items():
        total = sum(r.bytes for r in some)
        assert {(r.shard_bytes, r.shard_docs, r.depth) for r in some} == {(total, len(some), len(name))}
        assert total <= 2000 or len({(r.doc_id, r.text) for r in some}) == 1
    names = sorted(by)
    assert not any(b.startswith(a) for a in names for b in names if a != b)
    sums = {n: sum(r.bytes for r in some) for n, some in by.items()}
    for n in names:  # only oversized buckets are split
        assert not n or sum(v for m, v in sums.items() if m.startswith(n[:-1])) > 2000


def test_sharding_deep_and_empty(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", 1)
    df = spark.createDataFrame([(i, "x" * 10) for i in range(64)], "doc_id long, text string")
    assert {r.shard_bytes for r in shards(df, 10).collect()} == {10}
    assert shards(df.limit(0), 10).count() == 0
    assert {(r.shard, r.depth) for r in shards(df, 10**6).collect()} == {("", 0)}
    assert shards(df, 10).agg(F.count_distinct("shard")).first()[0] == 64


def test_mix_of_rows_without_an_id_and_very_long_texts(spark):
    """Rows without an id are dealt over parts like others, and reruns agree on which are taken."""
    rng = random.Random(8)
    rows = [(None, " ".join(rng.choices(["a", "b", "c"], k=30)), "s") for _ in range(400)] + [(1, "w " * 400_000, "t"), (2, "w", "t"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    take = lambda d: sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(d).collect())
    assert take(df) == take(df.repartition(5))
    texts = lambda d: Counter({t: n for t, n in mixing.mix(d, row_col="row").join(d, "row").groupBy("text").agg(F.sum("copies")).collect() if t and len(t) < 100})
    one = df.withColumn("row", F.monotonically_increasing_id())
    assert texts(one) == texts(one.repartition(3))
    got = mixing.mix(df).collect()
    assert {r.size for r in got if r.source == "t"} == {400_000, 1} and [r.taken for r in got if r.source is None] == [0]
