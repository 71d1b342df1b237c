"""Spelling variants against every pair of words, blocks of full shards, odd input."""

import random
import re
import zlib
from collections import Counter

from lexispark.llm import spelling
from lexispark.llm.queries import op11_spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda v: (-counts[v], v))
            if counts[best] >= 2 * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form.get(w), counts.get(form.get(w)), root(w)) for w, n in counts.items()}


def counted(rows, damage=None):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += len(run) >= 5
    return {w: n for w, n in out.items() if n >= 3}


def columns(df):
    return {tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()}


def test_variants_and_blocks(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("aáb") for _ in range(rng.randint(5, 8))): rng.choice([3, 4, 6, 9, 20, 50]) for _ in range(500)} | {"aaaaa": 3, "aaaaaa": 3, "ççççç": 90}
    df = spark.createDataFrame([(w, n, "k") for w, n in words.items()], "word string, n long, form string")
    want = brute(words)
    assert sum(r[3] is not None for r in want) > 50 and any(r[3] != r[5] for r in want if r[3])
    assert columns(spelling.variants(df)) == want
    # One shard whose words need many blocks loses no pair and finds none twice.
    assert columns(spelling.variants(df, shard_words=40)) == want


def test_each_pair_comes_once(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(300)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    found = Counter((r.a, r.b) for r in spelling.near_pairs(df, 50).collect())
    assert set(found.values()) == {1}
    assert set(found) == {(a, b) for a in words for b in words if one_edit(a, b) and (len(a), a) < (len(b), b)}


def test_texts_with_nulls_long_ones_and_repeats(spark):
    rng = random.Random(5)
    pool = ["receive", "recieve", "recive", "Ärger", "ärger", "naïve", "naive", "naives", "the", "shop", "straße", "strasse", "ÀÉÎÕÜ"]
    rows = [(i, " ".join(rng.choices(pool, k=40)) + "×a÷b12receive3") for i in range(60)] + [(None, "receive naive " * 30), (3, None), (4, ""), (5, "recieve " * 50_000), (5, "recieve " * 50)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n int, word string")
    for damage in (None, 7):
        assert columns(spelling.spelling_variants(df, damage=damage)) == brute(counted(rows, damage))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(empty).collect() == []
    few = spark.createDataFrame([(1, "once only"), (2, None)], "doc_id long, text string")
    assert spelling.spelling_variants(few).collect() == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counts, got = counted(rows, 97), columns(op11_spelling(spark, sf))
    assert {r[:2] for r in got} == set(counts.items())
    some = random.Random(1).sample(sorted(counts), 40)
    by = {r[0]: r for r in got}
    for w in some:
        near = [v for v in counts if v != w and one_edit(v, w)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 2 * counts[w] else None
        assert by[w][2:5] == (len(near), form, counts.get(form))


def test_a_chain_is_followed_to_its_end(spark):
    words = {"aaaaaaaaaaaaaaaaaaaaaaaa"[: 5 + i]: 3 * 2**i for i in range(19)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = columns(spelling.variants(df))
    assert {r[5] for r in got} == {"a" * 23} and {r[0]: r[3] for r in got}["aaaaa"] == "aaaaaa"
