"""Exact dedup and decontamination against brute force, with nulls, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from lexispark.llm import common, decontam, dedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, kept string, row int, w string, digest int"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA)


def test_dedup_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Abc", "aBC", "ÄB", "äb", "", None, "x" * 50_000, f"t{i}"])) for i in range(300)] + [(5, "abc"), (5, "abc"), (None, "ABC")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    want = sorted((str(i), max(x for x in groups[low(t)] if x is not None), len(groups[low(t)]), i == max(x for x in groups[low(t)] if x is not None), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows)
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept, r.text_sha256) for r in dedup.exact_dedup(docs(spark, rows), salts=3).collect())
    assert got == want


def test_dedup_empty_and_all_null_ids(spark):
    assert dedup.exact_dedup(docs(spark, [])).count() == 0
    assert [(r.keep_id, r.group_size, r.kept) for r in dedup.exact_dedup(docs(spark, [(None, None), (None, "")])).collect()] == [(None, 2, False)] * 2


def brute(rows, items):
    wins = defaultdict(set)
    for item, t in items:
        w = WORD.findall(low(t))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[i : i + n])].add(item)
    out = []
    for i, t in rows:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        ids = sorted(map(str, found))
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("most", [common.BROADCAST_BYTES, -1])
def test_decontamination_matches_brute_force(spark, monkeypatch, most):
    """With fingerprints joined in the scan, and with a benchmark too large for that."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    rng = random.Random(2)
    word = lambda: rng.choice(["aa", "b", "cc", "ñd", "E", "7"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 8, 12, 13, 14, 20, 40])] + [(77, None), (78, "..."), (5, "aa b cc")]
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100 + i, f"pre. {t!s} post, {t!s}") for i, (_, t) in enumerate(items)] + [(1, None), (1, None), (2, ""), (None, items[8][1].upper())]
    rows.append((500, " ".join(word() for _ in range(300)) + " " + items[8][1]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(docs(spark, rows), bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute(rows, items)


def test_decontamination_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "CHUNK", 16)
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    items = [(1, " ".join(words[5:50])), (2, " ".join(words[100:113])), (3, " ".join(words[150:155]))]
    rows = [(1, " ".join(words)), (2, " ".join(words[10:]))]
    got = decontam.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute(rows, items)


def test_decontamination_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontam.decontaminate(docs(spark, [(1, "a b"), (2, None)]), none).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got) == [(1, 2, 0, False), (2, 0, 0, False)]
    assert decontam.decontaminate(docs(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.29, 0.05, 1 / 3])
def test_share_is_exact(spark, share):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = [(n, "a b c" + " x" * (n - 3)) for n in range(3, 70)]
    got = {r.doc_id: r.contaminated for r in decontam.decontaminate(docs(spark, rows), bench, share=share).collect()}
    assert got == {n: 3 >= Fraction(str(share)) * n for n, _ in rows}


def test_rows_without_a_print_have_keys_of_their_own(spark, monkeypatch):
    """Beyond the broadcast bound, rows without a fingerprint or window meet in no task, and a print in every row is salted."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rows = spark.createDataFrame([(i, i % 7, None if i % 3 else 5, 0, i) for i in range(3000)], "row long, base long, fp long, pos int, n int")
    prints = common.stored(spark.createDataFrame([(5, "a"), (5, "b"), (6, "c")], "fp long, win string"), "prints")
    out = decontam.print_join(rows, prints)
    assert out.filter("win is null").count() == 2000 and out.filter("win is not null").count() == 2000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "at fp" in plan and "salt" in plan
    keys = rows.select(decontam.F.when(decontam.F.col("fp").isNull(), decontam.F.xxhash64("row", "base")).alias("k")).filter("k is not null").distinct().count()
    assert keys == 2000
