"""Packing: ids as the tokenizer gives them, gapless windows, the choice against all choices."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexispark.llm import packing
from lexispark.llm.queries import VOCABULARY, op12_packing

PATH = pytest.importorskip("public_tokenizers").path(VOCABULARY)
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.asarray(TOKENIZER.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_are_the_tokenizers_own():
    encode, rng = packing.Encoder(PATH), random.Random(1)
    signs = "aàÀÉßİŸ'sStTrevmldLD 0129½²ªºµ.,!?*$\"()\t\n\xa0\x85\x1c​́ǅʼnΣσςあ漢٣😀-_<|>·\xad\x00\x7fɐ"
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 14))) for _ in range(20_000)]
    texts += [f"{a}{chr(c)}{b}" for c in range(0x600) for a, b in (("", ""), ("a", "b"), ("1'", "S"))]
    texts += ["", "<|endoftext|> a <|startoftext|>", "It's the dog's, they'LL 've", "x" * 5000, "word " * 5000]
    for text in texts:
        assert encode(text) == ids_of(text), repr(text)
    assert encode(None) == b""


def test_full_tables_start_anew(monkeypatch):
    monkeypatch.setattr(packing, "RUNS", 3)
    monkeypatch.setattr(packing, "WORDS", 2)
    encode, text = packing.Encoder(PATH), "one Two three, four; five six's seven"
    assert encode(text) == encode(text) == ids_of(text) and len(encode.runs) <= 3


def test_the_choice_is_the_best_of_all():
    rng = random.Random(2)
    for _ in range(300):
        lengths = sorted(rng.choices(range(1, 60), k=rng.randint(1, 9)), reverse=True)
        capacity = rng.randint(1, 120)
        best, taken = packing.fullest([(n, lengths.count(n)) for n in sorted(set(lengths), reverse=True)], capacity)
        first = next((n for n in lengths if n <= capacity), None)
        sums = {sum(c) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if sum(c) <= capacity and (first is None or first in c)}
        assert best == max(sums, default=0)
        assert sum(n * c for n, c in taken) == best and all(c <= lengths.count(n) for n, c in taken)


def check(rows, texts, capacity):
    """Pieces cover documents and sequences without a gap; only powers of two are shorter than the capacity."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        want, at = ids_of(texts[i]) + b"\2\0\0\0", 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want) // 4
            assert r.ids_crc32 == zlib.crc32(want[4 * at : 4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(want)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    return by_doc


def packed(df, **more):
    from pyspark.sql import functions as F

    return packing.pack(df, lambda: packing.worker_encoder(PATH), **more).withColumn("ids_crc32", F.crc32("ids")).collect()


def test_pieces_and_sequences(spark):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choices(["alpha", "beta", "x", "y.", "gamma,"], k=rng.choice([0, 1, 5, 40, 90, 400, 3000]))) for i in range(300)} | {900: None, 901: "", 902: "long " * 60_000}
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in texts.items()], "doc_id long, text string, start int, ids string").repartition(3)
    for capacity, pool in ((128, 16), (100, 64), (4096, 1024)):
        by_doc = check(packed(df, capacity=capacity, pool_pieces=pool), texts, capacity)
        cut = sum(len(p) > -(-p[0].doc_tokens // capacity) for p in by_doc.values())
        assert cut < 60  # most documents are cut at whole windows only


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    rows = packed(df.coalesce(1))
    assert sorted((r.doc_id or 0, r.length) for r in rows if r.start == 0) and sum(r.length for r in rows) == 3 + 3 + 2 + 1
    assert packed(spark.createDataFrame([], "doc_id long, text string")) == []


def test_query_against_the_tokenizer(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    check(op12_packing(spark, sf).collect(), texts, 4096)
