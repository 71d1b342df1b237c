"""The n-gram join against brute force, and the pipeline's stages on a small corpus."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lexispark.llm import mixing, ngramjoin

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingle_set(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids, root, links = sorted(sets), {i: i for i in sets}, Counter()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {i: (top(i), links[i]) for i in ids}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [256, 7])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngramjoin, "BLOCK_ROWS", block)
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        texts += family(rng, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(150)), 25, 7)
    texts += [None, "", "...", "one", "One!", "a b c", "A b, c", "é ñ", "x " * 3000, "x " * 4000] + ["copy me please now or later"] * 20
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*r, "k", 1, "t") for r in rows], "doc_id long, text string, key string, tree int, rid string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.ngram_join(df).collect()}
    assert got == brute(rows)


def test_repeated_and_null_ids_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (1, long), (1, "quite another text of many words here"), (None, long), (2, long + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id)) for r in ngramjoin.ngram_join(df).collect())
    assert got == [("1", "1"), ("1", "1"), ("1", "1"), ("2", "1"), ("None", "None")]
    assert ngramjoin.ngram_join(df.limit(0)).count() == 0


def chain(rng, n, size, step):
    """Texts of which each shares most words with the next, and ever fewer with those behind."""
    words = [f"c{rng.randint(0, 10**6)}" for _ in range(size + n * step)]
    return [" ".join(words[i * step : i * step + size]) for i in range(n)]


def test_chains_and_tight_groups_lose_no_link(spark, monkeypatch):
    """Members stop at different prefixes, and blocks meet at every level."""
    monkeypatch.setattr(ngramjoin, "BLOCK_ROWS", 5)
    rng = random.Random(21)
    base = " ".join(f"t{rng.randint(0, 10**6)}" for _ in range(400))
    texts = family(rng, base, 60, 3) + chain(rng, 40, 120, 5) + family(rng, base[: len(base) // 4], 30, 6)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.ngram_join(df).collect()} == brute(rows)


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError, match="integers"):
        ngramjoin.ngram_join(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_recall_and_pieces():
    f = ngramjoin.Forest()
    assert f.recall(0.8, f.length(0.8, 0.9995)) >= 0.9995 and f.recall(0.8, f.length(0.8, 0.9995) + 1) < 0.9995
    text = ("Ab cé 12, x-y " * 50).encode()
    whole, _ = ngramjoin.word_hashes(np.frombuffer(text, np.uint8))
    assert len(whole) == 250 and len(set(whole.tolist())) == 5
    long = np.concatenate(list(ngramjoin._long(np.frombuffer(text, np.uint8))))
    assert (long == whole).all()


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    line = lambda n: " ".join(rng.choice(["river", "stone", "green", "paper", "window", "slow", "north", "table", "music", "garden"]) + str(rng.randint(0, 60)) for _ in range(n))
    items = [(i, line(30)) for i in range(3)]
    docs, labels = [], []
    for i in range(240):
        t, toxic = line(60), i % 6 == 0
        docs.append([i, t + (" grimbo snarkel grimbo" if toxic else ""), "en", f"s{i % 3}", 0])
        labels.append((i, 1, int(toxic)))
    docs[10][1], docs[11][1], docs[13][1] = docs[9][1], docs[9][1] + " tail", docs[13][1] + " " + items[0][1]
    docs += [[500, None, "en", None, 0], [501, "", "en", "s1", 0]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        at = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append(at.columns if name == "sharding" else sorted(r[0] for r in at.select("doc_id").collect()))
        if name != "sharding":
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = sorted(d[0] for d in docs if d[0] % 6 or d[0] >= 240)
    assert kept[0] == clean
    assert kept[1] == [i for i in clean if i not in (10, 11)]
    assert kept[2] == [i for i in kept[1] if i != 13]
    assert set(kept[3]) <= set(kept[2]) and max(Counter(kept[3]).values()) <= 3
    assert {"shard", "depth", "shard_bytes"} <= set(kept[4])


def test_without_judges_rows_by_one_plan(spark):
    docs = spark.createDataFrame([(1, "a", 10), (1, "b", 11), (2, "a", 12), (None, "c", 13), (3, None, 14)], "doc_id long, text string, row0 long")
    gone = spark.createDataFrame([(11,), (13,), (99,)], "row0 long")
    left = corpus_pipeline.without(docs, "row0", gone)
    assert sorted(map(str, left.collect())) == sorted(["Row(doc_id=1, text='a')", "Row(doc_id=2, text='a')", "Row(doc_id=3, text=None)"])
    assert "ShuffledHashJoin" in left._jdf.queryExecution().sparkPlan().toString()


def test_mixing_stage_repeats_as_the_operator_says(spark):
    """Rows without an id are taken as often as the mix says, too."""
    rng = random.Random(10)
    docs = spark.createDataFrame([(i if i % 9 else None, "w " * rng.randint(0, 40), "en", f"s{i % 4}" if i % 5 else None, 0) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.size] += r.copies
    out = corpus_pipeline.mix_sources(spark, docs, "")
    assert out.columns == docs.columns
    assert Counter((r.doc_id, len(r.text.split())) for r in out.collect()) == +want
    assert any(n > 1 for (i, _), n in want.items() if i is None)


@pytest.mark.parametrize("on_disk", [True, False])
def test_stages_judge_rows_and_not_ids(spark, tmp_path, on_disk):
    rng = random.Random(12)
    text = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(8)]
    spark.createDataFrame([(1, text[7])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(0, text[0]), (1, text[1]), (1, text[0]), (2, text[2]), (2, text[2]), (None, text[2]), (None, text[3]), (None, text[3]), (3, text[4]), (3, text[4] + " " + text[7]), (None, text[5] + " " + text[7]), (None, text[6]), (4, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    if on_disk:
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    count = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    one = corpus_pipeline.keep_one_of_each_class(spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    assert count(one) == Counter(rows) - Counter([(1, text[0]), (2, text[2]), (None, text[2]), (None, text[3])])
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert count(clean) == Counter(r for r in rows if text[7] not in (r[1] or ""))


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, row0 int, n0 int, key string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and set(none.columns) <= set(out.columns), name


def test_mixing_stage_repeats_each_row_of_an_id_on_its_own(spark):
    docs = spark.createDataFrame([(i // 3, "w " * (i % 40), "en", f"s{i % 4}", 0) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.size] += r.copies
    got = Counter((r.doc_id, len(r.text.split())) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert got == +want


def test_stages_with_clashing_names(spark, tmp_path):
    """Names that the stages might use for themselves, in a table of several files."""
    rng = random.Random(13)
    text = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(30)]
    spark.createDataFrame([(1, text[7])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["file_path", "file", "file0", "name0", "row0", "n0", "row_index", "key", "shard", "FILE1", "copies"]
    rows = [(i, t, "en", f"s{i % 3}", 0, *names) for i, t in enumerate([*text, text[3], text[4]])]
    at = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names]).repartition(3)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at.write.parquet(f"{tmp_path}/in{k}")
        at = stage(spark, spark.read.parquet(f"{tmp_path}/in{k}"), str(tmp_path))
        if name != "sharding":
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
            assert all(tuple(r)[5:] == tuple(names) for r in at.collect())
        if name == "near_duplicates":
            assert at.filter("doc_id >= 30").count() == 0 and at.count() >= 28
        if name == "decontamination":
            assert at.filter("doc_id = 7").count() == 0


def test_rows_of_many_files_have_numbers_of_their_own(spark, tmp_path):
    spark.range(1000).selectExpr("id AS doc_id", "'t' AS text").repartition(17).write.parquet(f"{tmp_path}/t")
    rows, row = corpus_pipeline.numbered(spark.read.parquet(f"{tmp_path}/t"))
    first, again = (dict(rows.select("doc_id", row).collect()) for _ in range(2))
    assert first == again and len(set(first.values())) == 1000
