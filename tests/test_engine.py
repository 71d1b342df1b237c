"""Hand cases of the retrieval engine."""

import hashlib
import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import porter, text
from lexispark.functions.text import Analyzer
from lexispark.operators import boolean, evaluation, features, index, learning, ranking, reports, scoring, workflow
from lexispark.sources import collection, sinks

NONE = Analyzer(stop=())


def docs(spark, titles):
    return spark.createDataFrame([(i + 1, t, "", "", "") for i, t in enumerate(titles)], "docid long, title string, author string, bibliography string, body string")


def topics(spark, *queries):
    return spark.createDataFrame([(i + 1, q) for i, q in enumerate(queries)], "qid long, query string")


def one(df):
    return df.first()[0]


def test_normalize(spark):
    df = spark.createDataFrame([("Kite's don'ts x'sy O'S café-12",)], "t string")
    assert one(df.select(text.normalize(F.col("t")))) == ["kite", "don", "ts", "x", "sy", "o", "caf", "12"]
    assert one(df.select(text.clean_topic(F.lit(" A-bé (c)! ")))) == "a bé c"
    assert one(df.select(text.first_term(F.lit("--- x")))) == "x" and one(df.select(text.first_term(F.lit("..")))) == ""
    with pytest.raises(ValueError):
        Analyzer(stemmer="other")


def test_porter(spark):
    words = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "triplicate": "triplic", "adjustment": "adjust", "adoption": "adopt", "rate": "rate", "controll": "control", "at": "at", "sky": "sky"}
    df = spark.createDataFrame([(w,) for w in words], "term string")
    assert dict(porter.stem(df).collect()) == words
    every = spark.createDataFrame([(w,) for w in ("agreement", "element", "statement")], "term string")
    assert sorted(r.stem for r in porter.stem(every, stemmer="porter_all").collect()) == ["agreem", "elem", "statem"]
    assert sorted(r.stem for r in porter.stem(every).collect()) == ["agreement", "element", "statement"]


def test_boolean(spark):
    d = docs(spark, ["kite rope", "kites", "rope", "red rope"])
    tf = index.build(d.withColumn("body", F.col("title")), Analyzer(possessive=True, stemmer="porter_all"), ("body",)).tf
    q = spark.createDataFrame([(1, "Kites and ROPE"), (2, "kite OR red"), (3, "a b"), (4, "kite AND kite"), (5, "none AND rope")], "query_id long, query string")
    got = {r.query_id: (r.op, r.docids) for r in boolean.search(tf, q).collect()}
    assert got == {1: ("AND", [1]), 2: ("OR", [1, 2, 4]), 4: ("AND", [1, 2]), 5: ("AND", [])}
    assert [r.query_id for r in boolean.rejected(q).collect()] == [3]


def test_features_follow_their_definitions(spark):
    """Every feature against plain Python over three titles and a topic of three terms, one of them twice and one absent."""
    titles = ["amber delta amber amber koala", "delta oboe", "koala koala oboe oboe", ""]
    query = "amber amber koala zebra"
    idx = index.build(docs(spark, titles), NONE)
    got = {r.docid: r for r in features.field_features(idx, "title", topics(spark, query)).collect()}
    words = {i + 1: t.split() for i, t in enumerate(titles)}
    n, mean_len = len(titles), sum(map(len, words.values())) / len(titles)
    df = lambda t: sum(t in w for w in words.values())
    idf = lambda t: math.log((n + 1) / (df(t) + 1)) + 1
    distinct = sorted(set(query.split()))
    assert sorted(got) == [1, 3]
    for d, r in got.items():
        w = words[d]
        tf = [w.count(t) for t in distinct]
        hits = [t for t in distinct if t in w]
        moments = lambda x: (sum(x), min(x), max(x), sum(x) / len(x), sum(v * v for v in x) / len(x) - (sum(x) / len(x)) ** 2)
        for name, x in (("tf", tf), ("normalized_tf", [v / len(w) for v in tf]), ("tfidf", [v * idf(t) for v, t in zip(tf, distinct, strict=True)])):
            assert tuple(r[f"{name}_{m}"] for m in ("sum", "min", "max", "mean", "variance")) == pytest.approx(moments(x))
        assert (r.query_term_number, r.query_term_ratio, r.stream_length, r.boolean) == (len(hits), pytest.approx(len(hits) / 3), len(w), 1)
        assert r.idf == pytest.approx(sum(map(idf, hits)))
        sat = lambda c: c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean_len))
        assert r.bm25 == pytest.approx(sum(math.log(1 + (n - df(t) + 0.5) / (df(t) + 0.5)) * sat(w.count(t)) for t in hits))
        of_doc = {t: (1 + math.log(w.count(t))) * idf(t) for t in set(w)}
        of_topic = {t: (1 + math.log(query.split().count(t))) * idf(t) for t in distinct if df(t)}
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        cosine = sum(of_doc[t] * of_topic[t] for t in hits) / (norm(of_doc) * norm(of_topic))
        assert r.vector_space == pytest.approx(cosine)
    same = {x.docid: x.score for x in scoring.score(idx.field("title"), topics(spark, query), "cosine").collect()}
    assert same == pytest.approx({d: r.vector_space for d, r in got.items()})
    assert features.field_features(idx, "title", topics(spark, "?!")).count() == 0
    vector = {r.docid: r.features for r in features.feature_vectors(idx, topics(spark, query)).collect()}
    bare = {r.docid: r.features for r in features.bare_features(idx).collect()}
    at = features.feature_names().index("title.stream_length")
    assert [bare[d][at] for d in (1, 2, 3, 4)] == [5, 2, 4, 0] and all(sum(bare[d]) == bare[d][at] for d in bare)
    assert sorted(vector) == [1, 3] and all(len(v) == 88 for v in vector.values())


def test_zone_shares_and_the_filled_ranking(spark):
    d = docs(spark, ["lynx otter", "heron", "otter otter otter heron", "", "mole"])
    t = topics(spark, "otter heron lynx vole", "newt", "mole")
    z = scoring.zones(index.build(d, NONE), t)
    assert {(r.qid, r.docid): r.title for r in z.collect()} == {(1, 1): 0.5, (1, 2): 0.25, (1, 3): 0.5, (3, 5): 1.0}
    run = ranking.padded(scoring.weighted(z, (0.8, 0, 0, 0.2)), d, t, 4)
    # Equal shares go by id; what matches nowhere follows by id, and a topic without a match has the lowest ids.
    assert {q: [r.docid for r in sorted(run.filter(F.col("qid") == q).collect(), key=lambda r: r["rank"])] for q in (1, 2, 3)} == {1: [1, 3, 2, 4], 2: [1, 2, 3, 4], 3: [5, 1, 2, 3]}
    assert all(r.ok for r in ranking.run_faults(run, 4).collect())
    assert not ranking.run_faults(run.filter("rank <> 2"), 4).first().ok


def test_measures_follow_their_definitions(spark):
    """Measures of three random runs against plain Python; equal scores go by id."""
    rng = random.Random(31)
    rows = [(q, d, round(rng.random() * 4) / 2) for q in (1, 2, 3) for d in rng.sample(range(50), 30)]
    labels = {(q, d): rng.randint(1, 4) for q in (1, 2) for d in rng.sample(range(50), 12)}
    run = ranking.rank(spark.createDataFrame(rows, "qid long, docid long, score double").orderBy(F.rand(3)))
    j = spark.createDataFrame([(q, d, v) for (q, d), v in labels.items()], "qid long, docid long, label int")
    t = topics(spark, "a", "b", "c")
    prf = {(r.qid, r.k): (r.precision, r.recall, r.f1) for r in evaluation.prf(run, j, t, (5, 20)).collect()}
    ms = {r.qid: r for r in evaluation.measures(run, j, t).collect()}
    for q in (1, 2, 3):
        order = [d for _, d, s in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))]
        gains, relevant = [labels.get((q, d), 0) for d in order], sum(1 for x, _ in labels if x == q)
        for k in (5, 20):
            hits = sum(g > 0 for g in gains[:k])
            p, r = hits / k, hits / relevant if relevant else 0
            assert prf[q, k] == pytest.approx((p, r, 2 * p * r / (p + r) if hits else 0))
        at = [i + 1 for i, g in enumerate(gains) if g]
        assert ms[q].AP == pytest.approx(sum((n + 1) / i for n, i in enumerate(at)) / relevant if relevant else 0)
        assert ms[q].RR == pytest.approx(1 / at[0] if at else 0)
        dcg = lambda v: sum(g / math.log2(i + 2) for i, g in enumerate(v[:10]))
        ideal = dcg(sorted((v for (x, _), v in labels.items() if x == q), reverse=True))
        assert ms[q]["nDCG@10"] == pytest.approx(dcg(gains) / ideal if ideal else 0)
    lines = ranking.run_lines(ranking.rank(run.filter("qid = 2").drop("rank"), 2), "lex", 3, spark.createDataFrame([(2, "T-17")], "qid long, original_id string"))
    best = sorted((r for r in rows if r[0] == 2), key=lambda r: (-r[2], r[1]))[:2]
    assert [r.line for r in lines.orderBy("rank").collect()] == [f"T-17 Q0 {d} {i + 1} {s:.3f} lex" for i, (_, d, s) in enumerate(best)]
    for k in (0, -3):
        with pytest.raises(ValueError):
            ranking.rank(run, k)


def test_tests_of_significance():
    assert evaluation.sign_test(67, 37) == pytest.approx(0.0042, abs=1e-4)
    assert evaluation.t_test(2.228, 11) == pytest.approx(0.05, abs=1e-4)
    assert evaluation.t_test(0.0, 11) == pytest.approx(1.0) and evaluation.t_test(-2.228, 11) == pytest.approx(0.05, abs=1e-4)


def test_split_and_grid(spark):
    s = {r.qid: r.split for r in learning.seeded_split(spark, list(range(10, 33)), 7).collect()}
    # Floors of three and four fifths of 23, in the order that the seed gives.
    order = [10 + int(i) for i in np.random.default_rng(7).permutation(23)]
    assert [s[q] for q in order] == ["train"] * 13 + ["validation"] * 5 + ["test"] * 5
    assert s == {r.qid: r.split for r in learning.seeded_split(spark, list(range(10, 33)), 7).collect()}
    assert s != {r.qid: r.split for r in learning.seeded_split(spark, list(range(10, 33)), 8).collect()}
    with pytest.raises(ValueError):
        learning.seeded_split(spark, [1, 2])
    g = learning.simplex(spark, 4).collect()
    assert len(g) == math.comb(7, 3) and all(abs(r.a + r.b + r.c + r.d - 1) < 1e-9 for r in g) and len({(r.a, r.b, r.c) for r in g}) == len(g)
    best = learning.first_best(spark.createDataFrame([(2, 0.5), (1, 0.5), (0, 0.1)], "g long, f1 double")).first()
    assert best.g == 1


def pairs(spark, n=140):
    """Feature rows of which the first number decides the label, and none of the rest matters."""
    rng = random.Random(41)
    return [(i % 7 + 1, i, [rng.gauss(2.0 if i % 4 == 0 else 0.0, 0.6), rng.random() * 100, 5.0], int(i % 4 == 0)) for i in range(n)]


def test_linear_ranker(spark, tmp_path):
    rows = pairs(spark)
    df = spark.createDataFrame(rows, "qid long, docid long, features array<double>, label int")
    j = df.filter("label = 1").select("qid", "docid", "label")
    labelled = learning.labelled(df.drop("label"), j)
    assert {r.label: round(r.w, 6) for r in labelled.groupBy("label").agg(F.sum("weight").alias("w")).collect()} == {0.0: 70.0, 1.0: 70.0}
    (weak, strong) = learning.fit_svms(labelled, (0.001, 10.0))
    scores = {r.docid: r.score for r in learning.linear_scores(df, *weak).collect()}
    assert sum((scores[i] > 0) == bool(y) for _, i, _, y in rows) / len(rows) > 0.9
    assert abs(strong[0][0]) < abs(weak[0][0]) / 5 and weak[0][2] == 0.0  # the penalty, and a feature without spread
    again = learning.fit_svms(labelled.repartition(5), (0.001,))[0]
    assert again[0] == pytest.approx(weak[0], rel=1e-3, abs=1e-6)  # however rows are dealt out
    with pytest.raises(RuntimeError, match="convergence"):
        learning.fit_svms(labelled, (0.001,), rounds=1)
    # Against the objective itself: no small step improves it.
    x = np.array([r[2] for r in rows])
    mean, std = x.mean(0), x.std(0)
    z = np.hstack([(x - mean) / np.where(std > 0, std, 1), np.ones((len(x), 1))])
    y = np.array([2 * r[3] - 1 for r in rows])
    w = np.where(y > 0, 140 / (2 * 35), 140 / (2 * 105))

    def cost(v):
        gap = np.maximum(1 - y * (z @ v), 0)
        return (w * np.where(gap < 0.1, gap**2 / 0.2, gap - 0.05)).mean() + 0.0005 * (v[:-1] ** 2).sum()

    v = np.append(np.array(weak[0]) * std, weak[1] + np.array(weak[0]) @ mean)
    assert all(cost(v) <= cost(v + d * e) + 1e-7 for d in (0.01, -0.01) for e in np.eye(4))
    learning.save_bundle(spark, str(tmp_path / "m"), *weak, (1, 0, 0, 0), {"alpha": 0.001})
    found = learning.load_bundle(spark, str(tmp_path / "m"))
    assert found["weights"] == weak[0] and found["intercept"] == weak[1]
    sinks.write_json(spark, found | {"version": "old"}, str(tmp_path / "old"))
    with pytest.raises(ValueError):
        learning.load_bundle(spark, str(tmp_path / "old"))
    with pytest.raises(ValueError):
        learning.labelled(df.drop("label"), df.filter("false").select("qid", "docid", "label"))


def test_pairs_without_a_match_count(spark):
    """Training sees every pair of topic and document, and rankings hold every document."""
    t = topics(spark, "a", "b", "c")
    v = spark.createDataFrame([(1, 1, [1.0, 3.0]), (1, 2, [1.0, 4.0]), (2, 1, [1.0, 3.0])], "qid long, docid long, features array<double>")
    bare = spark.createDataFrame([(d, [0.0, float(d + 2)]) for d in (1, 2, 3)], "docid long, features array<double>")
    j = spark.createDataFrame([(1, 1, 2), (3, 3, 1), (9, 1, 1)], "qid long, docid long, label int")
    rest = sorted((r.features[1], r.label, r.n) for r in learning.unmatched(v, bare, j, t).collect())
    assert rest == [(3.0, 0.0, 1), (4.0, 0.0, 2), (5.0, 0.0, 2), (5.0, 1.0, 1)]
    both = learning.labelled(v, j, learning.unmatched(v, bare, j, t)).groupBy("label").agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).collect()
    assert {r.label: (r.n, round(r.w, 9)) for r in both} == {0.0: (7, 4.5), 1.0: (2, 4.5)}
    rng = random.Random(43)
    scores = [(q, d, rng.random()) for q in (1, 2, 3) for d in range(0, 60, q)]
    low = [(d, 1 - d / 100) for d in range(60)]
    got = learning.rank_all(spark.createDataFrame(scores, "qid long, docid long, score double"), spark.createDataFrame(low, "docid long, score double"), t, 3)
    for q in (1, 2, 3):
        all_ = {d: s for d, s in low} | {d: s for x, d, s in scores if x == q}
        assert [r.docid for r in sorted(got.filter(F.col("qid") == q).collect(), key=lambda r: r["rank"])] == sorted(all_, key=lambda d: (-round(all_[d], 9), d))[:3]


TAGGED = ".I 7\n.T\non kites\nand wind\n.A\nq. maker\n.B\npaper 12\n.W\nkites rise\n.B\nis no tag here\n.W\nthey fall\n.I 3\n.W\nonly a body\n.I 12\n.T\n.W\n"


def test_readers(spark, tmp_path):
    (tmp_path / "c").write_text(TAGGED)
    d = {r.docid: r for r in collection.read_collection(spark, str(tmp_path / "c")).collect()}
    assert sorted(d) == [3, 7, 12]
    assert tuple(d[7][f] for f in index.FIELDS) == ("on kites and wind", "q. maker", "paper 12", "kites rise is no tag here they fall")
    assert tuple(d[3][f] for f in index.FIELDS) == ("", "", "", "only a body") and tuple(d[12][f] for f in index.FIELDS) == ("", "", "", "")
    (tmp_path / "dup").write_text(TAGGED + ".I 3\n.T\nlater\n.W\nanother\n")
    with pytest.raises(ValueError):
        collection.read_collection(spark, str(tmp_path / "dup"))
    last = collection.read_collection(spark, str(tmp_path / "dup"), duplicates="last")
    assert last.filter("docid = 3").first().title == "later" and last.count() == 3
    assert collection.read_collection(spark, str(tmp_path / "dup"), duplicates="keep").count() == 4
    (tmp_path / "q").write_text(".I 040\n.W\nhow do\nkites fly\n.I 011\n.W\nrope\n")
    assert [tuple(r) for r in collection.read_topics(spark, str(tmp_path / "q")).orderBy("qid").collect()] == [(1, "040", "how do kites fly"), (2, "011", "rope")]
    codes = [1, 2, 3, 4, 5, -1]
    (tmp_path / "j").write_text("".join(f"{q} {10 * q + c} {c} \n" for q in (4, 6) for c in codes) + "8 2\n")
    assert sorted(tuple(r) for r in collection.read_graded(spark, str(tmp_path / "j")).collect()) == sorted((q, 10 * q + c, 5 - c) for q in (4, 6) for c in (1, 2, 3, 4))
    assert sorted(tuple(r) for r in collection.read_binary(spark, str(tmp_path / "j")).collect()) == sorted((q, 10 * q + c, int(1 <= c <= 4)) for q in (4, 6) for c in codes)
    (tmp_path / "bad").write_text("4 1 7\n")
    with pytest.raises(ValueError):
        collection.read_binary(spark, str(tmp_path / "bad"))
    (tmp_path / "s").write_text("Of\r\nwon't\n\nof\n")
    assert collection.read_stop(spark, str(tmp_path / "s")) == ("of", "t", "won")
    (tmp_path / "b").write_text("\n kite AND rope \n\nwind OR x\n")
    assert [tuple(r) for r in collection.read_queries(spark, str(tmp_path / "b")).collect()] == [(1, "kite AND rope"), (2, "wind OR x")]
    (tmp_path / "cfg").write_text('{"depth": 50}')
    assert collection.read_config(spark, str(tmp_path / "cfg"), {"depth": 10, "model": "tf"}) == {"depth": 50, "model": "tf"}
    (tmp_path / "run").write_text("5 Q0 1 1 0.5 x\n5 Q0 2 1\n")
    with pytest.raises(Exception, match="not a run line"):
        collection.read_run(spark, str(tmp_path / "run")).collect()


def test_written_answers_and_tables(spark, tmp_path):
    d = docs(spark, ["kite rope", "kites", "rope"])
    tf = index.build(d.withColumn("body", F.col("title")), Analyzer(possessive=True, stemmer="porter_all"), ("body",)).tf
    q = spark.createDataFrame([(1, " kite AND rope"), (2, "one two"), (3, "wind or rope")], "query_id long, query string")
    assert sinks.write_answers(boolean.search(tf, q), str(tmp_path / "a"))
    text_ = "\n".join(r.value for r in spark.read.text(str(tmp_path / "a"), wholetext=True).collect())
    assert text_.strip() == "Query: kite AND rope\nStemmed query: kite AND rope\nMatched documents: 1\n1\n\nQuery: wind or rope\nStemmed query: wind OR rope\nMatched documents: 2\n1 3"
    assert not sinks.write_answers(boolean.search(tf, q.filter("query_id = 2")), str(tmp_path / "a"))
    assert "Query: kite AND rope" in spark.read.text(str(tmp_path / "a"), wholetext=True).first().value  # left as it was
    t = spark.createDataFrame([("x", 0.5), ("y", None)], "name string, value double")
    sinks.write_csv(t, str(tmp_path / "t"))
    assert sorted(map(str, collection.read_table(spark, str(tmp_path / "t"), "name string, value double").collect())) == sorted(map(str, t.collect()))
    sinks.write_json(spark, {"a": [1, 2]}, str(tmp_path / "j"))
    assert collection.read_json(spark, str(tmp_path / "j")) == {"a": [1, 2]}
    assert sinks.markdown(spark.range(150).withColumn("v", F.lit(0.5)).coalesce(1)).count("\n") == 151


def test_lookup_reads_few_row_groups(spark, tmp_path):
    words = [f"w{i:05d}" for i in range(6000)]
    d = docs(spark, [" ".join(words[i : i + 60]) for i in range(0, 6000, 20)])
    idx = index.build(d, NONE)
    idx.save(str(tmp_path / "i"))
    hit = index.lookup(spark, str(tmp_path / "i"), "title", ["w00100", "nowhere"])
    assert sorted((r.term, r.docid, r.tf) for r in hit.collect()) == [("w00100", i, 1) for i in (4, 5, 6)]
    assert "In(term" in hit._jdf.queryExecution().executedPlan().toString() or "EqualTo(term" in hit._jdf.queryExecution().executedPlan().toString()


def test_reports(spark):
    t = spark.createDataFrame([("bm25(k_1=1.2, b=0.75)", "p", 0.4), ("bm25(k_1=3.0, b=0.1)", "p", 0.4), ("tf", "r", 0.1), ("tf_x", "r", 0.3)], "name string, kind string, ap double")
    assert [r.name for r in reports.by_metric(t, "ap").orderBy("place").collect()] == ["bm25(k_1=1.2, b=0.75)", "bm25(k_1=3.0, b=0.1)", "tf_x", "tf"]
    assert {r.kind: (r.settings, round(r.spread, 9), r.best) for r in reports.spread(t, "kind", "ap").collect()} == {"p": (2, 0.0, "bm25(k_1=1.2, b=0.75)"), "r": (2, 0.2, "tf_x")}
    assert [r.name for r in reports.within(reports.named(t, "bm25"), (1, 2), (0.5, 1)).collect()] == ["bm25(k_1=1.2, b=0.75)"]
    assert reports.beside(t.filter("kind = 'r'"), t).columns == ["name", "kind", "ap", "kind_2", "ap_2"]
    assert [r.change for r in reports.change(t.filter("name = 'tf'").withColumn("old", F.lit(0.2)), "old", "ap").collect()] == ["-50.0%"]
    w = spark.createDataFrame([("a", 0.1), ("b", -3.0), ("c", 3.0), ("d", 0.0)], "feature string, weight double")
    assert [r.feature for r in reports.largest(w, 3).collect()] == ["b", "c", "a"]
    assert w.select(reports.digest(F.lit(None).cast("string"))).first()[0] == hashlib.sha256(b"").hexdigest()
    rows, seconds, each = reports.timed(lambda: t, 4)
    assert rows == 4 and each == pytest.approx(seconds * 250)


def test_train_predict_and_verify(spark, tmp_path):
    """A whole run: train, write a bundle, predict unseen topics, write the run and verify it from the file."""
    rng = random.Random(47)
    names = [f"n{i}" for i in range(12)]
    titles = [" ".join(rng.sample(names, 3)) for _ in range(60)]
    d = docs(spark, titles).withColumn("body", F.concat_ws(" ", "title", F.lit("and more words")))
    q = topics(spark, *names)
    j = spark.createDataFrame([(i + 1, k + 1, 1) for i, n in enumerate(names) for k, t in enumerate(titles) if n in t.split()], "qid long, docid long, label int")
    idx = index.build(d, NONE)
    split = spark.createDataFrame([(i, "train" if i < 8 else "validation" if i < 10 else "test") for i in range(1, 13)], "qid long, split string")
    got = workflow.train(idx, q, j, split, str(tmp_path / "m"), alphas=(0.01, 1.0))
    assert [a for a, _ in got.trials] == [0.01, 1.0] and got.alpha in (0.01, 1.0) and len(got.deployed[0]) == 88
    assert abs(sum(got.zone) - 1) < 1e-9 and got.metrics.filter("k = 5").first().precision == 1.0
    with pytest.raises(ValueError):
        workflow.train(idx, q, j, split.filter("qid > 1"))
    unseen = spark.createDataFrame([(1, "n3"), (2, "nobody")], "qid long, query string")
    run = workflow.predict(spark, str(tmp_path / "m"), idx, unseen, 60)
    assert run.groupBy("qid").count().filter("count = 60").count() == 2
    has = [i + 1 for i, t in enumerate(titles) if "n3" in t.split()]
    assert sorted(r.docid for r in run.filter(F.col("rank") <= len(has)).filter("qid = 1").collect()) == has
    labels = q.select("qid", F.format_string("L%02d", "qid").alias("original_id"))
    full = ranking.rank(scoring.score(idx.field("title"), q, "tf"), 5)
    sinks.write_run(ranking.run_lines(full, "t", 9, labels), str(tmp_path / "r"))
    reported = evaluation.macro(evaluation.prf(full, j, q), "k")
    workflow.verify_run(spark, str(tmp_path / "r"), labels, j, q, reported, str(tmp_path / "r"))
    with pytest.raises(ValueError, match="measures"):
        workflow.verify_run(spark, str(tmp_path / "r"), labels, j, q, reported.withColumn("recall", F.col("recall") / 2))
    sinks.write_run(ranking.run_lines(ranking.rank(scoring.score(idx.field("title"), q, "tf").withColumn("score", F.col("docid").cast("double")), 5), "t", 9, labels), str(tmp_path / "s"))
    with pytest.raises(ValueError, match="differ"):
        workflow.verify_run(spark, str(tmp_path / "r"), labels, j, q, reported, str(tmp_path / "s"))


def test_preprocess_a_file(spark, tmp_path):
    (tmp_path / "c").write_text(TAGGED)
    workflow.preprocess(spark, str(tmp_path / "c"), str(tmp_path / "p"), ("on", "and", "a"))
    got = {r.docid: r.tokens for r in collection.read_processed(spark, str(tmp_path / "p")).collect()}
    assert got == {7: ["kite", "wind", "kite", "rise", "is", "no", "tag", "here", "thei", "fall"], 3: ["onli", "bodi"], 12: []}


def test_index_file_round_trip(spark, tmp_path):
    tf = index.build(docs(spark, ["b a", "a", ""]).withColumn("body", F.col("title")), NONE, ("body",)).tf
    sinks.write_index(tf, str(tmp_path / "i"))
    assert sorted(tuple(r) for r in collection.read_index(spark, str(tmp_path / "i")).collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert sinks.index_lines(tf).orderBy("kind", "term").first().line == "2, 2"
    p = spark.createDataFrame([(2, ["x", "y"]), (1, [])], "docid long, tokens array<string>")
    sinks.write_processed(p, str(tmp_path / "p"))
    got = {r.docid: r.tokens for r in collection.read_processed(spark, str(tmp_path / "p")).collect()}
    assert got[2] == ["x", "y"] and got[1] == []
    idx = index.build(docs(spark, ["kite", "rope"]), NONE)
    idx.save(str(tmp_path / "idx"))
    assert index.Index.load(spark, str(tmp_path / "idx"), NONE).df.count() == 2


def test_index_lines_are_taken_apart_once(spark, tmp_path):
    """No id carries its line, or a term's line would be split again for each of its documents."""
    (tmp_path / "i").write_text("2, 9\na " + ",".join(map(str, range(1, 10))) + "\nb 7\n")
    found = collection.read_index(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, found.collect())) == [("a", i) for i in range(1, 10)] + [("b", 7)]
    above, below = found._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")
    assert "value#" not in above and "split(value#" in below


def test_judgement_checks(spark):
    t, d = topics(spark, "a"), docs(spark, ["x"])
    good = spark.createDataFrame([(1, 1, 1)], "qid long, docid long, label int")
    evaluation.check_judgements(good, t, d)
    for bad in ([(2, 1, 1)], [(1, 9, 1)]):
        with pytest.raises(ValueError):
            evaluation.check_judgements(spark.createDataFrame(bad, "qid long, docid long, label int"), t, d)


def test_entry_works_without_the_optional_package():
    """In a process where the package and the pipeline are not found."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:2] == ['lexispark', 'llm'] or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'rank_top10' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=120)
