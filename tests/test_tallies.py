"""Counts where documents lie, against the same by joins and groups."""

import random

import pytest
from pyspark.sql import functions as F

from lexispark.functions.text import Analyzer
from lexispark.operators import features, index, learning, scoring, tallies


def made(spark, ids=range(1, 41), seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["the", "İx", "é", ""]
    say = lambda n: " ".join(r.choice(words) for _ in range(r.randrange(n)))
    rows = [(i, say(4), say(3), r.choice(["w1", None]), say(40)) for i in ids]
    docs = spark.createDataFrame(rows, "docid long, title string, author string, bibliography string, body string")
    topics = spark.createDataFrame([(i, say(12)) for i in range(1, 8)] + [(8, None), (9, "nowhere w2 w2")], "qid long, query string")
    return docs, topics


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("frequent", [3, 1000])
def test_features_in_rows(spark, monkeypatch, frequent):
    monkeypatch.setattr(tallies, "FREQUENT", frequent)
    docs, topics = made(spark)
    idx = index.build(docs, Analyzer())
    got = features.feature_vectors(idx, topics)
    assert exchanges(got) == 0  # pairs are neither shuffled nor stored
    got = {(r.qid, r.docid): r.features for r in got.collect()}
    monkeypatch.setattr(index.Index, "row_by_row", lambda *_: None)
    want = {(r.qid, r.docid): r.features for r in features.feature_vectors(idx, topics).collect()}
    assert len(want) > 100 and got.keys() == want.keys()
    assert all(v == pytest.approx(want[k], abs=1e-9) for k, v in got.items())


def test_feature_table_is_rounded_alike(spark, monkeypatch):
    docs, topics = made(spark, seed=5)
    idx = index.build(docs, Analyzer())
    got = sorted(map(tuple, features.feature_table(idx, topics, 6).collect()))
    one = sorted(map(tuple, features.field_features(idx, "body", topics).select("qid", "docid", F.round("bm25", 9)).collect()))
    monkeypatch.setattr(index.Index, "row_by_row", lambda *_: None)
    assert got == sorted(map(tuple, features.feature_table(idx, topics, 6).collect()))
    assert one == sorted(map(tuple, features.field_features(idx, "body", topics).select("qid", "docid", F.round("bm25", 9)).collect()))


@pytest.mark.parametrize("frequent", [3, 1000])
def test_features_of_a_field_are_read_once(spark, monkeypatch, frequent):
    """Documents' counts are not stored again; they and the weights of their rare terms are shuffled once, together."""
    from lexispark.sources import store

    monkeypatch.setattr(tallies, "FREQUENT", frequent)
    monkeypatch.setattr(features, "PAIRS", 40)  # some documents at once
    monkeypatch.setattr(store, "_written", [])
    docs, topics = made(spark, seed=9)
    idx = index.build(docs, Analyzer())
    found = features.field_features(idx, "body", topics, 6)
    assert sorted(p.rsplit("/", 1)[1].split("-")[0] for p in store._written) == ["frequencies", "tallies"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(docid") == 1
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, features.feature_table(idx, topics, 6, ("body",)).collect()))
    monkeypatch.setattr(index.Index, "row_by_row", lambda *_: None)
    assert len(got) > 100 and got == sorted(map(tuple, features.field_features(idx, "body", topics, 6).collect()))


@pytest.mark.parametrize(("most", "least"), [(0, [6, 3]), (1, [5, 3]), (2, [5, 2]), (3, [2, 1]), (9, [1, 1])])
def test_frequencies_that_tasks_look_up(spark, monkeypatch, most, least):
    monkeypatch.setattr(tallies, "FREQUENT", most)
    counts = [("a", "v", 5), ("a", "w", 2), ("a", "x", 2), ("a", "y", 1), ("a", "z", 1), ("a", None, 9), ("b", "v", 2), ("b", "w", 2), ("b", "x", 1)]
    assert tallies.often(spark.createDataFrame(counts, "field string, term string, df long"), ["a", "b"]) == least
    assert tallies.often(spark.createDataFrame([], "field string, term string, df long"), ["a"]) == [1]


def test_repeated_ids_are_merged_by_groups(spark):
    docs, topics = made(spark, [1, 2, 2, 3])
    idx = index.build(docs, Analyzer())
    assert idx.row_by_row() is None and tallies.tallied(idx, topics, index.FIELDS) is None
    assert features.feature_vectors(idx, topics).filter("docid = 2").count() > 0


def test_training_and_ranking_in_rows(spark):
    docs, topics = made(spark, seed=7)
    idx = index.build(docs, Analyzer())
    judged = spark.createDataFrame([(q, d, 1 + d % 3) for q in range(1, 10) for d in range(q, 40, 6)], "qid long, docid long, label int")
    v, bare = features.feature_vectors(idx, topics), features.bare_features(idx)
    pairs, rows = learning.in_rows(idx, topics, judged), learning.labelled(v, judged, learning.unmatched(v, bare, judged, topics))
    want = {r.label: (r.n, pytest.approx(r.w)) for r in rows.groupBy("label").agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).collect()}
    assert pairs.classes == want and sum(n for n, _ in want.values()) == 9 * 40
    for a, b in zip(learning.scaler(pairs), learning.scaler(rows), strict=True):
        assert a == pytest.approx(b, abs=1e-9)
    (a,), (b,) = learning.svm_path(pairs, (0.1,)), learning.svm_path(rows, (0.1,))
    assert a.weights == pytest.approx(b.weights, abs=1e-4) and a.primal == pytest.approx(b.primal, abs=2e-7)
    model = (a.weights, a.intercept)
    got = learning.rank_in_rows(idx, topics, [model, ([0.0] * len(a.weights), 1.0)], 12)
    want = learning.rank_all(learning.linear_scores(v, *model), learning.linear_scores(bare, *model), topics, 12)
    key = lambda df: sorted((r.qid, r["rank"], r.docid, round(r.score, 8)) for r in df.collect())
    assert key(got.filter("g = 0")) == key(want)
    assert {(r["rank"], r.docid) for r in got.filter("g = 1").collect()} == {(i, i) for i in range(1, 13)}


def test_matches_in_rows(spark, monkeypatch):
    docs, topics = made(spark, seed=11)
    idx = index.build(docs, Analyzer(), ("body",)).field("body")
    terms = scoring.topic_terms(topics, idx.analyzer)
    found = scoring.matches(idx, terms)
    plan = found.groupBy("qid", "docid").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "lowered" not in plan  # texts are not read again
    columns = ("qid", "docid", "term", "qtf", "tf", "df", "len", "n", "avg")
    rows = lambda df: sorted(tuple(r[c] for c in columns[:-1]) + (round(r["avg"], 9),) for r in df.collect())
    got = rows(found)
    monkeypatch.setattr(index.Index, "row_by_row", lambda *_: None)
    assert got == rows(scoring.matches(idx, terms)) and len(got) > 100


def test_means_in_rows(spark, monkeypatch):
    """Means of features are sums of tasks; norms, which send rare terms to their frequencies, are taken only if asked for."""
    docs, topics = made(spark)
    idx, names = index.build(docs, Analyzer()), ["title.bm25", "body.query_term_ratio", "author.stream_length"]
    want = features.feature_vectors(idx, topics).select(*(F.avg(F.col("features")[features.feature_names().index(n)]).alias(n) for n in [*names, "body.vector_space"])).first()
    for some in (names, [*names, "body.vector_space"]):
        got = {r.feature: r["mean"] for r in features.means(idx, topics, some).collect()}
        assert got == pytest.approx({n: want[n] for n in some})
    monkeypatch.setattr(tallies, "frequencies", None)
    assert {r.feature: r["mean"] for r in features.means(idx, topics, names).collect()} == pytest.approx({n: want[n] for n in names})
    assert [r["mean"] for r in features.means(idx, topics.withColumn("query", F.lit("nothinglikethis")), names).collect()] == [None] * 3


def test_shares_are_counted(spark, monkeypatch):
    docs, topics = made(spark)
    idx = index.build(docs.unionByName(docs.withColumn("docid", F.col("docid") + 100)), Analyzer())
    got = sorted(tuple(r) for r in scoring.alike(idx, topics).collect())
    monkeypatch.setattr(index.Index, "row_by_row", lambda *_: None)
    want = sorted(tuple(r) for r in scoring.alike(idx, topics).collect())
    assert len(got) > 50 and sum(r[-1] for r in got) > 2 * len(got) and got == want


@pytest.mark.parametrize("stemmer", ["none", "porter_all"])
def test_postings_in_rows(spark, tmp_path, stemmer):
    from lexispark.sources import sinks

    say = ["running runs the dog's", "The runs", "", "dogs dog 7", "ran running"]
    docs = spark.createDataFrame([(i % 11 - 3, say[i % 5] + " " + say[i * i % 5]) for i in range(20)], "docid long, body string").repartition(3)
    one = Analyzer(possessive=True, stemmer=stemmer)
    tf = index.build(docs, one, ("body",)).field("body").tf
    found = tallies.posted(docs, one)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, index.postings(tf).collect()))
    sinks.write_postings(found, str(tmp_path / "a"))
    sinks.write_index(tf, str(tmp_path / "b"))
    lines = lambda p: sorted(r.value for r in spark.read.text(str(tmp_path / p)).collect())
    assert lines("a") == lines("b") and len(lines("a")) > 4
    sinks.write_postings(tallies.posted(docs.filter("false"), one), str(tmp_path / "c"))
    assert lines("c") == ["0, 0"]
