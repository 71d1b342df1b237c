"""Places counted where documents lie, against rankings of every pair."""

import pytest
from pyspark.sql import functions as F

from lexispark.functions.text import FIELD_SETS, Analyzer
from lexispark.operators import blocks, evaluation, features, index, learning, model, places, ranking, scoring, tallies, variants, workflow
from tests.test_tallies import exchanges, made


def setting_up(spark, copies=True):
    docs, topics = made(spark, range(1, 61), seed=11)
    if copies:  # equal scores
        docs = docs.unionByName(docs.withColumn("docid", F.col("docid") + 100)).unionByName(docs.withColumn("docid", F.col("docid") - 100))
    judged = spark.createDataFrame([(q, d, (q + d) % 3) for q in range(1, 12) for d in range(-100 + q, 170, 7)], "qid long, docid long, label int")
    return index.build(docs, Analyzer()).field("body"), topics, judged


@pytest.mark.parametrize("counters", [60, 10**6])
def test_places_of_judged(spark, monkeypatch, counters):
    monkeypatch.setattr(places, "COUNTERS", counters)
    monkeypatch.setattr(places, "DOCUMENTS", 7)
    idx, topics, judged = setting_up(spark)
    controls = [*((m, 1.2, 0.75) for m in scoring.MODELS), ("bm25", 0.4, 0.0)]
    got = sorted(map(tuple, places.judged(idx, topics, judged, controls, 90).collect()))
    want = []
    monkeypatch.setattr(index.Index, "row_by_row", lambda *_: None)
    for g, (model, k1, b) in enumerate(controls):
        run = ranking.rank(scoring.score(idx, topics, model, k1, b), 90).join(judged.filter("label > 0"), ["qid", "docid"])
        want += [(g, *r) for r in run.select("qid", "docid", "rank").collect()]
    assert len(want) > 300 and got == sorted(want)


def test_grid_in_rows(spark, monkeypatch):
    idx, topics, judged = setting_up(spark)
    grid = lambda: {r.g: (r.k1, r.b, round(r.ap, 10)) for r in learning.bm25_grid_of(idx, judged, topics, 20, (0.4, 1.2), (0.0, 0.75, 1.0)).collect()}
    got = grid()
    monkeypatch.setattr(index.Index, "row_by_row", lambda *_: None)
    assert len(got) == 6 and got == grid()


def test_grid_without_judged_matches(spark):
    idx, topics, judged = setting_up(spark, copies=False)
    got = learning.bm25_grid_of(idx, judged.withColumn("docid", F.col("docid") + 1000), topics, 20, (0.4,), (0.0, 1.0)).collect()
    assert [r.ap for r in got] == [0.0, 0.0]


def test_first_are_enough(spark):
    idx, topics, _ = setting_up(spark)
    table, plan = tallies.tallied(idx, topics, ("body",), False)
    all_ = places.scores(table, plan, topics, ("bm25", 1.2, 0.75))
    few = places.first(all_.coalesce(2), 3)
    assert few.count() < all_.count()
    assert sorted(map(tuple, ranking.rank(few, 3).collect())) == sorted(map(tuple, ranking.rank(all_, 3).collect()))


def test_experiments_in_rows(spark, monkeypatch):
    idx, topics, judged = setting_up(spark)
    split = learning.odd_even(topics).select("qid", "split")
    plain = lambda rows: [[round(v, 9) if isinstance(v, float) else v for v in r] for r in sorted(map(tuple, rows), key=str)]
    both = lambda: (plain(workflow.experiments(idx, topics, judged, depth=40).collect()), plain(workflow.tuned_against_default(idx, topics, judged, split, 40).collect()))
    monkeypatch.setattr(learning.bm25_settings, "__defaults__", ((0.4, 1.2), (0.0, 1.0)))
    monkeypatch.setattr(learning.bm25_grid, "__defaults__", (1000, (0.4, 1.2), (0.0, 1.0)))
    with monkeypatch.context() as m:
        m.setattr(scoring, "matches", None)  # not asked for pairs
        got = both()
    monkeypatch.setattr(index.Index, "row_by_row", lambda *_: None)
    assert len(got[0]) == 6 and len(got[1]) == 14 and got == both()


def test_zones_in_rows(spark, monkeypatch):
    docs, topics = made(spark, seed=13)
    idx = index.build(docs, Analyzer())
    got = sorted(map(tuple, scoring.zones(idx, topics).collect()))
    padded = lambda: sorted(map(tuple, ranking.padded(scoring.weighted(scoring.zones(idx, topics), (0.4, 0.0, 0.2, 0.4)), docs, topics, 15).collect()))
    run = padded()
    monkeypatch.setattr(index.Index, "row_by_row", lambda *_: None)
    assert len(got) > 100 and got == sorted(map(tuple, scoring.zones(idx, topics).collect())) and run == padded()


def test_stage_in_rows(spark):
    docs, topics = made(spark, range(1, 31), seed=17)
    idx = index.build(docs, Analyzer())
    weights = [((7 * i) % 5 - 2) / 4 for i in range(len(features.feature_names()))]
    stage = model.ranker(weights, -0.5)
    got = sorted((r.qid, r.rank, r.docid, round(r.score, 9)) for r in model.rank_in_rows(stage, idx, topics, 12).collect())
    want = model.rank(stage, features.feature_vectors(idx, topics), features.bare_features(idx), topics, 12)
    assert len(got) == 12 * 9 and got == sorted((r.qid, r.rank, r.docid, round(r.score, 9)) for r in want.collect())


@pytest.mark.parametrize("frequent", [2, 1000])
def test_variants_by_bits(spark, monkeypatch, frequent):
    monkeypatch.setattr(variants, "FREQUENT", frequent)
    say = ["thing things", "running runs run the", "The thing", "", "reading reads w1", "w1 w1 things running"]
    docs = spark.createDataFrame([(i % 7, say[i % 6], say[(i + 1) % 6], None, say[(i * i) % 6] + " " + say[i % 5]) for i in range(1, 10)], "docid long, title string, author string, bibliography string, body string")
    stops = {"none": (), "list": ("the", "w1")}
    got = sorted(map(tuple, variants.statistics(docs, stops).collect()))
    tf = index.build(docs, Analyzer(stop=())).tf
    rows, want = tf.join(variants.stems_of(tf.select("term").distinct()), "term").collect(), {}
    for r in rows:
        for f, fields in FIELD_SETS.items():
            for s, words in stops.items():
                if r.field in fields and r.term not in words:
                    stems, postings, tokens = want.setdefault((f, r.stemmer, s), (set(), set(), []))
                    stems.add(r.stem), postings.add((r.stem, r.docid)), tokens.append(r.tf)
    assert len(got) == 18 and got == sorted((*k, len(a), len(b), sum(c)) for k, (a, b, c) in want.items())


def test_blocks_from_documents(spark, monkeypatch):
    docs, topics = made(spark, range(-9, 60), seed=19)
    idx = index.build(docs, Analyzer()).field("body")
    found = lambda: sorted((r.term, r.block, r.n, r.first, r.last, r.places, [round(w, 9) for w in r.weights], round(r.bound, 9)) for r in blocks.build(idx, bits=4).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)  # blocks that go on in the next batch
    got = found()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lean = tallies.lean(idx)
    assert exchanges(lean.tf) == 0 and sorted(map(tuple, lean.tf.select("docid", "term", "tf").collect())) == sorted(map(tuple, idx.tf.select("docid", "term", "tf").collect()))
    assert sorted(map(tuple, lean.df.collect())) == sorted(map(tuple, idx.df.select("term", "df").collect()))
    monkeypatch.setattr(index.Index, "row_by_row", lambda *_: None)
    assert len(got) > 80 and got == found()


def test_variants_in_rows(spark, monkeypatch):
    """The measures of all variants from judged documents' places are those of ranking every pair, which no plan has any more."""
    docs, topics = made(spark, range(1, 41), seed=4)
    docs = docs.unionByName(docs.withColumn("docid", F.col("docid") - 100))  # equal scores
    topics = topics.unionByName(spark.createDataFrame([(900, "the nothinglikethis"), (901, "")], topics.schema))
    judged = spark.createDataFrame([(q, d, (q + d) % 3) for q in [*range(1, 12), 900] for d in range(-100 + q, 60, 3)], "qid long, docid long, label int")
    stops = {"none": (), "list": ("the", "of", "a"), "short": ("the",)}
    plain = lambda rows: {r.name: (r.place, *(round(r[m], 9) for m in evaluation.METRICS)) for r in rows}
    with monkeypatch.context() as m:
        m.setattr(places, "DOCUMENTS", 7)
        m.setattr(variants, "matches", None)
        got = plain(variants.grid(docs, topics, judged, stops, depth=15).collect())
    monkeypatch.setattr(variants, "places_in_rows", lambda *_: None)
    want = plain(variants.grid(docs, topics, judged, stops, depth=15).collect())
    assert len(got) == 27 and len({v[1:] for v in got.values()}) > 5 and got == want
