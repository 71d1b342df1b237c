"""Preprocessing variants, comparisons with p, the ranker's certificate and rankings of all documents."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import significance
from lexispark.functions.text import Analyzer
from lexispark.operators import evaluation, features, index, learning, ranking, scoring, variants, workflow
from lexispark.sources import store

SCORES = "qid long, docid long, score double"


def collection(spark, n=80, seed=5):
    """Documents of words that stems and stop words tell apart, topics, and judgements by a word of each topic."""
    rng = random.Random(seed)
    words = ["running", "runs", "run", "the", "of", "wings", "wing", "flows", "flow", "heated", "heat", "plates", "plate", "shell"]
    rows = [(i + 1, " ".join(rng.choices(words, k=3)), "an author" if i % 2 else "", "en", " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(n)]
    docs = spark.createDataFrame(rows, "docid long, title string, author string, bibliography string, body string")
    asked = [(1, "running of wings"), (2, "the heat"), (3, "plates shell"), (4, "nowhere found"), (5, "flow of the plate")]
    topics = spark.createDataFrame(asked, "qid long, query string")
    judged = [(q, r[0], 1 + r[0] % 4) for q, text in asked for r in rows if text.split()[-1] in r[4].split() and r[0] % 3]
    return docs, topics, spark.createDataFrame(judged, "qid long, docid long, label int")


def test_variants_match_an_index_of_each(spark):
    docs, topics, judged = collection(spark)
    stops = {"none": (), "short": ("the", "of")}
    got = {r.name: r for r in variants.grid(docs, topics, judged, stops, ("none", "porter"), depth=20).collect()}
    assert len(got) == 12 and sorted(r.place for r in got.values()) == list(range(1, 13))
    for fields, stemmer, stop in (("text", "none", "none"), ("title_text", "porter", "short"), ("all", "porter", "none"), ("all", "none", "short")):
        names = {"text": ["body"], "title_text": ["title", "body"], "all": ["title", "author", "bibliography", "body"]}[fields]
        one = docs.select("docid", F.concat_ws(" ", *names).alias("body"))
        idx = index.build(one, Analyzer(stop=stops[stop], stemmer=stemmer), ("body",)).field("body")
        run = ranking.rank(scoring.score(idx, topics, "bm25_engine"), 20)
        mean = evaluation.measures(run, judged, topics).agg(*(F.avg(F.col(f"`{m}`")).alias(m) for m in evaluation.METRICS)).first()
        found = got[f"{fields}__{stemmer}__{stop}"]
        assert [found[m] for m in evaluation.METRICS] == pytest.approx([mean[m] for m in evaluation.METRICS], abs=1e-9), (fields, stemmer, stop)


def test_variants_of_empty_tables(spark):
    docs, topics, judged = collection(spark)
    got = variants.grid(docs.filter("false"), topics, judged.filter("false"), {"none": ()}, ("none",)).collect()
    assert len(got) == 3 and all(r["AP"] == 0 for r in got)


def test_p_as_columns(spark):
    rows = [(t, n, b, w) for t, n in [(0.0, 11), (2.228, 11), (-2.228, 11), (0.3, 2), (5.0, 3), (1.7, 200), (3.1, 201), (1.2, 202), (2.0, 5000), (40.0, 30), (None, 9)] for b, w in [(0, 0), (5, 1), (67, 37), (900, 1000)]]
    df = spark.createDataFrame(rows, "t double, n long, better long, worse long")
    for r in df.withColumn("p", significance.t_test(F.col("t"), F.col("n"))).withColumn("s", significance.sign_test(F.col("better"), F.col("worse"))).collect():
        if r.t is None:
            assert r.p is None
        else:
            assert r.p == pytest.approx(evaluation.t_test(r.t, r.n), rel=1e-7, abs=1e-13), r
        assert r.s == pytest.approx(evaluation.sign_test(r.better, r.worse), rel=1e-8)
    ratio = spark.range(1, 600).select("id", significance.log_gamma_ratio(F.col("id")).alias("x")).collect()
    assert all(r.x == pytest.approx(math.lgamma((r.id + 1) / 2) - math.lgamma(r.id / 2), abs=1e-10) for r in ratio)


def test_comparisons(spark):
    rng = random.Random(8)
    values = {(s, q): [rng.choice([0.0, 0.25, 0.5]) for _ in evaluation.METRICS] for s in "ab" for q in range(30)}
    a, b = (spark.createDataFrame([(q, *v) for (x, q), v in values.items() if x == s], ["qid", *evaluation.METRICS]) for s in "ab")
    sets = spark.createDataFrame([("full", q) for q in range(30)] + [("even", q) for q in range(0, 30, 2)] + [("one", 3)], "set string, qid long")
    got = {(r.set, r.measure): r for r in evaluation.comparisons(a, b, sets).collect()}
    assert len(got) == 3 * len(evaluation.METRICS)
    for (name, measure), r in got.items():
        at = evaluation.METRICS.index(measure)
        d = [values["b", q][at] - values["a", q][at] for q in range(30) if name == "full" or name == "even" and q % 2 == 0 or q == 3 and name == "one"]
        assert (r.topics, r.better, r.worse) == (len(d), sum(x > 0 for x in d), sum(x < 0 for x in d))
        assert r.sign_p == pytest.approx(evaluation.sign_test(r.better, r.worse))
        if name == "one":
            assert r.t is None and r.p is None
        else:
            t = np.mean(d) / (np.std(d, ddof=1) / math.sqrt(len(d)))
            assert r.t == pytest.approx(t, abs=1e-9) and r.p == pytest.approx(evaluation.t_test(t, len(d)), rel=1e-7)
    same = evaluation.comparisons(a, a, sets).filter("set = 'full'").collect()
    assert all((r.better, r.worse, r.t, r.p, r.sign_p) == (0, 0, None, None, 1.0) for r in same)


def test_tuned_against_default(spark):
    docs, topics, judged = collection(spark)
    idx = index.build(docs, Analyzer(stop=()), ("body",)).field("body")
    split = learning.odd_even(topics).select("qid", "split")
    got = workflow.tuned_against_default(idx, topics, judged, split, 30).collect()
    train = topics.filter("qid % 2 = 1")
    best = learning.first_best(learning.bm25_grid(scoring.matches(idx, scoring.topic_terms(train, idx.analyzer)), judged, train, 30), "ap").first()
    assert len(got) == 14 and {(r.k1, r.b) for r in got} == {(best.k1, best.b)}
    for k1, b, column in ((1.2, 0.75, "baseline"), (best.k1, best.b, "other")):
        per = evaluation.measures(ranking.rank(scoring.score(idx, topics, k1=k1, b=b), 30), judged, topics)
        mean = per.filter("qid % 2 = 0").agg(F.avg("AP")).first()[0]
        assert next(r[column] for r in got if r.set == "heldout" and r.measure == "AP") == pytest.approx(mean, abs=1e-9)


def test_certificate_and_f1_by_sql(spark):
    """Both objectives and f1 at 10, computed again by SQL from the features and the fitted weights."""
    docs, topics, judged = collection(spark, 60)
    idx = index.build(docs, Analyzer(stop=()))
    v, bare = features.feature_vectors(idx, topics), features.bare_features(idx)
    rows = learning.labelled(v, judged, learning.unmatched(v, bare, judged, topics))
    alphas = (0.01, 1.0, 0.1)
    fits = learning.svm_path(rows, alphas)
    assert [f.alpha for f in fits] == list(alphas) and all(f.primal >= f.dual - 1e-9 and f.primal - f.dual < 1e-6 for f in fits)
    db = duckdb.connect()
    data = rows.toPandas()
    db.execute("CREATE TABLE r (i INT, f DOUBLE[], label DOUBLE, weight DOUBLE, n BIGINT)")
    db.executemany("INSERT INTO r VALUES (?, ?, ?, ?, ?)", [(i, list(x.features), x.label, x.weight, x.n) for i, x in enumerate(data.itertuples())])
    db.execute("CREATE TABLE m (alpha DOUBLE, w DOUBLE[], b DOUBLE, primal DOUBLE, dual DOUBLE)")
    db.executemany("INSERT INTO m VALUES (?, ?, ?, ?, ?)", [(f.alpha, f.weights, f.intercept, f.primal, f.dual) for f in fits])
    found = db.sql(f"""
WITH x AS (SELECT i, label * 2 - 1 AS y, weight, n, unnest(f) AS v, unnest(range(len(f))) AS k FROM r),
s AS (SELECT k, sum(n * v) / sum(n) AS mean, sqrt(greatest(sum(n * v * v) / sum(n) - (sum(n * v) / sum(n)) ** 2, 0)) AS sd FROM x GROUP BY k),
w AS (SELECT alpha, b, unnest(w) AS w, unnest(range(len(w))) AS k, primal, dual FROM m),
g AS (SELECT alpha, i, any_value(y) AS y, any_value(weight) AS c, 1 - any_value(y) * (sum(v * w) + any_value(b)) AS gap FROM x JOIN w USING (k) GROUP BY ALL),
u AS (SELECT *, least(greatest(gap / {learning.ROUND}, 0), 1) AS u, CASE WHEN gap <= 0 THEN 0 WHEN gap < {learning.ROUND} THEN gap * gap / (2 * {learning.ROUND}) ELSE gap - {learning.ROUND} / 2 END AS loss FROM g),
t AS (SELECT sum(weight) AS total FROM r),
p AS (SELECT alpha, sum(c * loss) / any_value(total) AS loss, sum(c * (u - {learning.ROUND} / 2 * u * u)) / any_value(total) AS linear, sum(c * u * y) / any_value(total) AS free FROM u, t GROUP BY alpha),
z AS (SELECT alpha, k, sum(u.c * u.u * u.y * CASE WHEN sd > 1e-9 THEN (v - mean) / sd ELSE 0 END) / any_value(total) AS z FROM u JOIN x USING (i) JOIN s USING (k), t GROUP BY alpha, k),
b AS (SELECT alpha, any_value(b) + sum(w * mean) AS b0, sum((w * sd) ** 2) AS norm FROM w JOIN s USING (k) GROUP BY alpha)
SELECT m.alpha, p.loss + m.alpha / 2 * norm + {learning.INTERCEPT} / 2 * b0 * b0 AS primal, linear - (SELECT sum(z * z) FROM z WHERE z.alpha = m.alpha) / (2 * m.alpha) - free * free / (2 * {learning.INTERCEPT}) AS dual, m.primal AS primal2, m.dual AS dual2
FROM m JOIN p ON p.alpha = m.alpha JOIN b ON b.alpha = m.alpha""").fetchall()
    assert len(found) == 3
    for alpha, primal, dual, primal2, dual2 in found:
        assert primal == pytest.approx(primal2, abs=1e-7) and dual == pytest.approx(dual2, abs=1e-5), alpha
        assert primal - dual < 1e-5
    trials = dict(learning.judged_alphas(fits, v, bare, judged, topics))
    db.execute("CREATE TABLE v (qid BIGINT, docid BIGINT, f DOUBLE[])")
    db.executemany("INSERT INTO v VALUES (?, ?, ?)", [(r.qid, r.docid, list(r.features)) for r in v.collect()])
    db.execute("CREATE TABLE l (docid BIGINT, f DOUBLE[])")
    db.executemany("INSERT INTO l VALUES (?, ?)", [(r.docid, list(r.features)) for r in bare.collect()])
    db.execute("CREATE TABLE j (qid BIGINT, docid BIGINT)")
    db.executemany("INSERT INTO j VALUES (?, ?)", [tuple(r)[:2] for r in judged.collect()])
    f1 = db.sql("""
WITH a AS (SELECT q.qid, l.docid, coalesce(v.f, l.f) AS f FROM (SELECT unnest(range(1, 6)) AS qid) q CROSS JOIN l LEFT JOIN v ON v.qid = q.qid AND v.docid = l.docid),
s AS (SELECT alpha, qid, docid, list_dot_product(f, w) + b AS s FROM a, m),
k AS (SELECT *, row_number() OVER (PARTITION BY alpha, qid ORDER BY round(s, 9) DESC, docid) AS rank FROM s),
h AS (SELECT alpha, k.qid, count(j.docid) AS hits FROM k LEFT JOIN j ON j.qid = k.qid AND j.docid = k.docid WHERE rank <= 10 GROUP BY ALL),
n AS (SELECT qid, count(*) AS n FROM j GROUP BY qid)
SELECT alpha, sum(CASE WHEN hits > 0 THEN 2 * (hits / 10) * (hits / n) / (hits / 10 + hits / n) ELSE 0 END) / 5 FROM h LEFT JOIN n USING (qid) GROUP BY alpha""").fetchall()
    assert trials == pytest.approx(dict(f1), abs=1e-9) and max(trials.values()) > 0.3


def test_all_documents_of_topics_that_match_nearly_all(spark, monkeypatch):
    monkeypatch.setattr(learning, "SPAN", 16)
    rng = random.Random(9)
    low = [(g, d, float(rng.randint(0, 20))) for g in (0, 1) for d in range(400)]
    matched = {1: range(400), 2: [d for d in range(400) if d not in (17, 230, 399)], 3: range(0, 400, 2), 4: [], 5: rng.sample(range(400), 390)}
    scores = [(g, q, d, rng.random() * 20 - 30 * (q == 2)) for g in (0, 1) for q, ds in matched.items() for d in ds]
    topics = spark.createDataFrame([(q, "x") for q in matched], "qid long, query string")
    s = spark.createDataFrame(scores, f"g int, {SCORES}")
    rest = spark.createDataFrame(low, "g int, docid long, score double").repartition(5)
    got = {}
    for r in learning.rank_all(s, rest, topics, 7, ["g"]).collect():
        got.setdefault((r.g, r.qid), {})[r["rank"]] = r.docid
    for g in (0, 1):
        for q in matched:
            value = {d: x for h, d, x in low if h == g} | {d: x for h, p, d, x in scores if (h, p) == (g, q)}
            want = sorted(value, key=lambda d: (-round(value[d], 9), d))[:7]
            assert [got[g, q][i] for i in range(1, 8)] == want, (g, q)
    alone = learning.rank_all(s.filter("g = 0").drop("g"), rest.filter("g = 0").drop("g"), topics, 500)
    assert alone.groupBy("qid").count().filter("count = 400").count() == 5  # fewer documents than asked for


def test_no_topic_meets_all_documents(spark, monkeypatch, tmp_path):
    """What is joined to topics is a row for each span and at most k places."""
    seen = {}
    real = store.stored
    monkeypatch.setattr(learning, "stored", lambda df, name, *a: seen.setdefault(name, real(df, name, *a)))
    n = 20_000
    rest = spark.range(n).selectExpr("id AS docid", "CAST(-id AS DOUBLE) AS score")
    scores = spark.range(n).selectExpr("1L AS qid", "id AS docid", "-50000.0D - id AS score").filter("docid % 5000 <> 4999")
    topics = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, query string")
    got = learning.rank_all(scores, rest, topics, 3)
    assert sorted((r.qid, r["rank"], r.docid) for r in got.collect()) == [(1, 1, 4999), (1, 2, 9999), (1, 3, 14999), (2, 1, 0), (2, 2, 1), (2, 3, 2)]
    assert seen["needed"].groupBy("qid").agg(F.sum("need").alias("k")).filter("k <> 3").count() == 0
    assert seen["needed"].count() <= 2 * 3
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan.split("placed")[-1]


def test_stored_tables_go_with_release(spark):
    table = store.stored(spark.range(5), "five")
    assert table.count() == 5 and store.release(spark) >= 1 and store.release(spark) == 0
    with pytest.raises(Exception, match="(?i)exist|PATH_NOT_FOUND|FileNotFound"):
        table.count()


def test_alphas_share_passes(spark, monkeypatch):
    """All alphas are fitted in the same few passes over the rows."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 6)) ** 3
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.2 * rng.standard_normal(1500) > 2.5).astype(float)
    rows = spark.createDataFrame([(list(map(float, a)), float(b), 1.0 + 9 * float(b), 1) for a, b in zip(x, y, strict=True)], "features array<double>, label double, weight double, n bigint").repartition(3)
    passes, run = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, *a, **k: passes.append(1) or run(df, *a, **k))
    fits = learning.svm_path(rows, learning.ALPHAS)
    assert len(passes) == 2 + max(f.passes for f in fits)  # the blocks, the moments, and passes that are not summed over alphas
    assert all(abs(f.primal - f.dual) <= 1e-7 * max(1, f.primal) for f in fits)
    # Cells only propose: the optima are the same with few of them.
    monkeypatch.setattr(learning, "CELLS", 2)
    monkeypatch.setattr(learning, "PARTIALS", 2)  # partial sums and cells are put together in tasks
    few = learning.svm_path(rows, learning.ALPHAS[3:5])
    assert [f.primal for f in few] == pytest.approx([f.primal for f in fits[3:5]], abs=2e-7)
