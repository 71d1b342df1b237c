"""Boolean search by bitmaps, the model as a pipeline's stage, and readers that check what they read."""

import json
import os
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lexispark.operators import bitmaps, boolean, learning, model, ranking
from lexispark.operators.bitmaps import BUCKET
from lexispark.operators.features import feature_names
from lexispark.sources import checked

EDGES = [0, 1, 7, 8, BUCKET - 1, BUCKET, BUCKET + 1, 2 * BUCKET, 2 * BUCKET + 1, -1, -8, -BUCKET, -BUCKET - 1, 10**12]


def postings(spark):
    rng = random.Random(5)
    ids = EDGES + rng.sample(range(-100_000, 200_000), 400)
    lists = {"aa": set(ids), "bb": set(rng.sample(ids, 200)) | set(EDGES), "cc": {10**12, 5}, "dd": {3}}
    rows = [(t, d, 1) for t, found in lists.items() for d in found]
    return lists, spark.createDataFrame([*rows, *rows[:50], ("aa", None, 1)], "term string, docid long, tf long")


QUERIES = [(1, "aa AND bb"), (2, "bb or cc"), (3, "cc AND dd"), (4, "aa AND nowhere"), (5, "nowhere or dd"), (6, "bb and bb"), (7, "aa xor bb"), (8, "no or nowhere")]
SETS = {1: "a & b", 2: "b | c", 3: "c & d", 4: "a & set()", 5: "d", 6: "b"}


def test_bitmaps_are_the_sets(spark):
    lists, tf = postings(spark)
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    found = bitmaps.search(tf, queries, stemmer="none")
    rows = found.collect()
    names = {x[0]: v for x, v in lists.items()}
    want = {q: ids for q, e in SETS.items() if (ids := eval(e, {}, names))}  # noqa: S307
    got = {}
    for r in bitmaps.documents(found).collect():
        got.setdefault(r.query_id, []).append(r.docid)
    assert {q: sorted(d) for q, d in got.items()} == {q: sorted(d) for q, d in want.items()}
    assert {r.query_id: r.n for r in bitmaps.counts(found).collect()} == {q: len(d) for q, d in want.items()}
    assert all(len(r.bits) == BUCKET // 8 and 0 < r.n <= BUCKET for r in rows)
    assert len({r.bucket for r in rows if r.query_id == 1}) > 5
    plain = {r.query_id: r.docids for r in boolean.search(tf.dropna(), queries, stemmer="none").collect()}
    assert all(plain[q] == sorted(d) for q, d in want.items())


def test_bitmaps_shuffle_once(spark):
    _, tf = postings(spark)
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    plan = bitmaps.search(tf, queries, stemmer="none")._jdf.queryExecution().executedPlan().toString()
    # Building lists and folding them needs no exchange but that by bucket.
    assert plan.count("Exchange hashpartitioning(bucket") == 1 and "CartesianProduct" not in plan
    empty = bitmaps.search(tf.limit(0), queries, stemmer="none")
    assert empty.isEmpty() and bitmaps.documents(empty).isEmpty()


def stage(spark):
    n = len(feature_names())
    weights = [((7 * i) % 11 - 5) / 4 for i in range(n)]
    topics = spark.createDataFrame([(1, "one"), (2, "two")], "qid long, query string")
    rng = random.Random(9)
    rows = [(q, d, [rng.random() for _ in range(n)]) for q in (1, 2) for d in range(6)]
    vectors = spark.createDataFrame(rows, "qid long, docid long, features array<double>")
    bare = spark.createDataFrame([(d, [rng.random() / 9 for _ in range(n)]) for d in range(30)], "docid long, features array<double>")
    return weights, topics, vectors, bare


def test_a_saved_pipeline_ranks_as_the_model(spark, tmp_path):
    weights, topics, vectors, bare = stage(spark)
    path = str(tmp_path / "pipeline")
    PipelineModel([model.ranker(weights, -0.25, {"topics": topics})]).write().save(path)
    loaded = PipelineModel.load(path)
    got = model.rank(loaded, vectors, bare, topics, 9).orderBy("qid", "rank").collect()
    score = lambda df: learning.linear_scores(df, weights, -0.25)
    assert got == learning.rank_all(score(vectors), score(bare), topics, 9).orderBy("qid", "rank").collect()
    assert len(got) == 18
    last = loaded.stages[-1]
    assert last.getOrDefault("features") == feature_names() and last.uid.startswith("LinearRanker")
    other = topics.withColumn("query", F.upper("query"))
    assert last.changed({"topics": topics}) == [] and last.changed({"topics": other, "new": topics}) == ["new", "topics"]


def test_stages_refuse_what_they_do_not_fit(spark, tmp_path):
    weights, _, vectors, _ = stage(spark)
    path = str(tmp_path / "stage")
    model.ranker(weights, 0.0).save(path)
    (part,) = [f for f in os.listdir(f"{path}/metadata") if f.startswith("part-")]
    held = json.loads(open(f"{path}/metadata/{part}").read())
    held["paramMap"]["version"] = "older"
    spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    with pytest.raises(ValueError, match="version"):
        model.LinearRanker.load(path)
    short = model.LinearRanker(weights=[1.0, 2.0], inputCol="x y", outputCol="out")
    df = spark.createDataFrame([(1, [0.5, 2.0]), (2, None)], "id int, `x y` array<double>")
    assert {r.id: r.out for r in short.transform(df).collect()} == {1: 4.5, 2: None}
    with pytest.raises(Exception, match="2 that the stage has weights for"):
        short.transform(vectors.withColumnRenamed("features", "x y")).collect()
    with pytest.raises(ValueError, match="already"):
        short.transform(df.withColumn("out", F.lit(1)))
    with pytest.raises(TypeError):
        short.transform(df.select(F.lit("a").alias("x y")))


RECORDS = ".I 1\n.T\na title\n.W\nbody\n.I 2\n.W\n.I two\n.W\nlost\n.I 1\n.W\nagain\n.I 4\n.A\nname\n"
LINES = "1 10 1\n1 10 3\n\n2 99 -1\n9 10 5\n9 98 7\n1 11 0\nx 10 1\n1 11\n1 11 1 0\n1.5 11 1\n2 11 5 \n"


def jobs(spark, run):
    """What ``run`` gives, and the number of its jobs that read text."""
    seen = spark.sparkContext
    seen.setJobGroup("counted", "counted")
    try:
        return run(), len(seen.statusTracker().getJobIdsForGroup("counted"))
    finally:
        seen.setLocalProperty("spark.jobGroup.id", None)


def test_collections_name_all_faults(spark, tmp_path):
    path = str(tmp_path / "docs")
    open(path, "w").write(RECORDS)
    with pytest.raises(checked.Faults, match="1 unnumbered, 1 empty, 1 repeated") as e:
        checked.collection(spark, path)
    assert e.value.counts == {"unnumbered": 1, "empty": 1, "repeated": 1}
    docs, counts = checked.collection(spark, path, strict=False)
    assert counts == {"rows": 5, "unnumbered": 1, "empty": 1, "repeated": 1}
    assert sorted((r.docid or 0, r.title, r.author, r.body) for r in docs.collect()) == [(0, "", "", "lost"), (1, "", "", "again"), (1, "a title", "", "body"), (2, "", "", ""), (4, "", "name", "")]
    open(path, "w").write("")
    with pytest.raises(checked.Faults):
        checked.collection(spark, path)
    assert checked.collection(spark, path, strict=False)[1] == {"rows": 0, "unnumbered": 0, "empty": 0, "repeated": 0}


def test_judgements_name_all_faults(spark, tmp_path):
    path = str(tmp_path / "judged")
    open(path, "w").write(LINES)
    docs = spark.createDataFrame([(10,), (11,), (11,), (None,)], "docid long")
    topics = spark.createDataFrame([(1,), (2,)], "qid long")
    found, counts = checked.judgements(spark, path, docs, topics, strict=False)
    assert counts == {"rows": 11, "malformed": 4, "unknown_code": 2, "unknown_topic": 2, "unknown_document": 2, "repeated": 1}
    assert sorted(tuple(r) for r in found.collect()) == [(1, 10, 1), (1, 10, 3), (2, 11, 5)]
    with pytest.raises(checked.Faults, match="4 malformed, 2 unknown_code, 2 unknown_topic, 2 unknown_document, 1 repeated"):
        checked.judgements(spark, path, docs, topics)
    open(path, "w").write("1 10 1\n2 11 -1\n")
    assert checked.judgements(spark, path, docs, topics)[1]["rows"] == 2


def test_checks_are_one_job(spark, tmp_path):
    path = str(tmp_path / "lines")
    open(path, "w").write("".join(f"{i}\n" for i in range(50)))
    lines = spark.read.text(path).select(F.col("value").cast("long").alias("n"))
    (rows, counts), n = jobs(spark, lambda: checked.checked(lines, "numbers", {"odd": F.col("n") % 2 == 1, "none": F.col("n") < 0}, strict=False))
    assert n == 1 and counts == {"rows": 50, "odd": 25, "none": 0} and rows.count() == 50
