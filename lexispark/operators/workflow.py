"""Whole runs: preprocessing, experiments, training, prediction and verification."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.text import Analyzer, join_fields, model_name
from lexispark.operators import evaluation, features, index, learning, places, ranking, reports, scoring, tallies, verify
from lexispark.sources import collection, sinks
from lexispark.sources.store import stored


def analyze(docs: DataFrame, analyzer: Analyzer, fields: tuple[str, ...] = ("title", "body")) -> DataFrame:
    """(docid, tokens): the terms of the joined fields of each document, in text order."""
    joined = docs.select("docid", join_fields(tuple(fields)).alias("joined"))
    terms = index.token_stream(joined, analyzer, "joined")
    kept = terms.groupBy("docid").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("t"))
    return docs.select("docid").join(kept, "docid", "left").select("docid", F.coalesce(F.col("t.term"), F.array().cast("array<string>")).alias("tokens"))


def preprocess(spark: SparkSession, source: str, path: str, stop: tuple[str, ...]) -> None:
    """A tagged collection's merged titles and bodies, analyzed, as a processed file. Of repeated ids the last counts."""
    docs = collection.read_collection(spark, source, duplicates="last", form="merged")
    sinks.write_processed(analyze(docs, Analyzer(possessive=True, stop=stop, stemmer="porter_all")), path)


def experiments(idx: index.Index, topics: DataFrame, qrels: DataFrame, models: Sequence[str] = scoring.MODELS, depth: int = 1000) -> DataFrame:
    """(name, place and the mean of each measure) of weighting models over one index, best average precision first."""
    rows = None
    # The measures need the places of judged documents alone, which are found where documents lie, for all models at once.
    placed = places.judged(idx, topics, qrels, [(m, 1.2, 0.75) for m in models], depth)
    placed = None if placed is None else stored(placed, "places")
    # Matches are found once for all models but cosine, which needs every term's weight.
    found = scoring.matches(idx, scoring.topic_terms(topics, idx.analyzer)) if placed is None and any(m != "cosine" for m in models) else None
    for g, m in enumerate(models):
        name = model_name(m, {"k_1": 1.2, "b": 0.75}) if m.startswith("bm25") else m
        run = ranking.rank(scoring.score(idx, topics, m, found=found), depth) if placed is None else placed.filter(F.col("g") == g).drop("g")
        per = evaluation.measures(run, qrels, topics)
        one = per.agg(*(F.avg(F.col(f"`{x}`")).alias(x) for x in evaluation.METRICS)).withColumn("name", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return reports.by_metric(rows, "AP")


def tuned_against_default(idx: index.Index, topics: DataFrame, qrels: DataFrame, split: DataFrame, depth: int = 1000) -> DataFrame:
    """BM25 with the best setting of the grid on the training topics against its
    defaults, for the topics held out and for all: what ``comparisons`` gives, with k1 and b of the setting.

    ``split`` (qid, split) has train and heldout. Documents are counted once for
    choice and comparison; where they can be scored in their rows, only places
    of judged ones leave a task.
    """
    train = topics.join(small_part(split, "train"), "qid", "left_semi")
    known = tallies.tallied(idx, topics, idx.fields, norms=False)
    settings = learning.bm25_settings()
    hits = known and places.judged(idx, topics, qrels.join(small_part(split, "train"), "qid", "left_semi"), [("bm25", k1, b) for _, k1, b in settings], depth, known)
    if hits is not None:
        grid = learning.precision_by_setting(hits, topics.sparkSession.createDataFrame(settings, "g int, k1 double, b double"), qrels, train)
        best = stored(learning.first_best(grid, "ap").select("k1", "b"), "best")  # one row
        placed = stored(places.judged(idx, topics, qrels, [("bm25", 1.2, 0.75), ("bm25", *best.first())], depth, known), "places")
        a, b = (evaluation.measures(placed.filter(F.col("g") == g).drop("g"), qrels, topics) for g in (0, 1))
    else:
        found = stored(scoring.matches(idx, scoring.topic_terms(topics, idx.analyzer)), "matches")
        trained = found.join(small_part(split, "train"), "qid", "left_semi")
        best = learning.first_best(learning.bm25_grid(trained, qrels, train, depth), "ap").select("k1", "b")
        best = stored(best, "best")  # one row
        tuned = found.crossJoin(F.broadcast(best)).groupBy("qid", "docid").agg(F.sum(scoring.term_weight("bm25", F.col("k1"), F.col("b"))).alias("score"))
        plain = scoring.score(idx, topics, found=found)
        a, b = (evaluation.measures(ranking.rank(s, depth), qrels, topics) for s in (plain, tuned))
    sets = topics.select(F.lit("full").alias("set"), "qid").unionByName(split.filter("split = 'heldout'").select(F.col("split").alias("set"), "qid"))
    return evaluation.comparisons(a, b, sets).crossJoin(F.broadcast(best))


def small_part(split: DataFrame, name: str) -> DataFrame:
    return index.small(split.filter(F.col("split") == name).select("qid"))


@dataclass(frozen=True)
class Trained:
    """What training found: trials (alpha, f1), the zone grid's best weights, the model for reports and the one for use."""

    trials: list[tuple[float, float]]
    alpha: float
    zone: tuple[float, ...]
    reported: tuple[list[float], float]
    deployed: tuple[list[float], float]
    metrics: DataFrame


def train(idx: index.Index, topics: DataFrame, qrels: DataFrame, split: DataFrame, path: str | None = None, alphas: Sequence[float] = learning.ALPHAS, extra: dict | None = None) -> Trained:
    """Train, choose and refit the linear ranker.

    ``split`` (qid, split) has train, validation and test. Alpha is chosen by
    f1 at 10 over the validation topics and the reported model is that fit; zone
    weights are chosen on the training topics. The deployed model is fitted
    again with the chosen alpha over training and validation topics and enters
    no reported measure. With ``path``, it is written as a bundle, with digests
    of the lengths, topics, judgements and split that it was made from.
    """
    if any(verify.split_faults(split, topics).first()):
        raise ValueError("the split does not deal out exactly the topics")
    part = lambda *names: topics.join(index.small(split.filter(F.col("split").isin(*names)).select("qid")), "qid", "left_semi")
    vectors, bare = stored(features.feature_vectors(idx, topics), "features"), stored(features.bare_features(idx), "bare")
    of = lambda *names: vectors.join(index.small(part(*names).select("qid")), "qid", "left_semi")
    trials, alpha, reported = learning.choose_alpha(of("train"), of("validation"), bare, qrels, part("train"), part("validation"), alphas)
    best = learning.first_best(learning.zone_grid(scoring.zones(idx, part("train")), qrels, part("train"))).first()
    both = part("train", "validation")
    (deployed,) = learning.fit_svms(learning.labelled(of("train", "validation"), qrels, learning.unmatched(of("train", "validation"), bare, qrels, both)), [alpha])
    ranked = learning.rank_all(learning.linear_scores(of("test"), *reported), learning.linear_scores(bare, *reported), part("test"), max(evaluation.CUTOFFS))
    rows = evaluation.macro(evaluation.prf(ranked, qrels, part("test")), "k").collect()  # one for each cutoff
    metrics = vectors.sparkSession.createDataFrame(rows, "k int, precision double, recall double, f1 double")
    zone = (best["a"], best["b"], best["c"], best["d"])
    if path:
        tables = {"lengths": idx.dl, "topics": topics, "judgements": qrels, "split": split}
        inputs = {name: reports.table_digest(t).first()["digest"] for name, t in tables.items()}
        learning.save_bundle(vectors.sparkSession, path, *deployed, zone, {"alpha": alpha, "features": features.feature_names(), "inputs": inputs, **(extra or {})})
    return Trained(trials, alpha, zone, reported, deployed, metrics)


def predict(spark: SparkSession, path: str, idx: index.Index, topics: DataFrame, k: int) -> DataFrame:
    """(qid, docid, score, rank): the first k of all documents for topics that training need not have seen, by a bundle."""
    model = learning.load_bundle(spark, path)
    if model["features"] != features.feature_names():
        raise ValueError("the bundle's features differ; train again")
    ranked = learning.rank_in_rows(idx, topics, [(model["weights"], model["intercept"])], k)
    if ranked is not None:
        return ranked.drop("g")
    score = lambda df: learning.linear_scores(df, model["weights"], model["intercept"])
    return learning.rank_all(score(features.feature_vectors(idx, topics)), score(features.bare_features(idx)), topics, k)


def verify_run(spark: SparkSession, path: str, labels: DataFrame, qrels: DataFrame, topics: DataFrame, reported: DataFrame, other: str | None = None) -> None:
    """Raise ValueError unless a written run is well formed, gives the reported
    measures again, and has the documents of a second run, if there is one."""
    run = verify.numbered(collection.read_run(spark, path), labels)
    size = run.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
    if not ranking.run_faults(run, size).filter("not ok").isEmpty():
        raise ValueError("the run's ranks, scores or documents are faulty")
    if not verify.recheck(run, qrels, topics, reported).filter("not ok").isEmpty():
        raise ValueError("the run does not give the reported measures")
    if other and not verify.disagreements(run, verify.numbered(collection.read_run(spark, other), labels)).isEmpty():
        raise ValueError("the two runs differ")
