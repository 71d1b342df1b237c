"""Queries over the test tables.

documents become a collection (title is the first line, author the first five
words, bibliography the language), benchmark items the topics, and a document
is relevant to an item whose text it contains.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import porter, text
from lexispark.functions.text import STOP, Analyzer
from lexispark.operators import bitmaps, blocks, boolean, evaluation, features, index, learning, model, places, ranking, reports, scoring, tallies, variants, verify, workflow
from lexispark.operators.index import FIELDS, small
from lexispark.sources import checked, collection, sinks
from lexispark.sources.store import folder, stored

PLAIN = Analyzer()
BOOLEAN = Analyzer(possessive=True, stemmer="porter_all")
#: Fixed queries for the Boolean operators; the last two are malformed.
BOOLEAN_QUERIES = ((1, "things AND others"), (2, "erth or ened"), (3, "The AND nothinglikethis"), (4, "running's OR reeding"), (5, "reered and reered"), (6, "one two"), (7, "one NOT two"))
DEPTH = 100
#: Blocks of 64 ids, so that the small test tables have many.
TOP_BITS = 6
#: Columns for the measures, in their order.
MEASURES = ("ap", "ndcg_10", "ndcg_20", "p_5", "p_10", "r_100", "rr")
#: A second stop list for the preprocessing grid.
SHORT_STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "in", "is", "it", "of", "on", "or", "the", "to")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of few splits, as of one small file, over all cores; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("docid"), F.substring_index(t, "\n", 1).alias("title"), F.substring_index(t, " ", 5).alias("author"), F.col("lang").alias("bibliography"), t.alias("body"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, docid, label) of the documents that contain a topic's text.

    A document must have the longest inner term of the topic before the text
    is sought in it, so the pairs come from an equi-join; topics of fewer than
    three terms have no inner term and meet every document.
    """
    q = topics(spark, sf_dir).filter("query is not null and query <> ''").withColumn("t", text.alnum(F.col("query")))
    inner = F.slice("t", F.lit(2), F.greatest(F.size("t") - 2, F.lit(0)))
    q = q.withColumn("term", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"])
    d = documents(spark, sf_dir).select("docid", "body")
    # The topics' terms are looked up in the scan, so no text leaves it.
    have = d.select("docid", "body", F.explode(F.array_distinct(text.alnum(F.col("body")))).alias("term")).join(small(q.filter("term is not null").select("qid", "query", "term")), "term")
    found = have.filter(F.col("body").contains(F.col("query"))).select("qid", "docid")
    short = d.join(small(q.filter("term is null").select("qid", "query"), 10_000), F.col("body").contains(F.col("query"))).select("qid", "docid")
    # Read several times by what judges a run.
    return stored(found.union(short).select("qid", "docid", (1 + F.pmod("docid", F.lit(4))).cast("int").alias("label")), "judgements")


def body_index(spark: SparkSession, sf_dir: str, analyzer: Analyzer = PLAIN) -> index.Index:
    return index.build(documents(spark, sf_dir), analyzer, ("body",), keep=True).field("body")


def full_index(spark: SparkSession, sf_dir: str) -> index.Index:
    return index.build(documents(spark, sf_dir), PLAIN, keep=True)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Doubles to six places, exact halves upward, and negative zero as zero."""
    return df.select(*((F.round(F.col(f"`{c}`") + F.lit(1e-10), places) + F.lit(0.0)).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns))


def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.token_stream(documents(spark, sf_dir), Analyzer(possessive=True, stop=()))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.size(F.filter(F.split("body", r"[ \t\n\r\f\x0b]+"), lambda x: x != ""))
    d = documents(spark, sf_dir).select("docid", raw.cast("bigint").alias("raw"), text.normalize(F.col("body")).alias("t"))
    return d.select("docid", "raw", F.size("t").cast("bigint").alias("normalized"), F.size(text.without_stop(F.col("t"), STOP)).cast("bigint").alias("kept"))


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(spark, sf_dir).agg(*(F.sum(c).alias(c) for c in ("raw", "normalized", "kept")))
    terms = documents(spark, sf_dir).select(F.explode(BOOLEAN.terms(F.col("body"))).alias("term")).distinct()
    stems = porter.stem(terms, stemmer="porter_all").agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("stem").alias("stems"))
    return counts.crossJoin(F.broadcast(stems))


def stop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("docid", F.array_join(Analyzer(possessive=True).terms(F.col("body")), " ").alias("kept"))


def stop_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = spark.createDataFrame([(w,) for w in STOP], "term string")
    tf = documents(spark, sf_dir).select("docid", F.explode(text.alnum(F.col("body"))).alias("term")).groupBy("docid", "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.join(F.broadcast(stop), "term", "left_anti")


def porter_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = documents(spark, sf_dir).select(F.explode(text.normalize(F.col("body"))).alias("term")).distinct()
    every = porter.stem(terms, out="every_suffix", stemmer="porter_all")
    return porter.stem(porter.stem(every, out="canonical"), out="weak", stemmer="weak")


def build_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(body_index(spark, sf_dir, BOOLEAN).tf).select("term", F.array_join("docids", ",").alias("docids"))


def posting_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term's documents in blocks of 4,096 neighbouring ids, with the largest BM25 weight of each block."""
    found = blocks.build(body_index(spark, sf_dir))
    ids = F.transform("places", lambda p: F.shiftleft("block", blocks.BITS) + p)
    return rounded(found.select("term", "block", "n", "first", "last", F.array_join(ids, ",").alias("docids"), "bound"), "bound")


def _bounded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    idx, q = body_index(spark, sf_dir), topics(spark, sf_dir)
    # Blocks of terms that no topic has would not be opened, so they are not stored.
    asked = small(scoring.topic_terms(q, idx.analyzer).select("term").distinct())
    return blocks.top(idx, stored(blocks.build(idx, bits=TOP_BITS).join(asked, "term", "left_semi"), "blocks"), q, 10, TOP_BITS)


def top_by_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of score_bm25, from the blocks that can hold them."""
    return rounded(_bounded(spark, sf_dir)[0], "score")


def blocks_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each topic's terms, and how many of them were not opened."""
    return _bounded(spark, sf_dir)[1]


def index_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.header(body_index(spark, sf_dir, BOOLEAN).tf)


def tf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_index(spark, sf_dir).tf


def df_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_index(spark, sf_dir).df


def field_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_index(spark, sf_dir).dl


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(full_index(spark, sf_dir).stats, "avg", places=2)


def preprocessing_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index statistics of every field set, stemmer and stop list. Terms are
    counted once per field and document; the variants differ in what is summed."""
    per = variants.statistics(documents(spark, sf_dir), {"none": (), "list": STOP, "short": SHORT_STOP})
    n = F.broadcast(documents(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")))
    return per.crossJoin(n).select(F.concat_ws("__", "fields", "stemmer", "stop").alias("variant"), F.col("n").alias("docs"), "terms", "postings", "tokens", F.round(F.col("tokens") / F.col("n"), 2).alias("avg"))


def preprocessing_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven measures of BM25 over each of the 27 preprocessing variants, best average precision first."""
    stops = {"none": (), "list": STOP, "short": SHORT_STOP}
    found = variants.grid(documents(spark, sf_dir), topics(spark, sf_dir), qrels(spark, sf_dir), stops)
    return rounded(found.select("name", "place", *(F.col(f"`{m}`") for m in evaluation.METRICS)), *evaluation.METRICS).toDF("name", "place", *MEASURES)


def _boolean(spark: SparkSession, sf_dir: str, keep: tuple[int, ...] | None = None) -> DataFrame:
    q = spark.createDataFrame([r for r in BOOLEAN_QUERIES if keep is None or r[0] in keep], "query_id bigint, query string")
    return boolean.search(body_index(spark, sf_dir, BOOLEAN).tf, q).select("query_id", "op", "left", "right", F.size("docids").cast("bigint").alias("n"), F.array_join("docids", " ").alias("docids"))


def boolean_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boolean(spark, sf_dir, (1, 3, 5))


def _common(idx: index.Index) -> DataFrame:
    """(query_id, query): the twelve most frequent terms, each with the next, by AND and by OR."""
    top = idx.df.orderBy(F.desc("df"), "term").limit(12).withColumn("at", F.row_number().over(Window.orderBy(F.desc("df"), "term")))  # twelve rows
    following = top.select((F.col("at") - 1).alias("at"), F.col("term").alias("next"))
    ops = F.explode(F.array(F.struct(F.lit(0).alias("i"), F.lit("AND").alias("op")), F.struct(F.lit(1).alias("i"), F.lit("or").alias("op"))))
    asked = top.join(F.broadcast(following), "at").select("at", "term", "next", ops.alias("x"))
    return asked.select((2 * F.col("at") + F.col("x.i")).cast("bigint").alias("query_id"), F.concat_ws(" ", "term", "x.op", "next").alias("query"))


def boolean_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the same queries as boolean_common from bitmaps, with their bucket and its number of answers."""
    idx = tallies.lean(body_index(spark, sf_dir))  # documents counted once, in their rows
    found = stored(bitmaps.search(idx.tf, _common(idx), stemmer="none"), "bitmaps")
    place = F.bitmap_bucket_number("docid").alias("bucket")
    return bitmaps.documents(found).select("query_id", "docid", place).join(found.drop("bits"), ["query_id", "bucket"])


def boolean_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve most frequent terms, each with the next, by AND and by OR."""
    idx = tallies.lean(body_index(spark, sf_dir))  # documents counted once, in their rows
    return boolean.search(idx.tf, _common(idx), stemmer="none").select("query_id", "op", "left", "right", F.size("docids").cast("bigint").alias("n"), F.array_join("docids", " ").alias("docids"))


def boolean_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boolean(spark, sf_dir, (2, 4))


def boolean_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boolean(spark, sf_dir)


def boolean_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the fixed queries, and of one made of each topic's first two words by AND, by NOT or without an operator, those that are malformed."""
    w = F.split("query", " ")
    op = F.element_at(F.array(F.lit(" AND "), F.lit(" "), F.lit(" not ")), (F.pmod("qid", F.lit(3)) + 1).cast("int"))
    made = topics(spark, sf_dir).filter(F.size(w) >= 2).select((1000 + F.col("qid")).alias("query_id"), F.concat(w[0], op, w[1]).alias("query"))
    return boolean.rejected(spark.createDataFrame(list(BOOLEAN_QUERIES), "query_id bigint, query string").unionByName(made))


def clean_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics(spark, sf_dir).select("qid", text.clean_topic(F.col("query")).alias("query"))


def _top(scores: DataFrame, k: int = 10) -> DataFrame:
    return rounded(ranking.rank(scores, k), "score")


def _score(model: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _top(scoring.score(body_index(spark, sf_dir), topics(spark, sf_dir), model))

    run.__name__ = f"score_{model}"
    return run


def rank_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: BM25 over stemmed bodies."""
    return _top(scoring.score(body_index(spark, sf_dir, Analyzer(stemmer="porter")), topics(spark, sf_dir)))


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.zones(full_index(spark, sf_dir), topics(spark, sf_dir))


#: Fixed weights of the zone queries; one field weighs nothing, so matches of score 0 occur.
WEIGHTS = (0.4, 0.0, 0.2, 0.4)


def zone_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.weighted(_zones(spark, sf_dir), WEIGHTS), "score")


def zone_or_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.weighted(_zones(spark, sf_dir), WEIGHTS, any_term=True), "score")


def equal_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.equal_zone(_zones(spark, sf_dir)), "score")


def _feature_matrix(field: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features.field_features(full_index(spark, sf_dir), field, topics(spark, sf_dir), 6)

    run.__name__ = f"feature_matrix_{field}"
    return run


def feature_matrix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 88 features as columns, for pairs that match in any field."""
    return features.feature_table(full_index(spark, sf_dir), topics(spark, sf_dir), 6)


def rank_padded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = scoring.weighted(_zones(spark, sf_dir), WEIGHTS)
    return rounded(ranking.padded(scores, documents(spark, sf_dir), topics(spark, sf_dir), DEPTH), "score")


def _run(spark: SparkSession, sf_dir: str, k: int = DEPTH) -> DataFrame:
    return ranking.rank(scoring.score(body_index(spark, sf_dir), topics(spark, sf_dir)), k)


def trec_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.run_lines(_run(spark, sf_dir, 10), "lexispark", 6).select("line")


def run_label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = topics(spark, sf_dir).select("qid", F.format_string("%05d", F.col("qid").cast("bigint")).alias("original_id"))
    return ranking.run_lines(_run(spark, sf_dir, 10), "lexispark", 6, labels).select("line")


def prf_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.prf(_run(spark, sf_dir), qrels(spark, sf_dir), topics(spark, sf_dir)), "precision", "recall", "f1")


def macro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = evaluation.prf(_run(spark, sf_dir), qrels(spark, sf_dir), topics(spark, sf_dir))
    return rounded(evaluation.macro(per, "k"), "precision", "recall", "f1")


def ranked_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.measures(_run(spark, sf_dir), qrels(spark, sf_dir), topics(spark, sf_dir))
    return rounded(m, *evaluation.METRICS).toDF("qid", *MEASURES)


def _measure(name: str, column: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ranked_measures(spark, sf_dir).select("qid", column)

    run.__name__ = name
    return run


def baseline_better_worse(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx, q, j = body_index(spark, sf_dir), topics(spark, sf_dir), qrels(spark, sf_dir)
    a, b = (evaluation.measures(ranking.rank(scoring.score(idx, q, m), DEPTH), j, q) for m in ("tf", "bm25"))
    return rounded(evaluation.compare(a, b, "AP"), "mean", "t")


def tuned_vs_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 tuned on the odd topics against its defaults: seven measures for the even topics and for all, with p."""
    idx, q = body_index(spark, sf_dir), topics(spark, sf_dir)
    found = workflow.tuned_against_default(idx, q, qrels(spark, sf_dir), learning.odd_even(q).select("qid", "split"))
    return rounded(found, "baseline", "other", "t", "p", "sign_p")


def split_odd_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.odd_even(topics(spark, sf_dir)).select("qid", "split")


def split_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = learning.odd_even(topics(spark, sf_dir)).filter("split = 'train'")
    return qrels(spark, sf_dir).join(small(train.select("qid")), "qid", "left_semi")


def qrels_join_default_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.judged(_run(spark, sf_dir, 20), qrels(spark, sf_dir)).select("qid", "docid", "rank", "label")


def qrels_coverage_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics(spark, sf_dir).select("qid").join(qrels(spark, sf_dir), "qid", "left_anti")


def dangling_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids that are no document, with ids moved so that there are some."""
    moved = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("docid"))
    return moved.join(documents(spark, sf_dir).select("docid"), "docid", "left_anti")


def simplex_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weights of the grid with the mean score of the matches under them."""
    mean = _zones(spark, sf_dir).agg(*(F.coalesce(F.avg(f), F.lit(0.0)).alias(f"mean_{f}") for f in FIELDS))  # one row
    score = sum((F.col(w) * F.col(f"mean_{f}") for w, f in zip("abcd", FIELDS, strict=True)), F.lit(0.0))
    found = learning.simplex(spark).crossJoin(F.broadcast(mean)).select("g", "a", "b", "c", "d", score.alias("score"))
    return rounded(found, "score")


def zone_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.zone_grid(_zones(spark, sf_dir), qrels(spark, sf_dir), topics(spark, sf_dir)), "f1")


def argmax_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.first_best(learning.zone_grid(_zones(spark, sf_dir), qrels(spark, sf_dir), topics(spark, sf_dir), any_term=True)), "f1")


def bm25_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = learning.odd_even(topics(spark, sf_dir)).filter("split = 'train'").drop("split")
    return rounded(learning.bm25_grid_of(body_index(spark, sf_dir), qrels(spark, sf_dir), train), "ap")


def run_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.run_faults(ranking.padded(scoring.weighted(_zones(spark, sf_dir), WEIGHTS), documents(spark, sf_dir), topics(spark, sf_dir), DEPTH), DEPTH)


def tie_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Pairs of one topic with the same shares are counted where they lie; only these counts meet.
    alike = scoring.alike(full_index(spark, sf_dir), topics(spark, sf_dir))
    each = scoring.weighted(alike, WEIGHTS, kept="n").groupBy("qid", "score").agg(F.sum("n").alias("n")).withColumn("best", F.max("score").over(Window.partitionBy("qid")))
    near = F.when(F.abs(F.col("score") - F.col("best")) < 1e-12, F.col("n")).otherwise(0)
    return rounded(each.groupBy("qid", "best").agg(F.count(F.lit(1)).alias("distinct_scores"), F.sum(near).alias("top_ties")), "best")


def score_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _zones(spark, sf_dir)
    return rounded(z.agg(F.count(F.lit(1)).alias("pairs"), *(F.avg((F.col(f) > 0).cast("double")).alias(f"match_{f}") for f in FIELDS)), *(f"match_{f}" for f in FIELDS))


def split_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.seeded_split(spark, sorted(r[0] for r in topics(spark, sf_dir).select("qid").collect()))


def _three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.pmod("qid", F.lit(5))
    return topics(spark, sf_dir).select("qid", F.when(part < 3, "train").when(part == 3, "validation").otherwise("test").alias("split"))


def _part(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return topics(spark, sf_dir).join(small(_three_way(spark, sf_dir).filter(F.col("split") == name).select("qid")), "qid", "left_semi")


def _classes(rows: DataFrame | learning.Pairs) -> DataFrame:
    """(label, pairs, weight) of the rows to train on."""
    if isinstance(rows, learning.Pairs):
        session = rows.table.sparkSession
        return session.createDataFrame([(label, n, float(w)) for label, (n, w) in rows.classes.items()], "label double, pairs bigint, weight double")
    return rows.groupBy("label").agg(F.sum("n").alias("pairs"), F.sum("weight").alias("weight"))


def _counts(rows: DataFrame | learning.Pairs) -> DataFrame:
    """One row: pairs, and those that are relevant."""
    return F.broadcast(_classes(rows).agg(F.sum("pairs").alias("pairs"), F.sum(F.when(F.col("label") > 0, F.col("pairs")).otherwise(0)).alias("relevant")))


def _training(spark: SparkSession, sf_dir: str, idx: index.Index, *parts: str, judged: DataFrame | None = None) -> DataFrame | learning.Pairs:
    """The rows to train on: every pair of topic and document of the topics of the given parts, else of the training topics."""
    names = _three_way(spark, sf_dir).filter(F.col("split").isin(*(parts or ("train",))))
    q, j = topics(spark, sf_dir).join(small(names.select("qid")), "qid", "left_semi"), qrels(spark, sf_dir) if judged is None else judged
    rows = learning.in_rows(idx, q, j)
    if rows is not None:
        return rows
    bare = features.bare_features(idx)
    v = stored(features.feature_vectors(idx, q), "features")  # read for the counts and for the rows
    return learning.labelled(v, j, learning.unmatched(v, bare, j, q))


def svm_alpha_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f1 at 10 over the validation topics for all eight alphas."""
    idx, j = full_index(spark, sf_dir), qrels(spark, sf_dir)
    rows = _training(spark, sf_dir, idx, judged=j)
    if isinstance(rows, learning.Pairs):
        validation = _part(spark, sf_dir, "validation")
        fits = learning.svm_path(rows, learning.ALPHAS)
        ranked = learning.rank_in_rows(idx, validation, [(f.weights, f.intercept) for f in fits], 10)
        trials = learning.trials(fits, ranked, j, validation)
        return spark.createDataFrame(trials, "alpha double, f1 double")
    bare = stored(features.bare_features(idx), "bare")
    vectors = stored(features.feature_vectors(idx, topics(spark, sf_dir).filter(F.pmod("qid", F.lit(5)) < 4)), "features")
    train, held = _part(spark, sf_dir, "train"), _part(spark, sf_dir, "validation")
    of = lambda part: vectors.join(small(part.select("qid")), "qid", "left_semi")
    trials, _, _ = learning.choose_alpha(of(train), of(held), bare, j, train, held)
    return spark.createDataFrame(trials, "alpha double, f1 double")


#: A fit's certificate: its objectives may differ by so much.
GAP = 1e-6


def svm_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every alpha the pairs it was fitted to and whether the dual proves its loss to be the least but for ``GAP``."""
    rows = _training(spark, sf_dir, full_index(spark, sf_dir))
    pairs = _counts(rows)
    found = learning.objectives(spark, learning.svm_path(rows, learning.ALPHAS))
    proved = (F.col("gap") <= GAP * F.greatest(F.col("primal"), F.lit(1.0))) & (F.col("gap") > -GAP)
    return found.select("alpha", proved.alias("optimal")).crossJoin(pairs)


#: What the queries of one model take; the grid above is about the choice.
ALPHA = 0.01


def _model(spark: SparkSession, sf_dir: str) -> tuple[list[float], float]:
    return learning.fit_svms(_training(spark, sf_dir, full_index(spark, sf_dir)), (ALPHA,))[0]


def svm_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(zip(features.feature_names(), _model(spark, sf_dir)[0], strict=True)), "feature string, weight double")


def svm_train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, write a bundle, read it and rank all documents for topics that were not trained on."""
    path = f"{folder(spark)}/bundle"
    learning.save_bundle(spark, path, *_model(spark, sf_dir), WEIGHTS, {"alpha": ALPHA, "features": features.feature_names()})
    return rounded(workflow.predict(spark, path, full_index(spark, sf_dir), _part(spark, sf_dir, "test"), 10), "score")


def svm_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of each feature over all pairs of training topics and documents."""
    rows = _training(spark, sf_dir, full_index(spark, sf_dir))
    mean, std = learning.scaler(rows)
    return rounded(spark.createDataFrame([(f, float(m), float(d)) for f, m, d in zip(features.feature_names(), mean, std, strict=True)], "feature string, mean double, deviation double"), "mean", "deviation", places=5)


#: Fixed weights of the decision query: three features of each field.
DECISION = {"query_term_ratio": 1.5, "bm25": 0.25, "stream_length": -0.001}


def linear_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of all documents by given weights, documents that match nowhere too."""
    idx = full_index(spark, sf_dir)
    w = [DECISION.get(f.split(".")[1], 0.0) for f in features.feature_names()]
    ranked = learning.rank_in_rows(idx, topics(spark, sf_dir), [(w, -0.5)], 10)
    if ranked is not None:
        return rounded(ranked.drop("g"), "score")
    scores = learning.linear_scores(features.feature_vectors(idx, topics(spark, sf_dir)), w, -0.5)
    return rounded(learning.rank_all(scores, learning.linear_scores(features.bare_features(idx), w, -0.5), topics(spark, sf_dir), 10), "score")


def model_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of linear_decision by a pipeline that was saved and loaded; an error if the topics are not those of its digest."""
    idx, q = full_index(spark, sf_dir), topics(spark, sf_dir)
    w = [DECISION.get(f.split(".")[1], 0.0) for f in features.feature_names()]
    path = f"{folder(spark)}/pipeline"
    PipelineModel([model.ranker(w, -0.5, {"topics": q})]).write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    if loaded.stages[-1].changed({"topics": q}):
        raise ValueError("the topics differ from those of the model")
    ranked = model.rank_in_rows(loaded, idx, q, 10)
    return rounded(model.rank(loaded, features.feature_vectors(idx, q), features.bare_features(idx), q, 10) if ranked is None else ranked, "score")


def svm_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs, and the weight of each, by label."""
    rows = _training(spark, sf_dir, full_index(spark, sf_dir))
    return rounded(_classes(rows), "weight")


def collection_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a tagged file and read back by the fielded reader; line ends in a field are blanks."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    d = documents(spark, sf_dir).select("docid", *(flat(F.col(f)).alias(f) for f in FIELDS))
    path = folder(spark)
    sinks.write_lines(d.select("docid", F.concat(F.lit(".I "), F.col("docid").cast("string"), *(F.concat(F.lit(f"\n{tag}\n"), F.regexp_replace(F.col(f), r"(?m)^\.", "·")) for tag, f in collection.TAGS.items())).alias("line")), path, ["docid"])
    return collection.read_collection(spark, path).select("docid", *(F.octet_length(f).cast("bigint").alias(f) for f in FIELDS))


def processed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged titles and bodies analyzed, written as a processed file and read back."""
    path = folder(spark)
    sinks.write_processed(workflow.analyze(documents(spark, sf_dir), Analyzer(possessive=True)), path)
    return collection.read_processed(spark, path).select("docid", F.array_join("tokens", " ").alias("tokens"))


def index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as a text file, read back."""
    path = folder(spark)
    sinks.write_postings(tallies.posted(documents(spark, sf_dir), BOOLEAN), path)  # documents counted in their rows
    return collection.read_index(spark, path)


def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three frequent terms, three rare ones and one that is nowhere, looked up in a saved index."""
    path, idx = folder(spark), full_index(spark, sf_dir)
    idx.save(path)
    body = idx.df.filter("field = 'body'")
    terms = [r[0] for order in (F.desc("df"), F.asc("df")) for r in body.orderBy(order, "term").limit(3).select("term").collect()]
    return index.lookup(spark, path, "body", (*terms, "nothinglikethis"))


def topic_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics written as a tagged file, read back: places from 1 and labels."""
    path = folder(spark)
    t = topics(spark, sf_dir)
    line = F.concat(F.lit(".I "), F.format_string("%03d", F.col("qid").cast("bigint")), F.lit("\n.W\n"), F.trim(F.regexp_replace(F.coalesce("query", F.lit("")), r"\s+", " ")))
    t.orderBy("qid").select(line.alias("line")).coalesce(1).write.text(path)  # topics are few and their places count
    return collection.read_topics(spark, path)


def judgement_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements written as codes and read back as gains and as binary labels."""
    path = folder(spark)
    j = qrels(spark, sf_dir)
    sinks.write_lines(j.select("qid", "docid", F.concat_ws(" ", "qid", "docid", (5 - F.col("label")).cast("string"), F.lit("")).alias("line")), path, ["qid", "docid"])
    return collection.read_graded(spark, path).join(collection.read_binary(spark, path).withColumnRenamed("label", "relevant"), ["qid", "docid"])


def fault_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, fault, n) of a collection and a file of judgements made faulty from the tables: ids that repeat or are
    no number, texts left out, codes, topics and documents that there are not, and lines cut short."""
    d, paths = documents(spark, sf_dir), (folder(spark), folder(spark))
    flat = F.regexp_replace(F.regexp_replace("body", r"\s+", " "), r"^\.", "·")
    head = F.when(F.col("docid") % 50 == 7, "none").otherwise((F.col("docid") - F.when(F.col("docid") % 50 == 3, 1).otherwise(0)).cast("string"))
    record = F.concat(F.lit(".I "), head, F.lit("\n.W\n"), F.when(F.col("docid") % 40 != 5, flat).otherwise(""))
    sinks.write_lines(d.select("docid", record.alias("line")), paths[0], ["docid"])
    # Every label is a judgement of twice its document; each seventh one stands twice, each tenth has no code.
    x = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("x"), F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 7 == 0).cast("int"))))
    line = F.concat_ws(" ", F.col("x") % 50, F.col("x") * 2, F.when(F.col("x") % 10 != 0, (F.col("x") % 8 - 1).cast("string")))
    sinks.write_lines(x.select("x", line.alias("line")), paths[1], ["x"])
    _, read = checked.collection(spark, paths[0], strict=False)
    _, judged = checked.judgements(spark, paths[1], d, topics(spark, sf_dir), strict=False)
    rows = [(source, fault, n) for source, counts in (("collection", read), ("judgements", judged)) for fault, n in counts.items()]
    return spark.createDataFrame(rows, "source string, fault string, n bigint")


def reader_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagged file with text beside tags and tags after the body, as each of the three readers takes it: bytes of fields and a digest of all."""
    flat = lambda c: F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"^\.", "·")
    lang, path = flat(F.coalesce("bibliography", F.lit(""))), folder(spark)
    record = F.concat_ws("\n", F.concat(F.lit(".I "), F.col("docid").cast("string")), F.concat(F.lit(".T in "), lang), flat(F.col("title")), F.lit(".A"), flat(F.col("author")), F.lit(".B extra"), lang, F.lit(".W"), flat(F.col("body")), F.lit(".A tail"), F.lit(".T again"))
    sinks.write_lines(documents(spark, sf_dir).select("docid", record.alias("line")), path, ["docid"])
    out = None
    for form in collection.FORMS:
        d = collection.read_collection(spark, path, form=form)
        one = d.select(F.lit(form).alias("form"), "docid", *(F.octet_length(f).cast("bigint").alias(f) for f in FIELDS), F.sha2(F.concat_ws("|", *FIELDS), 256).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


def stop_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 words of most documents as a stop list, written in capitals several to a line, read, and taken out of the texts."""
    words = documents(spark, sf_dir).select("docid", F.explode(text.alnum(F.col("body"))).alias("term")).distinct()
    most = words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(25)
    path = folder(spark)
    most.select(F.concat_ws(", ", F.upper("term"), "term").alias("value")).write.text(path)
    stop = collection.read_stop(spark, path)
    t = documents(spark, sf_dir).select("docid", text.alnum(F.col("body")).alias("all"), Analyzer(stop=stop).terms(F.col("body")).alias("kept"))
    return t.select("docid", F.size("all").cast("bigint").alias("tokens"), F.array_join("kept", " ").alias("kept"))


def boolean_query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of the topics' first two words, written as a file with blank lines and blanks around, read and answered."""
    w = F.split(F.trim(F.regexp_replace(F.coalesce("query", F.lit("")), r"\s+", " ")), " ")
    asked = F.concat(F.lit("  "), F.get(w, F.lit(0)), F.when(F.col("qid") % 2 == 0, " and ").otherwise(" OR "), F.get(w, F.lit(1)), F.lit(" "))
    path = folder(spark, "queries")
    sinks.write_file(topics(spark, sf_dir).select("qid", F.coalesce(F.when(F.col("qid") % 5 != 0, asked), F.lit("  ")).alias("line")), path, ["qid"])
    found = boolean.search(body_index(spark, sf_dir, BOOLEAN).tf, collection.read_queries(spark, path))
    return found.select("query_id", "op", "left", "right", F.size("docids").cast("bigint").alias("n"), F.array_join("docids", " ").alias("docids"))


def index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of a written index file and the places of their lines; the header has the first."""
    path = folder(spark)
    sinks.write_index(body_index(spark, sf_dir, BOOLEAN).tf, path)
    lines = collection.placed_lines(spark, path)
    return lines.select("place", F.when(F.col("place") == 1, F.col("value")).otherwise(F.substring_index("value", " ", 1)).alias("term"))


#: The report's settings, and what its file changes of them.
REPORT, REPORT_CHANGES = {"depth": 1000, "decimals": {"place": -1, "name": -1, "AP": 4, "P@5": 4, "RR": 4}}, {"depth": DEPTH, "decimals": {"place": -1, "name": -1, "AP": 4, "nDCG@10": 3, "P@10": 2, "RR": 5}}


def model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weighting models' measures, written as CSV and read again, as the lines of a table with
    the change of AP and nDCG@10 from the models' mean; settings come from a file laid over defaults."""
    config, path = folder(spark), folder(spark)
    sinks.write_json(spark, REPORT_CHANGES, config)
    settings = collection.read_config(spark, config, REPORT)
    sinks.write_csv(workflow.experiments(body_index(spark, sf_dir), topics(spark, sf_dir), qrels(spark, sf_dir), depth=settings["depth"]), path)
    # Columns as experiments() has them.
    table = collection.read_table(spark, path, ", ".join([*(f"`{m}` double" for m in evaluation.METRICS), "name string", "place int"]))
    means = F.broadcast(table.agg(F.avg("AP").alias("mean AP"), F.avg("`nDCG@10`").alias("mean nDCG")))  # one row
    return reports.lines(table.crossJoin(means), "place", settings["decimals"], {"AP": "mean AP", "nDCG@10": "mean nDCG"})


def model_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each weighting model's run at the depth, and whether a time was taken for it in all and for a topic."""
    idx, q = body_index(spark, sf_dir), topics(spark, sf_dir)
    n, rows = q.count(), []
    known = tallies.tallied(idx, q, idx.fields)  # counted once for all models
    for m in scoring.MODELS:
        scores = (lambda m=m: scoring.score(idx, q, m)) if known is None else (lambda m=m: places.first(places.scores(*known, q, (m, 1.2, 0.75)), DEPTH))
        found, seconds, each = reports.timed(lambda scores=scores: ranking.rank(scores(), DEPTH), n)
        rows.append((m, found, seconds > 0 and abs(each * n / 1000 - seconds) < 1e-9 * max(1, n)))
    return spark.createDataFrame(rows, "model string, rows bigint, timed boolean")


def refit_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model for use, fitted to training and validation topics alike: its pairs, and whether the dual proves its loss to be the least."""
    rows = _training(spark, sf_dir, full_index(spark, sf_dir), "train", "validation")
    pairs = _counts(rows)
    found = learning.objectives(spark, learning.svm_path(rows, (ALPHA,)))
    proved = (F.col("gap") <= GAP * F.greatest(F.col("primal"), F.lit(1.0))) & (F.col("gap") > -GAP)
    return found.select("alpha", proved.alias("optimal")).crossJoin(pairs)


def boolean_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer blocks of all accepted queries as written."""
    q = spark.createDataFrame(list(BOOLEAN_QUERIES), "query_id bigint, query string")
    path = folder(spark)
    if not sinks.write_answers(boolean.search(body_index(spark, sf_dir, BOOLEAN).tf, q), path):
        raise ValueError("no query was parsed")
    return spark.read.text(path).filter("value <> ''").groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def _written(spark: SparkSession, sf_dir: str, model: str = "bm25") -> DataFrame:
    labels = topics(spark, sf_dir).select("qid", F.format_string("%05d", F.col("qid").cast("bigint")).alias("original_id"))
    path = folder(spark)
    sinks.write_run(ranking.run_lines(ranking.rank(scoring.score(body_index(spark, sf_dir), topics(spark, sf_dir), model), DEPTH), "lexispark", 9, labels), path)
    return verify.numbered(collection.read_run(spark, path), labels)


def run_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run written as a single file, read back with the place of each line in it."""
    path = folder(spark, "run")
    sinks.write_run(ranking.run_lines(_run(spark, sf_dir, 10), "lexispark", 6), path, single=True)
    # One file of a few topics' lines: one split keeps their order.
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("at", "line"))
    return lines.select((F.col("at") + 1).cast("bigint").alias("place"), "line")


def table_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the ranker's inputs, and whether a table dealt out in another order has the same digest."""
    out = None
    for name, t in (("topics", topics(spark, sf_dir)), ("judgements", qrels(spark, sf_dir))):
        one = reports.table_digest(t).join(F.broadcast(reports.table_digest(t.repartition(3)).select(F.col("digest").alias("again"))), F.col("digest") == F.col("again"), "left")
        one = one.select(F.lit(name).alias("name"), "rows", F.col("again").isNotNull().alias("same"), F.length("digest").alias("size"))
        out = one if out is None else out.unionByName(one)
    return out


def run_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures counted again from a written run, beside those of the run that was written."""
    q, j = topics(spark, sf_dir), qrels(spark, sf_dir)
    reported = evaluation.macro(evaluation.prf(_run(spark, sf_dir), j, q), "k")
    return rounded(verify.recheck(_written(spark, sf_dir), j, q, reported), "reported", "found")


def run_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of two runs with different documents."""
    a, b = (ranking.rank(scoring.score(body_index(spark, sf_dir), topics(spark, sf_dir), m), 20) for m in ("bm25", "tf"))
    return verify.disagreements(a, b)


def split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of a split with a topic in two parts, one in none and an unknown one."""
    bad = _three_way(spark, sf_dir).filter("qid <> 3").unionByName(spark.createDataFrame([(1, "test"), (2, "test"), (-7, "train")], "qid bigint, split string"))
    return verify.split_faults(bad, topics(spark, sf_dir))


def split_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three_way(spark, sf_dir)


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.experiments(body_index(spark, sf_dir), topics(spark, sf_dir), qrels(spark, sf_dir), ("tf", "tf_idf", "bm25"), DEPTH).select("name", "place", F.col("AP").alias("ap"), F.col("`nDCG@10`").alias("ndcg_10"))


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by average precision, best first."""
    return rounded(_models(spark, sf_dir), "ap", "ndcg_10")


def model_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread and best of the models by family, which the names tell."""
    t = _models(spark, sf_dir).withColumn("family", F.when(F.col("name").startswith("bm25"), "bm25").otherwise("tf"))
    return rounded(reports.spread(t, "family", "ap"), "spread")


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of the BM25 grid by the controls in their names, with the change from the best setting's precision to theirs."""
    grid = stored(bm25_grid_search(spark, sf_dir), "grid")  # read for the best and for all
    name = F.concat(F.lit("bm25(k_1="), F.col("k1").cast("string"), F.lit(", b="), F.col("b").cast("string"), F.lit(")"))
    best = F.broadcast(grid.agg(F.greatest(F.max("ap"), F.lit(1e-6)).alias("best")))  # one row
    t = grid.select(name.alias("name"), "ap").crossJoin(best)
    return reports.change(reports.within(reports.named(t, "bm25(", ")"), (1.0, 1.4), (0.3, 0.6)), "best", "ap").select("name", "k1", "b", "change")


def variant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprocessing variants of bodies alone beside the same of all fields."""
    g = stored(preprocessing_grid(spark, sf_dir), "grid").withColumn("name", F.regexp_replace("variant", "^[a-z_]+?__", ""))
    a, b = (reports.named(g, f"{x}__", "", "variant").select("name", "terms", "tokens") for x in ("text", "all"))
    return reports.beside(a, b)


def top_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three features that add most to the decision of given weights, on average over the matches."""
    w = {f: x for f in features.feature_names() if (x := DECISION.get(f.split(".")[1], 0.0))}
    mean = features.means(full_index(spark, sf_dir), topics(spark, sf_dir), list(w))
    weight = F.element_at(F.create_map(*(F.lit(v) for x in w.items() for v in x)), F.col("feature")) * F.col("mean")
    return rounded(reports.largest(mean.select("feature", weight.alias("weight"))), "weight")


def input_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("docid", reports.digest(F.col("body")).alias("sha256"))


def mean_distinct_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over topics of distinct scores and of documents that share the first place."""
    t = tie_diagnostics(spark, sf_dir)
    return rounded(t.agg(F.avg("distinct_scores").alias("distinct_scores"), F.avg("top_ties").alias("top_ties")), "distinct_scores", "top_ties")


def id_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, ids, judged pairs, topics and documents that are judged."""
    d = documents(spark, sf_dir).agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("docid").alias("ids"))
    j = qrels(spark, sf_dir).agg(F.count(F.lit(1)).alias("judged"), F.count_distinct("qid").alias("judged_topics"), F.count_distinct("docid").alias("judged_documents"))
    return d.crossJoin(F.broadcast(j))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    run = [
        rank_top10, token_stream, token_counts, stage_counts, stop_filter, stop_anti_join, porter_vocabulary, build_postings, posting_blocks, top_by_bounds, blocks_skipped, index_header, tf_table, df_table, field_lengths,
        collection_stats, preprocessing_grid, preprocessing_measures, boolean_and, boolean_common, boolean_bitmaps, boolean_or, boolean_batch, boolean_rejected, clean_topics, *(_score(m) for m in scoring.MODELS), zone_scores, zone_or_scores, equal_zone,
        *(_feature_matrix(f) for f in FIELDS), feature_matrix_all, rank_padded_topk, trec_run, run_label_ids, prf_at_k, macro_prf, ranked_measures, _measure("average_precision", "ap"),
        _measure("ndcg_at_10", "ndcg_10"), _measure("reciprocal_rank", "rr"), _measure("recall_at_100", "r_100"), baseline_better_worse, tuned_vs_default, split_odd_even, split_semi_join, qrels_join_default_zero,
        qrels_coverage_anti, dangling_docs, simplex_grid, zone_grid_search, argmax_first, bm25_grid_search, run_verification, tie_diagnostics, score_diagnostics, split_seeded,
        svm_train_predict, svm_alpha_grid, svm_certificate, svm_weights, svm_scaler, svm_class_counts, linear_decision, model_stage, collection_file, processed_file, index_file, index_lookup, topic_file, judgement_file, fault_counts, reader_forms, stop_list_file, boolean_query_file, index_order, model_report, model_times, refit_certificate,
        boolean_file, run_file, table_digests, run_recheck, run_disagreements, split_check, split_three_way, model_table, model_spread, model_names, variant_pairs, top_coefficients, input_digests, mean_distinct_scores, id_counts,
    ]
    return {f.__name__: f for f in run}
