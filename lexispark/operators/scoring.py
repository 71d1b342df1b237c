"""Weighting models over an index of one field, and zone scores over all."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import Analyzer
from lexispark.operators import tallies
from lexispark.operators.index import FIELDS, Index, bounded, small, stemmed

MODELS = ("tf", "tf_idf", "lemur_tf_idf", "bm25_engine", "bm25", "cosine")


def topic_terms(topics: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(qid, term, qtf); topics without a term have no row."""
    terms = topics.select("qid", F.explode(analyzer.terms(F.col("query"))).alias("term"))
    out = stemmed(terms, analyzer).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    # Read several times; stemming is worth keeping.
    return out if analyzer.stemmer == "none" else out.persist(StorageLevel.MEMORY_AND_DISK)


def topic_sizes(topics: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, n): distinct terms of every topic, in the collection or not."""
    n = terms.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return topics.select("qid").join(n, "qid", "left").fillna(0, ["n"])


def term_weight(model: str, k1: Column, b: Column, k3: float = 8.0) -> Column:
    """The share of one term in a score, from tf, qtf, df, len, n and avg.

    tf_idf, lemur_tf_idf and bm25_engine follow their published definitions
    (logarithms to base 2); bm25 is the variant with ln(1 + ...), which is
    never negative.
    """
    tf, qtf, df, n = (F.col(c).cast("double") for c in ("tf", "qtf", "df", "n"))
    norm = k1 * (1 - b + b * F.col("len") / F.col("avg"))
    if model == "tf":
        return tf
    if model == "tf_idf":
        return qtf * (k1 * tf / (tf + norm)) * F.log2(n / df + 1)
    if model == "lemur_tf_idf":
        return qtf * (k1 * tf / (tf + norm)) * F.pow(F.log2(n / df), F.lit(2.0))
    if model == "bm25_engine":
        return F.log2((n - df + 0.5) / (df + 0.5)) * ((k1 + 1) * tf / (norm + tf)) * ((k3 + 1) * qtf / (k3 + qtf))
    if model == "bm25":
        return F.log1p((n - df + 0.5) / (df + 0.5)) * (k1 + 1) * tf / (tf + norm)
    raise ValueError(f"unknown model {model}")


def matches(index: Index, terms: DataFrame) -> DataFrame:
    """(qid, docid, term, qtf, tf, df, len, n, avg) of the terms that a document has.

    The topics' terms are few and go to the postings; document lengths join
    only what matched.
    """
    found = tallies.matches(index, terms)
    if found is not None:
        return found
    known = bounded(index.df.join(small(terms), "term"), terms)  # a term has one row in df
    found = index.tf.join(known, "term").join(index.dl, "docid")
    return found.crossJoin(F.broadcast(index.stats.select("n", "avg")))  # one row


def score(index: Index, topics: DataFrame, model: str = "bm25", k1: float = 1.2, b: float = 0.75, found: DataFrame | None = None) -> DataFrame:
    """(qid, docid, score) of all documents that have a term of a topic."""
    terms = topic_terms(topics, index.analyzer)
    if model == "cosine":
        return cosine(index, terms)
    found = matches(index, terms) if found is None else found
    return found.groupBy("qid", "docid").agg(F.sum(term_weight(model, F.lit(k1), F.lit(b))).alias("score"))


def cosine(index: Index, terms: DataFrame) -> DataFrame:
    """Cosine of (1 + ln tf) * idf vectors, idf = ln((n + 1) / (df + 1)) + 1."""
    n = F.broadcast(index.stats.select("n"))
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    weights = index.df.crossJoin(n).select("term", idf.alias("idf"))
    doc = index.tf.join(weights, "term").select("docid", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norms = doc.groupBy("docid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    query = weights.join(small(terms), "term").select("qid", "term", ((1 + F.log("qtf")) * F.col("idf")).alias("qw"))
    qnorms = query.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dots = doc.join(bounded(query, terms), "term").groupBy("qid", "docid").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return dots.join(norms, "docid").join(bounded(qnorms, terms), "qid").select("qid", "docid", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))


def zones(index: Index, topics: DataFrame) -> DataFrame:
    """(qid, docid, title, author, bibliography, body): the share of a topic's
    distinct terms that each field has. Pairs without any match are left out;
    all their shares are 0."""
    found = tallies.shares(index, topics, FIELDS)
    if found is not None:
        return found
    terms = topic_terms(topics, index.analyzer)
    n = topic_sizes(topics, terms)
    hit = index.tf.join(small(terms), "term").groupBy("qid", "docid").agg(*(F.sum((F.col("field") == f).cast("int")).alias(f) for f in FIELDS))
    return hit.join(small(n), "qid").select("qid", "docid", *((F.col(f) / F.greatest("n", F.lit(1))).alias(f) for f in FIELDS))


def alike(index: Index, topics: DataFrame) -> DataFrame:
    """(qid, title, author, bibliography, body, n): the shares of ``zones`` and how many documents have them."""
    found = tallies.share_counts(index, topics, FIELDS)
    return zones(index, topics).groupBy("qid", *FIELDS).agg(F.count(F.lit(1)).alias("n")) if found is None else found


def weighted(zone: DataFrame, weights: tuple[float, ...], any_term: bool = False, kept: str = "docid") -> DataFrame:
    """(qid, docid, score): fields are added in order. ``any_term``: a field counts in full for any match; ``kept``: a column in the place of docid."""
    total = F.lit(0.0)
    for f, w in zip(FIELDS, weights, strict=True):
        total = total + F.lit(float(w)) * (F.when(F.col(f) > 0, 1.0).otherwise(0.0) if any_term else F.col(f))
    return zone.select("qid", kept, F.round(total, 12).alias("score"))


def equal_zone(zone: DataFrame) -> DataFrame:
    return zone.select("qid", "docid", F.round(sum((F.col(f) for f in FIELDS), F.lit(0.0)) / len(FIELDS), 12).alias("score"))
