"""Two-term Boolean search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.porter import stem
from lexispark.functions.text import first_term
from lexispark.operators.index import small


def parse(queries: DataFrame) -> DataFrame:
    """(query_id, query, left, op, right, ok): ok has three parts, the middle AND or OR in any case."""
    parts = F.split(F.trim("query"), r"\s+")
    at = lambda i: F.get(parts, F.lit(i))
    ok = (F.size(parts) == 3) & F.coalesce(F.upper(at(1)).isin("AND", "OR"), F.lit(False))
    return queries.select("query_id", "query", at(0).alias("left"), F.upper(at(1)).alias("op"), at(2).alias("right"), ok.alias("ok"))


def rejected(queries: DataFrame) -> DataFrame:
    """Queries that parse() does not accept; a batch goes on without them."""
    return parse(queries).filter("not ok").select("query_id", "query")


def stemmed(queries: DataFrame, stemmer: str = "porter_all") -> DataFrame:
    """(query_id, query, op, left, right) of accepted queries: each word's first piece, stemmed."""
    q = parse(queries).filter("ok").select("query_id", "query", "op", first_term(F.col("left")).alias("left"), first_term(F.col("right")).alias("right"))
    stems = stem(q.select(F.col("left").alias("term")).union(q.select("right")).distinct(), stemmer=stemmer)
    for side in ("left", "right"):
        q = q.join(stems.select(F.col("term").alias(side), F.col("stem").alias(f"{side}_stem")), side).drop(side).withColumnRenamed(f"{side}_stem", side)
    return q.select("query_id", "query", "op", "left", "right")


def search(tf: DataFrame, queries: DataFrame, stemmer: str = "porter_all") -> DataFrame:
    """(query_id, query, op, left, right, docids) for accepted queries.

    Words are normalized to their first piece and stemmed; stop words are not
    taken out. An absent term has no documents. A query's answer is found by
    counting its terms in each document, so no posting list is one row.
    """
    q = stemmed(queries, stemmer)
    terms = q.select("query_id", "op", F.explode(F.array_distinct(F.array("left", "right"))).alias("term"), F.when(F.col("left") == F.col("right"), 1).otherwise(2).alias("need"))
    hits = tf.select("term", "docid").distinct().join(small(terms), "term").groupBy("query_id", "op", "need", "docid").agg(F.count(F.lit(1)).alias("n"))
    hits = hits.filter((F.col("op") == "OR") | (F.col("n") == F.col("need")))
    answers = hits.groupBy("query_id").agg(F.sort_array(F.collect_list("docid")).alias("docids"))
    return q.join(answers, "query_id", "left").withColumn("docids", F.coalesce("docids", F.array().cast("array<bigint>")))


def answer_blocks(answers: DataFrame) -> DataFrame:
    """(query_id, line): the text block of each answer, after an empty line but for the first."""
    block = F.concat_ws("\n", F.concat(F.lit("Query: "), F.trim("query")), F.concat_ws(" ", F.lit("Stemmed query:"), "left", "op", "right"), F.concat(F.lit("Matched documents: "), F.size("docids").cast("string")), F.array_join("docids", " "))
    first = answers.agg(F.min("query_id").alias("first"))
    return answers.crossJoin(F.broadcast(first)).select("query_id", F.concat(F.when(F.col("query_id") == F.col("first"), "").otherwise("\n"), block).alias("line"))
