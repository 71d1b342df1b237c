"""Checks of written runs and of splits, from the files and not from what made them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators import evaluation


def numbered(run: DataFrame, labels: DataFrame) -> DataFrame:
    """A run as read (original_id, docid, rank, ...) with the qid of each label; a label that no topic has is an error."""
    found = run.join(F.broadcast(labels.select("original_id", "qid")), "original_id", "left")
    unknown = F.raise_error(F.concat(F.lit("no topic is labelled "), F.col("original_id"))).cast("bigint")
    return found.withColumn("qid", F.coalesce("qid", unknown))


def recheck(run: DataFrame, qrels: DataFrame, topics: DataFrame, reported: DataFrame, cutoffs: tuple[int, ...] = evaluation.CUTOFFS) -> DataFrame:
    """(k, measure, reported, found, ok): means of precision, recall and f1 counted
    again from a run, beside those reported (k, precision, recall, f1)."""
    again = evaluation.macro(evaluation.prf(run, qrels, topics, cutoffs), "k")
    long = lambda df, name: df.select("k", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias(name)) for m in ("precision", "recall", "f1")))).alias("x")).select("k", "x.*")
    both = long(reported, "reported").join(long(again, "found"), ["k", "measure"], "full")
    return both.withColumn("ok", F.coalesce(F.abs(F.col("reported") - F.col("found")) < 1e-12, F.lit(False)))


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, rank, a, b) of the places where two runs have another document, or only one has any."""
    x, y = (df.select("qid", "rank", F.col("docid").alias(n)) for df, n in ((a, "a"), (b, "b")))
    return x.join(y, ["qid", "rank"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))


def split_faults(split: DataFrame, topics: DataFrame) -> DataFrame:
    """One row: topics in several parts, topics in none, and topics of the split that are not known; all 0 in a good split."""
    parts = split.groupBy("qid").agg(F.count_distinct("split").alias("parts"))
    both = topics.select("qid").distinct().withColumn("known", F.lit(True)).join(parts, "qid", "full")
    return both.agg(F.count(F.when(F.col("parts") > 1, 1)).alias("in_several"), F.count(F.when(F.col("parts").isNull(), 1)).alias("in_none"), F.count(F.when(F.col("known").isNull(), 1)).alias("unknown"))
