"""Ranks, top k, padding, and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.operators import places


def rank(scores: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, docid, score, rank): descending scores, compared to 9 places, below which sums depend on their order; ties go to the lower docid."""
    if k is not None and k < 1:
        raise ValueError("k must be at least 1")
    by = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "docid")
    out = scores.withColumn("rank", F.row_number().over(by))
    return out.filter(F.col("rank") <= k) if k else out


def padded(scores: DataFrame, docs: DataFrame, topics: DataFrame, k: int) -> DataFrame:
    """The first k documents of all, for scores that are never negative and 0 for pairs without a row.

    Only pairs above 0 are ranked; the rest of a topic is filled with the
    lowest docids that are not among them. The k + (pairs above 0) lowest ids
    would do for any topic; at most k of a topic's pairs matter, so the 2k
    lowest ids are enough, and no topic meets all documents.
    """
    above = scores.filter(F.round("score", 12) > 0)
    whole = all(t in ("bigint", "int") for c, t in above.dtypes if c in ("qid", "docid"))
    top = rank(places.first(above, k) if whole else above, k)  # tasks pass on what can be among the first k
    low = docs.select("docid").distinct().orderBy("docid").limit(2 * k)
    fill = topics.select("qid").crossJoin(F.broadcast(low)).join(top.select("qid", "docid"), ["qid", "docid"], "left_anti")
    return rank(top.select("qid", "docid", "score").unionByName(fill.withColumn("score", F.lit(0.0))), k)


def run_lines(ranked: DataFrame, tag: str, places: int = 9, labels: DataFrame | None = None) -> DataFrame:
    """(qid, rank, line) in the six-column run format; ``labels`` (qid, original_id) puts original topic labels in."""
    name = F.col("qid").cast("string")
    if labels is not None:
        ranked, name = ranked.join(labels, "qid"), F.col("original_id")
    line = F.concat_ws(" ", name, F.lit("Q0"), F.col("docid").cast("string"), F.col("rank").cast("string"), F.format_string(f"%.{places}f", F.col("score").cast("double")), F.lit(tag))
    return ranked.select("qid", "rank", line.alias("line"))


def run_faults(run: DataFrame, k: int) -> DataFrame:
    """(qid, rows, contiguous, monotone, unique_docs, ok) of a run (qid, docid, rank, score)."""
    before = F.lag("score").over(Window.partitionBy("qid").orderBy("rank"))
    seen = run.withColumn("rising", F.col("score") > before + 1e-12)
    out = seen.groupBy("qid").agg(F.count(F.lit(1)).alias("rows"), ((F.min("rank") == 1) & (F.max("rank") == F.count(F.lit(1))) & (F.count_distinct("rank") == F.count(F.lit(1)))).alias("contiguous"), (~F.coalesce(F.max("rising"), F.lit(False))).alias("monotone"), (F.count_distinct("docid") == F.count(F.lit(1))).alias("unique_docs"))
    return out.withColumn("ok", F.col("contiguous") & F.col("monotone") & F.col("unique_docs") & (F.col("rows") == k))
