"""Evaluation of ranked runs against judgements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import significance
from lexispark.operators.index import small

CUTOFFS = (5, 10, 20, 50, 100)
METRICS = ("AP", "nDCG@10", "nDCG@20", "P@5", "P@10", "R@100", "RR")


def judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """A run with label, 0 for pairs without a judgement."""
    return ranked.join(small(qrels.select("qid", "docid", "label")), ["qid", "docid"], "left").fillna(0, ["label"])


def totals(topics: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, relevant) of every topic, 0 for one without positive judgements."""
    n = qrels.filter("label > 0").groupBy("qid").agg(F.count(F.lit(1)).alias("relevant"))
    return topics.select("qid").join(n, "qid", "left").fillna(0, ["relevant"])


def prf(ranked: DataFrame, qrels: DataFrame, topics: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(qid, k, precision, recall, f1): hits over k, hits over all relevant, their harmonic mean for each topic."""
    hits = judged(ranked, qrels).groupBy("qid").agg(*(F.count(F.when((F.col("rank") <= k) & (F.col("label") > 0), 1)).alias(f"h{k}") for k in cutoffs))
    out = totals(topics, qrels).join(hits, "qid", "left").select("qid", "relevant", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(f"h{k}", F.lit(0)).alias("hits")) for k in cutoffs))).alias("x"))
    p, r = F.col("x.hits") / F.col("x.k"), F.when(F.col("relevant") > 0, F.col("x.hits") / F.col("relevant")).otherwise(0.0)
    return out.select("qid", "x.k", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def macro(per_topic: DataFrame, *by: str) -> DataFrame:
    """Means over topics of precision, recall and f1."""
    return per_topic.groupBy(*by).agg(*(F.avg(m).alias(m) for m in ("precision", "recall", "f1")))


def dcg(label: Column, position: Column) -> Column:
    return label / F.log2(position + 1)


def measures(ranked: DataFrame, qrels: DataFrame, topics: DataFrame) -> DataFrame:
    """(qid and each of METRICS): label 1 or more is relevant, the gain of nDCG is the label, a topic without a run scores 0."""
    run = judged(ranked, qrels)
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    good = (F.col("label") > 0).cast("int")
    run = run.withColumn("seen", F.sum(good).over(upto))
    at = lambda k: F.col("rank") <= k
    got = run.groupBy("qid").agg(
        F.sum(F.when(good == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap"),
        *(F.sum(F.when(at(k), dcg(F.col("label"), F.col("rank"))).otherwise(0.0)).alias(f"dcg{k}") for k in (10, 20)),
        *(F.sum(F.when(at(k), good).otherwise(0)).alias(f"h{k}") for k in (5, 10, 100)),
        F.min(F.when(good == 1, F.col("rank"))).alias("first"),
    )
    best = Window.partitionBy("qid").orderBy(F.desc("label"), "docid")
    ideal = qrels.filter("label > 0").withColumn("i", F.row_number().over(best)).groupBy("qid").agg(*(F.sum(F.when(F.col("i") <= k, dcg(F.col("label"), F.col("i"))).otherwise(0.0)).alias(f"ideal{k}") for k in (10, 20)))
    out = totals(topics, qrels).join(got, "qid", "left").join(ideal, "qid", "left")
    over = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    return out.select("qid", over("ap", "relevant").alias("AP"), over("dcg10", "ideal10").alias("nDCG@10"), over("dcg20", "ideal20").alias("nDCG@20"), *(F.coalesce(F.col(f"h{k}") / k, F.lit(0.0)).alias(f"P@{k}") for k in (5, 10)), over("h100", "relevant").alias("R@100"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("RR"))


def compare(baseline: DataFrame, other: DataFrame, metric: str) -> DataFrame:
    """One row: topics, better, worse, mean difference and its t value, of a measure by qid."""
    d = other.select("qid", F.col(metric).alias("y")).join(baseline.select("qid", F.col(metric).alias("x")), "qid").withColumn("d", F.round(F.col("y") - F.col("x"), 12))
    out = d.agg(F.count(F.lit(1)).alias("topics"), F.count(F.when(F.col("d") > 0, 1)).alias("better"), F.count(F.when(F.col("d") < 0, 1)).alias("worse"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return out.select("topics", "better", "worse", "mean", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("topics"))).alias("t"))


def by_measure(per_topic: DataFrame) -> DataFrame:
    """(qid, measure, value) of what ``measures`` returns."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").alias("value")) for m in METRICS)))
    return per_topic.select("qid", each.alias("x")).select("qid", "x.*")


def comparisons(baseline: DataFrame, other: DataFrame, sets: DataFrame) -> DataFrame:
    """A row for each set of topics in ``sets`` (set, qid) and each measure: both
    means, topics better and worse, the paired t value, its p and that of the sign test.

    Differences below twelve places are none; t and p are null where all
    differences are equal. All comparisons are one job.
    """
    pairs = by_measure(baseline).withColumnRenamed("value", "x").join(by_measure(other).withColumnRenamed("value", "y"), ["qid", "measure"])
    d = pairs.join(small(sets.select("set", "qid")), "qid").withColumn("d", F.round(F.col("y") - F.col("x"), 12))
    out = d.groupBy("set", "measure").agg(
        F.count(F.lit(1)).alias("topics"), F.avg("x").alias("baseline"), F.avg("y").alias("other"),
        F.count(F.when(F.col("d") > 0, 1)).alias("better"), F.count(F.when(F.col("d") < 0, 1)).alias("worse"),
        F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"),
    )
    out = out.withColumn("t", F.when(F.col("sd") > 1e-12, F.col("mean") / (F.col("sd") / F.sqrt("topics"))))
    p = significance.t_test(F.col("t"), F.col("topics"))
    sign = significance.sign_test(F.col("better"), F.col("worse"))
    return out.select("set", "measure", "topics", "baseline", "other", "better", "worse", "t", p.alias("p"), sign.alias("sign_p"))


def sign_test(better: int, worse: int) -> float:
    """Exact two-sided sign test."""
    n, low = better + worse, min(better, worse)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n)


def t_test(t: float, n: int) -> float:
    """Two-sided p of a t value with n - 1 degrees of freedom, by the continued fraction of the incomplete beta function."""
    v = n - 1
    x = v / (v + t * t)
    a, b = v / 2, 0.5
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = (b, a, 1 - x) if flip else (a, b, x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    p = front * (f - 1)
    return 1 - p if flip else p


def check_judgements(qrels: DataFrame, topics: DataFrame, docs: DataFrame) -> None:
    """Judgements must cover exactly the topics and know only documents of the collection."""
    if not qrels.join(topics, "qid", "left_anti").isEmpty() or not topics.join(qrels, "qid", "left_anti").isEmpty():
        raise ValueError("judgements must cover exactly the topics")
    if not qrels.filter("label > 0").join(docs, "docid", "left_anti").isEmpty():
        raise ValueError("judgements name documents outside the collection")
