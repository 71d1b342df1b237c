"""Boolean search by bitmaps of documents, one for each bucket of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.operators.boolean import stemmed
from lexispark.operators.index import small

#: Ids of a bucket: Spark's bitmaps have 4,096 bytes.
BUCKET = 32_768


def search(tf: DataFrame, queries: DataFrame, stemmer: str = "porter_all") -> DataFrame:
    """(query_id, op, left, right, bucket, n, bits): a row for each bucket of ids that has an answer, n of them.

    Words and absent terms are taken as in ``boolean.search``, of which this is
    the form for answers of any length: no list of ids is one row. Postings of
    the queries' terms are dealt by bucket once, in a few numbers each; lists
    are built, and then put together by AND or OR, where a bucket lies, so
    neither step shuffles again, and no half-empty bitmap is ever sent.
    A term without documents, and an answer without any, has no row.
    """
    q = stemmed(queries, stemmer)
    each = F.explode(F.array_distinct(F.array("left", "right"))).alias("term")
    need = F.when(F.col("left") == F.col("right"), 1).otherwise(2).alias("need")
    place = F.bitmap_bucket_number("docid").alias("bucket"), F.bitmap_bit_position("docid").alias("place")
    rows = tf.select("term", "docid").filter("docid is not null").join(small(q.select("query_id", "op", need, each)), "term")
    rows = rows.select("query_id", "op", "need", "term", *place).repartition("bucket")
    lists = rows.groupBy("bucket", "query_id", "op", "need", "term").agg(F.bitmap_construct_agg("place").alias("bits"))
    folded = lists.groupBy("bucket", "query_id", "op", "need").agg(
        F.count(F.lit(1)).alias("lists"), F.bitmap_or_agg("bits").alias("any"), F.bitmap_and_agg("bits").alias("all")
    )
    # A bucket that one of the two terms does not have has nothing for AND.
    folded = folded.filter("op = 'OR' or lists = need")
    bits = F.when(F.col("op") == "OR", F.col("any")).otherwise(F.col("all"))
    found = folded.select("query_id", "bucket", bits.alias("bits")).withColumn("n", F.bitmap_count("bits")).filter("n > 0")
    return found.join(small(q.drop("query")), "query_id").select("query_id", "op", "left", "right", "bucket", "n", "bits")


def counts(answers: DataFrame) -> DataFrame:
    """(query_id, n): the documents of each answer that has any, counted without opening a bitmap."""
    return answers.groupBy("query_id").agg(F.sum("n").alias("n"))


def _ids(bucket: Column, bits: Column) -> Column:
    """The ids of a bitmap in the order of places: bytes that are not empty, then their bits."""
    each = F.transform(F.sequence(F.lit(0), F.lit(BUCKET // 8 - 1)), lambda i: F.struct(i.alias("at"), F.substring(bits, i + 1, F.lit(1)).alias("byte")))
    full = F.filter(each, lambda x: F.hex(x["byte"]) != "00")
    value = lambda x: F.conv(F.hex(x["byte"]), 16, 10).cast("int")
    spots = F.flatten(F.transform(full, lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: F.getbit(value(x), j) == 1), lambda j: x["at"] * 8 + j)))
    # Ids from 1 on are counted up from a bucket's beginning, others down from it.
    return F.transform(spots, lambda s: F.when(bucket > 0, (bucket - 1) * BUCKET + s + 1).otherwise(bucket * BUCKET - s))


def documents(answers: DataFrame) -> DataFrame:
    """(query_id, docid) of every answer."""
    return answers.select("query_id", F.explode(_ids(F.col("bucket"), F.col("bits"))).alias("docid"))
