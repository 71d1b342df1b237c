"""Inverted index and its statistics as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.porter import stem
from lexispark.functions.text import Analyzer

FIELDS = ("title", "author", "bibliography", "body")
#: Tables of at most so many rows get a broadcast hint; they are counted first.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded(df: DataFrame, by: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for ``df``, which has at most as many rows as ``by``, if ``by`` is counted to have few."""
    return F.broadcast(df) if by.limit(rows + 1).count() <= rows else df


def long_fields(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(docid, field, text), one row for each field of a document; absent text is empty."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("text")) for f in fields)))
    return docs.select("docid", each.alias("x")).select("docid", "x.field", "x.text")


def stemmed(df: DataFrame, analyzer: Analyzer) -> DataFrame:
    """Replace term by its stem, each distinct term stemmed once."""
    if analyzer.stemmer == "none":
        return df
    stems = stem(df.select("term").distinct(), stemmer=analyzer.stemmer)
    return df.join(stems, "term").withColumn("term", F.col("stem")).drop("stem")


def token_stream(docs: DataFrame, analyzer: Analyzer, text: str = "body") -> DataFrame:
    """(docid, pos, term), positions from 0 after stop words went."""
    return stemmed(docs.select("docid", F.posexplode(analyzer.terms(F.col(text))).alias("pos", "term")), analyzer)


@dataclass(frozen=True)
class Index:
    """tf (field, docid, term, tf), df (field, term, df), dl (field, docid, len), stats (field, n, avg, terms, postings, tokens).

    ``rows`` (field, docid, lowered), of an index that was built without a stemmer, has the texts in lower case, for counts where a document lies.
    """

    tf: DataFrame
    df: DataFrame
    dl: DataFrame
    stats: DataFrame
    analyzer: Analyzer
    rows: DataFrame | None = None
    fields: tuple[str, ...] = FIELDS

    def field(self, name: str) -> Index:
        one = lambda d: d.filter(F.col("field") == name).drop("field")
        return Index(one(self.tf), one(self.df), one(self.dl), one(self.stats), self.analyzer, None if self.rows is None else self.rows.filter(F.col("field") == name), (name,))

    def row_by_row(self, *fields: str) -> DataFrame | None:
        """``rows`` of the given fields (all, if none is given), if no two of a field have one id, so that each can be counted where it lies; else None."""
        if self.rows is None:
            return None
        rows = self.rows.filter(F.col("field").isin(*fields)) if fields else self.rows
        alike = rows.select("field", "docid").groupBy("field", "docid").agg(F.count(F.lit(1)).alias("n"))
        return rows if alike.filter("n > 1").isEmpty() else None

    def save(self, path: str) -> None:
        """Parquet, postings ranged and sorted by term so that a lookup reads few row groups."""
        self.tf.repartitionByRange("term").sortWithinPartitions("field", "term", "docid").write.mode("overwrite").parquet(f"{path}/tf")
        self.df.repartitionByRange("term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/df")
        self.dl.write.mode("overwrite").parquet(f"{path}/dl")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark, path: str, analyzer: Analyzer) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("tf", "df", "dl", "stats")), analyzer)


def build(docs: DataFrame, analyzer: Analyzer, fields: tuple[str, ...] = FIELDS, keep: bool = False) -> Index:
    """Count terms once; lengths, document frequencies and statistics are sums over the counts.

    ``keep``: the counts stay in the session's cache, in memory or on disk, so
    that queries do not read the texts again; save() is for longer than that.
    """
    text = long_fields(docs, fields)
    tokens = text.select("field", "docid", F.explode(analyzer.terms(F.col("text"))).alias("term"))
    tf = tokens.groupBy("field", "docid", "term").agg(F.count(F.lit(1)).alias("tf"))
    if analyzer.stemmer != "none":
        tf = stemmed(tf, analyzer).groupBy("field", "docid", "term").agg(F.sum("tf").alias("tf"))
    tf = tf.persist(StorageLevel.MEMORY_AND_DISK) if keep else tf
    df = tf.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    counted = tf.groupBy("field", "docid").agg(F.sum("tf").alias("len"))
    # Documents without a term stay, with length 0.
    dl = text.select("field", "docid").join(counted, ["field", "docid"], "left").select("field", "docid", F.coalesce("len", F.lit(0)).cast("bigint").alias("len"))
    sizes = dl.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("len"), F.lit(1e-12)).alias("avg"), F.sum("len").alias("tokens"))
    terms = df.groupBy("field").agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"))
    stats = sizes.join(terms, "field", "left").fillna(0, ["terms", "postings"])
    rows = text.select("field", "docid", analyzer.lowered(F.col("text")).alias("lowered")) if analyzer.stemmer == "none" else None
    return Index(tf, df, dl, stats, analyzer, rows, tuple(fields))


def lookup(spark, path: str, field: str, terms: Sequence[str]) -> DataFrame:
    """(term, docid, tf) of a saved index for a few terms: filters on sorted files, so that few row groups are read."""
    return spark.read.parquet(f"{path}/tf").filter((F.col("field") == field) & F.col("term").isin(*terms)).select("term", "docid", "tf")


def postings(tf: DataFrame) -> DataFrame:
    """(term, docids): ascending distinct ids. One term's ids are one row, as in the text form of an index."""
    return tf.groupBy("term").agg(F.sort_array(F.collect_set("docid")).alias("docids"))


def header(tf: DataFrame) -> DataFrame:
    """(vocabulary, max_docid, postings); zeros for an empty index."""
    by_term = tf.groupBy("term").agg(F.count_distinct("docid").alias("n"), F.max("docid").alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return by_term.agg(F.count(F.lit(1)).alias("vocabulary"), zero(F.max("m")).alias("max_docid"), zero(F.sum("n")).alias("postings"))
