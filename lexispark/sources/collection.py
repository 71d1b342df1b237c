"""Readers of tagged collections, topics, judgements, stop words and index files."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The tag of a line and the field it opens, and the gains of judgement codes.
TAGS = {".T": "title", ".A": "author", ".B": "bibliography", ".W": "body"}
GAIN = {1: 4, 2: 3, 3: 2, 4: 1}


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(head, lines): one row for each record that begins with ``.I``."""
    text = spark.read.option("lineSep", "\n.I ").text(path).select(F.regexp_replace("value", r"^\s*\.I ", "").alias("r"))
    lines = F.split(F.regexp_replace("r", "\r\n?", "\n"), "\n")
    return text.filter(F.trim("r") != "").select(F.trim(F.get(lines, F.lit(0))).alias("head"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("lines"))


@dataclass(frozen=True)
class Form:
    """How a reader takes tags.

    ``opens``: (field that is open, tag) and the field that the tag opens; a
    pair that is not there is a stray, and its line is text. ``tagged``: a tag
    line. ``own``: text on a line whose tag opens a field counts. ``stray``:
    of a stray's line only what follows the tag is text.
    """

    opens: dict[tuple[str, str], str]
    tagged: str
    own: bool
    stray: bool

    @staticmethod
    def after(strays: tuple[str, ...], tagged: str, own: bool, stray: bool) -> Form:
        """Every tag opens its field, but for those that are strays once the body is open."""
        states = ("", *TAGS.values())
        return Form({(s, t): k for s in states for t, k in TAGS.items() if s != "body" or k == "body" or t not in strays}, tagged, own, stray)


#: Titles and bodies read together, tags alone on their lines; fields, with text beside tags dropped where they open one;
#: fields, with that text kept. In the last, a title tag opens the title again after a body.
FORMS = {
    "merged": Form.after((".A", ".B"), r"^(\.[TABW])\s*$", False, False),
    "strict": Form.after((".T", ".A", ".B"), r"^(\.[TABW])(.*)$", False, True),
    "fielded": Form.after((".A", ".B"), r"^\s*(\.[TABW])(?:\s+(.*))?$", True, True),
}


def _fields(lines: Column, form: Form) -> Column:
    """Field texts by a walk over a record's lines: the open field and the line's tag are looked up in the form's table."""
    kinds = list(TAGS.values())
    start = F.struct(F.lit("").alias("now"), F.lit(False).alias("begun"), *(F.lit("").alias(k) for k in kinds))
    table = F.create_map(*(F.lit(x) for (s, t), k in form.opens.items() for x in (f"{s} {t}", k)))
    groups = 2 if form.stray else 1

    def walk(a: Column, line: Column) -> Column:
        tag = F.regexp_extract(line, form.tagged, 1)
        # Once a body has begun, tags are looked up as if it were open.
        state = F.when(a["begun"], "body").otherwise(a["now"])
        opened = F.when(tag != "", F.try_element_at(table, F.concat(state, F.lit(" "), tag)))
        rest = F.regexp_extract(line, form.tagged, groups) if form.stray else F.lit("")
        opening = F.trim(rest) if form.own else F.lit("")
        text = F.when(opened.isNotNull(), opening).when(tag != "", F.trim(rest)).otherwise(F.trim(line))
        now = F.coalesce(opened, a["now"])
        add = lambda k: F.when((now == k) & (text != ""), F.trim(F.concat(a[k], F.lit(" "), text))).otherwise(a[k])
        return F.struct(now.alias("now"), (a["begun"] | F.coalesce(opened == "body", F.lit(False))).alias("begun"), *(add(k).alias(k) for k in kinds))

    return F.aggregate(lines, start, walk)


def read_collection(spark: SparkSession, path: str, duplicates: str = "error", form: str = "fielded") -> DataFrame:
    """(docid, title, author, bibliography, body) of a tagged file, as one of ``FORMS`` reads it. ``duplicates``: error, keep (both) or last."""
    rows = _records(spark, path).select(F.col("head").cast("bigint").alias("docid"), F.monotonically_increasing_id().alias("at"), _fields(F.col("lines"), FORMS[form]).alias("f"))
    docs = rows.select("docid", "at", *(F.col(f"f.{k}").alias(k) for k in TAGS.values()))
    if duplicates == "last":
        docs = docs.withColumn("n", F.row_number().over(Window.partitionBy("docid").orderBy(F.desc("at")))).filter("n = 1").drop("n")
    elif duplicates == "error":
        if docs.isEmpty():
            raise ValueError("the collection is empty")
        if not docs.groupBy("docid").count().filter("count > 1").isEmpty():
            raise ValueError("document ids repeat")
    return docs.drop("at")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, value): all lines of a file, or of a folder of files in the order of their names, and their places from 1.

    Lines are numbered within their split and splits by a sum over their
    counts, so the places of a file of any size come without sorting it in one task.
    """
    split = F.struct("_metadata.file_name", "_metadata.file_block_start").alias("split")
    lines = spark.read.text(path).select("value", split, F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("split").orderBy("at"))
    return lines.join(counts.select("split", before.alias("before")), "split").select((F.col("before") + inside).alias("place"), "value")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(qid, original_id, query): qid is the place in the file from 1, original_id the label there. Topic files are small."""
    rows = _records(spark, path).coalesce(1).select(F.monotonically_increasing_id().alias("at"), F.col("head").alias("original_id"), _fields(F.col("lines"), FORMS["fielded"])["body"].alias("query"))
    out = rows.withColumn("qid", F.row_number().over(Window.orderBy("at")).cast("bigint")).select("qid", "original_id", "query")
    if not out.groupBy("original_id").count().filter("count > 1").isEmpty():
        raise ValueError("topic labels repeat")
    return out


def _qrels(spark: SparkSession, path: str) -> DataFrame:
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(p) == 3).select(p[0].cast("bigint").alias("qid"), p[1].cast("bigint").alias("docid"), p[2].cast("int").alias("code"))


def read_graded(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid, label): codes 1 to 4 are gains 4 to 1, other codes go."""
    return _qrels(spark, path).filter(F.col("code").between(1, 4)).select("qid", "docid", (5 - F.col("code")).alias("label"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid, label): 1 for codes 1 to 4, 0 for -1 and 5; another code is an error."""
    q = _qrels(spark, path)
    if not q.filter(~F.col("code").isin(-1, 1, 2, 3, 4, 5)).isEmpty():
        raise ValueError("unknown judgement code")
    return q.select("qid", "docid", F.col("code").between(1, 4).cast("int").alias("label"))


def read_stop(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The sorted words of a small list: lower-cased pieces, without the possessive rule."""
    words = spark.read.text(path).select(F.explode(F.split(F.lower("value"), "[^a-z0-9]+")).alias("w")).filter("w <> ''").distinct()
    return tuple(sorted(r[0] for r in words.collect()))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query) of a file with a Boolean query on each line; empty lines go."""
    rows = spark.read.text(path).coalesce(1).select(F.monotonically_increasing_id().alias("at"), F.trim("value").alias("query")).filter("query <> ''")
    return rows.select(F.row_number().over(Window.orderBy("at")).cast("bigint").alias("query_id"), "query")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(term, docid) of an index file: a header, then a term and comma-joined ids on each line."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^[0-9]+,\s"))
    # A line is taken apart below its explode, else each of its ids carries the line and takes it apart again.
    p = F.split("value", " ")
    parts = lines.select(F.substring_index("value", " ", 1).alias("term"), F.split(p[1], ",").cast("array<bigint>").alias("docids"))
    return parts.select("term", F.explode("docids").alias("docid"))


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """(docid, tokens) as write_processed wrote it."""
    return _records(spark, path).select(F.col("head").cast("bigint").alias("docid"), F.filter(F.split(F.array_join(F.slice("lines", 2, 1 << 30), " "), r"\s+"), lambda t: t != "").alias("tokens"))


def read_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A JSON object laid over defaults."""
    return {**defaults, **read_json(spark, path)}


def read_json(spark: SparkSession, path: str):
    """A small JSON value, as write_json wrote it."""
    return json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of results, as write_csv wrote it; the schema is given, never inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(original_id, docid, rank, score, tag) of a run file; a line of another form is an error."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    ok = F.when(F.size(p) == 6, p).otherwise(F.raise_error(F.concat(F.lit("not a run line: "), F.col("value"))).cast("array<string>"))
    return lines.select(ok.alias("p")).select(F.col("p")[0].alias("original_id"), F.col("p")[2].cast("bigint").alias("docid"), F.col("p")[3].cast("int").alias("rank"), F.col("p")[4].cast("double").alias("score"), F.col("p")[5].alias("tag"))
