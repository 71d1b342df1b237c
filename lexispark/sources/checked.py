"""Readers that check their rows in the pass that reads them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexispark.operators.index import small
from lexispark.sources.collection import FORMS, TAGS, _fields, _records
from lexispark.sources.store import stored

#: The codes that judgement files have.
CODES = (-1, 1, 2, 3, 4, 5)


class Faults(ValueError):
    """All faults of a source at once; ``counts`` has the rows of each kind."""

    def __init__(self, name: str, counts: Mapping[str, int]):
        self.counts = dict(counts)
        super().__init__(f"{name}: " + ", ".join(f"{n} {fault}" for fault, n in self.counts.items()))


def checked(df: DataFrame, name: str, rules: Mapping[str, Column], key: Sequence[str] = (), strict: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """``df`` written once to the shared folder, and the number of its rows and of those that each rule calls faulty.

    The counts are taken of the rows on their way to the file, so the source is
    read, and its records are parsed, once. The last operator before the write
    counts: its tasks are a result's, of which a repeated one counts once.
    With ``key``, ``repeated`` is the rows beyond the first of each key
    without a null, counted from the written keys alone. ``strict``: faults are an
    error that names all of them, and what was written is not used.
    """
    seen = Observation()
    count = lambda c: F.count(F.when(c, 1))
    written = stored(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(count(c).alias(fault) for fault, c in rules.items())), name)
    counts = {k: int(v) for k, v in seen.get.items()}
    if key:
        known = written.select(*key).dropna()
        counts["repeated"] = known.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    faults = {k: n for k, n in counts.items() if k != "rows" and n}
    if strict and (faults or not counts["rows"]):
        raise Faults(name, faults or {"rows": 0})
    return written, counts


def collection(spark: SparkSession, path: str, form: str = "fielded", strict: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """((docid, title, author, bibliography, body), counts) of a tagged file.

    Faults: ``unnumbered`` (no number after ``.I``), ``empty`` (no text in any
    field) and ``repeated``. Without ``strict`` all records are kept, with a null id where there is none.
    """
    rows = _records(spark, path).select(F.col("head").try_cast("bigint").alias("docid"), _fields(F.col("lines"), FORMS[form]).alias("f"))
    fields = list(TAGS.values())
    rows = rows.select("docid", *(F.col(f"f.{k}").alias(k) for k in fields))
    rules = {"unnumbered": F.col("docid").isNull(), "empty": F.concat(*fields) == ""}
    return checked(rows, "collection", rules, ["docid"], strict)


def judgements(spark: SparkSession, path: str, docs: DataFrame, topics: DataFrame, strict: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """((qid, docid, code), counts) of a file of judgements, against the documents (docid) and topics (qid) that there are.

    Faults: ``malformed`` (not three numbers), ``unknown_code``,
    ``unknown_topic``, ``unknown_document`` and ``repeated`` pairs; a line can
    have several, but of a malformed one nothing else is counted. Empty lines
    go. Without ``strict`` the rows that are left have no such fault; of repeated pairs with
    different codes all stay. Documents are met by a join of ids, broadcast only after a count.
    """
    p = F.split(F.trim("value"), r"\s+")
    number = lambda i, kind: F.get(p, F.lit(i)).try_cast(kind)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    lines = lines.select(number(0, "bigint").alias("qid"), number(1, "bigint").alias("docid"), number(2, "int").alias("code"), (F.size(p) == 3).alias("three"))
    good = F.col("three") & F.col("qid").isNotNull() & F.col("docid").isNotNull() & F.col("code").isNotNull()
    # Malformed lines have join keys of their own, so they do not all go to one task.
    own = F.when(~good, F.monotonically_increasing_id())
    lines = lines.select(*(F.when(good, F.col(c)).alias(c) for c in ("qid", "docid", "code")), own.alias("own"))
    here = lambda df, c, name: small(df.filter(F.col(c).isNotNull()).select(F.col(c).alias("key"), F.lit(True).alias("known")).distinct().withColumn(name, F.lit(True)))
    rows = lines
    for table, c, name in ((topics, "qid", "topic"), (docs, "docid", "document")):
        keyed = rows.withColumn("key", F.coalesce(c, "own")).withColumn("known", F.col("own").isNull())
        rows = keyed.join(here(table, c, name), ["key", "known"], "left").drop("key", "known")
    well = F.col("qid").isNotNull()
    rules = {
        "malformed": ~well,
        "unknown_code": well & ~F.col("code").isin(*CODES),
        "unknown_topic": well & F.col("topic").isNull(),
        "unknown_document": well & F.col("document").isNull(),
    }
    written, counts = checked(rows.select("qid", "docid", "code", "topic", "document"), "judgements", rules, ["qid", "docid"], strict)
    kept = written.filter(F.col("topic") & F.col("document") & F.col("code").isin(*CODES))
    return kept.select("qid", "docid", "code"), counts
