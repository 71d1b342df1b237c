"""A pipeline over documents: each stage reads what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.llm import decontam, mixing, ngramjoin, sharding, toxicity
from lexispark.llm.common import few, free, stored, table

SHARD_BYTES = 1 << 20


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and that column's name; ids may be null or repeated.

    Rows of stored tables are numbered by their file's place among all names
    and their own place in it, so each read numbers them alike and no text is
    written again. The names are a stored table that is joined by its size.
    Other tables are stored once with their numbers.
    """
    row, name, file = (free(docs, x) for x in ("row", "name", "file"))
    try:
        at = docs.metadataColumn("_metadata")
        placed = docs.select("*", at["file_path"].alias(name), at["row_index"].alias(row))
    except AnalysisException:
        return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row
    names = placed.select(name).distinct()
    places = stored(names.select(name, F.row_number().over(Window.orderBy(name)).cast("long").alias(file)), "files")
    number = F.shiftleft(file, 40) + F.col(row)  # a file has fewer than 2 ** 40 rows
    return placed.join(few(places), name).select(*docs.columns, number.alias(row)), row


def without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """``rows`` but for those whose number is in the column ``row`` of ``gone``.
    The numbers are hashed at every size, so the texts are neither sorted nor
    shuffled by another plan on a larger table."""
    return rows.join(gone.select(row).hint("shuffle_hash"), row, "left_anti").drop(row)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score marks go; null and empty texts stay. The score is one more column of the scan; nothing is shuffled."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.scores(model, F.col("text")) < 0.5)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class one row stays, that with the smallest id;
    null ids come last, and of equal ids the first row stays. Texts without
    words, null and empty ones too, are classes of their own and stay."""
    rows, row = numbered(docs)
    # Rows without links are classes of their own.
    classes = stored(ngramjoin.ngram_join(rows, id_col=row).filter("n_links > 0").select(F.col("doc_id").alias(row), "class_id").join(rows.select(row, "doc_id"), row), "classes")
    first = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))).alias("first")).select(F.col(f"first.{row}").alias(row))
    gone = stored(classes.join(first, row, "left_anti").select(row), "dropped")
    return without(rows, row, gone).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark passages go, row
    by row; texts without words stay."""
    rows, row = numbered(docs)
    gone = decontam.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=row).filter("contaminated")
    return without(rows, row, stored(gone.select(F.col("doc_id").alias(row)), "dropped")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix to target weights takes it, whether it has an
    id or not; texts without words count nothing and go with their source's share."""
    rows, row = numbered(docs)
    taken = mixing.mix(rows, row_col=row).filter("copies <> 1")
    # A fixed share of the documents has other copies than one, so they are never broadcast; hashing them leaves the texts unsorted.
    n = free(docs, "n")
    times = taken.select(row, F.col("copies").cast("int").alias(n)).hint("shuffle_hash")
    found = rows.join(times, row, "left")
    return found.select(*docs.columns, F.explode(F.expr(f"array_repeat(0, coalesce({n}, 1))")).alias(n)).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard; null texts have no bytes, equal rows share a shard."""
    return sharding.shard(docs, limit=SHARD_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_each_class),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier and the near-duplicate classes have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared
    folder and read again. What stages store stays there until ``release``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
