"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import ascii_lower


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 60) -> DataFrame:
    """Label every row with the row that stays for its text.

    Texts are equal when identical after lower-casing A-Z; of equal texts the
    row with the largest id stays. Three combining steps, each of which groups
    by the whole text and not only by its digest: within a task (the partial
    aggregate, so a task sends a text once per salt), within a salted digest
    group, and over the salt winners (at most ``salts`` rows for a text).
    Labels go back by digest and salt, so no task gets a whole large group.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Null texts count as
    empty and are copies of each other. A null id is never preferred; if all
    ids of a group are null, keep_id is null and no row is kept. Repeated ids:
    each row with the largest id is kept. An empty table gives no rows; other
    columns of ``docs`` are ignored.
    """
    if not 1 <= salts <= 62:
        raise ValueError("salts must be from 1 to 62")
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    rows = rows.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("second"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    salted = rows.groupBy("digest", "second", "text", "salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "second", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.expr("bit_or(shiftleft(1L, salt))").alias("used"))
    # Different texts with both hashes in common would be told apart above; labels could not be, so that is an error.
    labels = (
        whole.select("digest", "second", "keep_id", "n", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> (shiftright(used, s) & 1L) = 1L)")).alias("salt"))
        .groupBy("digest", "second", "salt")
        .agg(F.max("keep_id").alias("keep_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("texts"))
        .withColumn("n", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts with the same digests")).cast("long")).otherwise(F.col("n")))
    )
    return (
        rows.select("doc_id", "digest", "second", "salt")
        .join(labels, ["digest", "second", "salt"])
        .select("doc_id", "keep_id", F.col("n").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )
