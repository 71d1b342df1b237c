"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import few, stored

TOKEN = r"[^\x20\x09-\x0D]+"
#: Documents of one size class are dealt into so many parts, so that no part holds a whole large source.
PARTS = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(absent, source, source_size) with the columns target, place.

    Sources are taken by code point, null last, and weigh ``weights``,
    repeating. A target is its share by weight of all sizes, but at most
    ``cap`` times the source's size; what is over goes to the others by
    weight. In the order of size / weight the capped sources come first, so
    one pass of prefix sums finds the level of all others. The table has one
    row per source.
    """
    order = Window.orderBy("absent", "source")
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - F.lit(1), F.lit(n)).cast("int") + F.lit(1)).cast("bigint")
    s = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    s = s.withColumn("ratio", F.col("most").cast("double") / F.col("weight").cast("double"))
    by = Window.orderBy("ratio", "place")
    s = s.select(
        "*", F.row_number().over(by).alias("turn"),
        F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("rest"),
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
    )
    left = F.col("total") - F.col("before")
    s = s.withColumn("first", F.when(left * F.col("weight") <= F.col("most") * F.col("rest"), F.struct("turn", left.alias("left"), "rest")))
    s = s.withColumn("level", F.min("first").over(Window.partitionBy()))
    open_ = F.col("turn") >= F.col("level.turn")
    target = F.when(open_, (F.col("level.left") * F.col("weight")).cast("double") / F.col("level.rest").cast("double")).otherwise(F.col("most").cast("double"))
    return s.select("absent", "source", "source_size", target.alias("target"), "place")


def _hex_int(c: Column, chars: int, at: int = 1) -> Column:
    return F.conv(F.substring(F.md5(c.cast("binary")), at, chars), 16, 10).cast("bigint")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 7, row_col: str | None = None) -> DataFrame:
    """How often a mix to target weights takes each document.

    Systematic sampling: within a source, documents stand in the order of their
    sizes; each is expected target / source_size times, these are prefix-summed,
    one offset per source and seed is added, and a document is emitted once per
    integer boundary that its interval crosses, at most ``cap`` times. All
    documents of a source are expected equally often, so the prefix sum is a
    rank times that number. The rank is found in two levels, from counts of
    (source, size class, part) and a row number inside each, so a source is
    never sorted in one task.

    Returns doc_id, source, size, source_size, target, copies, taken. A null
    text has size 0; a null source is a source. Documents of an empty source
    are taken 0 times. Repeated ids are counted as separate rows; rows equal in
    id and text may swap their copies. An empty table gives no rows. Reruns
    agree, whatever the partitioning. A unique ``row_col`` is returned too and
    tells equal rows apart. Sources are put in order in one task: a few numbers
    for each source.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own_row = [row_col] if row_col else []
    # Parts and the order of rows of one size come from id and text, so rows without an id are dealt out too.
    mark = _hex_int(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))), 15)
    rows = docs.select(*own_row, F.col(id_col).alias("doc_id"), F.col(source_col).alias("given"), F.col(source_col).isNull().alias("absent"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.regexp_count(text, F.lit(TOKEN)).cast("bigint").alias("size"), mark.alias("mark"))
    bits = F.length(F.bin("size"))
    rows = rows.withColumn("class", bits * F.lit(16) + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))").cast("int")).withColumn("part", F.pmod("mark", F.lit(PARTS)).cast("int"))
    # Counted once: the targets, the ranks and the size check all read these few rows instead of the texts.
    cells = stored(rows.groupBy("absent", "source", "class", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("sum")), "cells")
    sources = stored(source_targets(cells.groupBy("absent", "source").agg(F.sum("sum").alias("source_size")), weights, cap), "sources")
    own = Window.partitionBy("absent", "source").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("absent", "source", "class", "part", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("ahead")).join(few(sources), ["absent", "source"])
    salt = F.concat(F.lit(f"{seed}:"), F.when(F.col("absent"), F.lit("-")).otherwise(F.lit("+")), F.col("source"))
    # An offset of 16 bits and a half stays exact beside ranks, so equal expectations give equal copies.
    cells = cells.withColumn("offset", (_hex_int(salt, 4).cast("double") + F.lit(0.5)) / F.lit(65536.0)).withColumn("each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0)))
    rows = rows.join(cells, ["absent", "source", "class", "part"])
    rank = F.col("ahead") + F.row_number().over(Window.partitionBy("absent", "source", "class", "part").orderBy("size", "mark", *own_row))
    rows = rows.withColumn("rank", rank.cast("double"))
    upto = lambda r: F.floor(r * F.col("each") + F.col("offset"))
    rows = rows.withColumn("copies", (upto(F.col("rank")) - upto(F.col("rank") - F.lit(1.0))).cast("bigint"))
    return rows.select(*own_row, "doc_id", F.col("given").alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
