"""Tables over results: best settings, spreads, comparisons, names and digests."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import controls_of, percent_change


def by_metric(table: DataFrame, metric: str, name: str = "name") -> DataFrame:
    """A table of settings with ``place``, the best value first; equal values, to 12 places, in the order of names."""
    return table.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round(metric, 12)), name)))


def spread(table: DataFrame, by: str, metric: str, name: str = "name") -> DataFrame:
    """(by, settings, spread, best): largest less smallest value of a measure in each group, and its best setting."""
    first = F.min(F.struct(-F.round(metric, 12), F.col(name)))
    return table.groupBy(by).agg(F.count(F.lit(1)).alias("settings"), (F.max(metric) - F.min(metric)).alias("spread"), first[name].alias("best"))


def beside(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """Two tables of settings side by side, joined by name; columns of the second that the first has get ``_2``."""
    return a.join(b.select(name, *(F.col(c).alias(f"{c}_2" if c in a.columns else c) for c in b.columns if c != name)), name, "left")


def named(table: DataFrame, prefix: str = "", suffix: str = "", name: str = "name") -> DataFrame:
    """Settings whose names begin and end so."""
    return table.filter(F.col(name).startswith(prefix) & F.col(name).endswith(suffix))


def within(table: DataFrame, k1: tuple[float, float], b: tuple[float, float], name: str = "name") -> DataFrame:
    """Settings whose names give controls in both ranges, with those."""
    x, y = controls_of(F.col(name))
    return table.withColumns({"k1": x, "b": y}).filter(F.col("k1").between(*k1) & F.col("b").between(*b))


def change(table: DataFrame, old: str, new: str) -> DataFrame:
    """The table with the change from one column to another in percent."""
    return table.withColumn("change", percent_change(F.col(old), F.col(new)))


def lines(table: DataFrame, order: str, decimals: dict[str, int], changes: dict[str, str] | None = None) -> DataFrame:
    """(place, line): a table as the lines of a Markdown table, in the order of a column of whole numbers from 1.

    ``decimals`` names the columns to write and the decimals of each, -1 for
    those that are written as they are. ``changes`` gives, for some columns, the
    one whose change to it in percent stands in brackets. Missing values are ``-``.
    """
    def cell(c: str) -> Column:
        places, value = decimals[c], F.col(f"`{c}`")
        # Halves go upward before printing, since their last digit is not exact.
        text = value.cast("string") if places < 0 else F.format_string(f"%.{places}f", F.round(value + 1e-10, places))
        if old := (changes or {}).get(c):
            base = F.col(f"`{old}`")
            told = F.when(base != 0, F.concat(F.lit(" ("), percent_change(base, value), F.lit(")"))).otherwise("")
            text = F.concat(text, F.coalesce(told, F.lit("")))
        return F.when(value.isNotNull(), text).otherwise("-")

    spark = table.sparkSession
    head = [(-1, "| " + " | ".join(decimals) + " |"), (0, "|" + "".join(" --- |" if p < 0 else " ---: |" for p in decimals.values()))]
    rows = table.select(F.col(order).cast("bigint").alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in decimals)), F.lit(" |")).alias("line"))
    return spark.createDataFrame(head, "place bigint, line string").unionByName(rows)


def largest(weights: DataFrame, n: int = 3, weight: str = "weight", name: str = "feature") -> DataFrame:
    """The n weights of the largest size, equal ones in the order of names."""
    return weights.orderBy(F.desc(F.abs(F.round(weight, 12))), name).limit(n)


def digest(text: Column) -> Column:
    """SHA-256 of an input, in lower-case hexadecimal; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest): a digest of a table's rows that depends on neither
    their order nor how they are dealt out. Each row's SHA-256 is cut into eight
    numbers, which are added up in each place; the sums are hashed."""
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.conv(F.substring("row", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    sums = df.select(row.alias("row")).agg(F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(part(i)), F.lit(0)).cast("string").alias(f"s{i}") for i in range(8)))
    return sums.select("rows", F.sha2(F.concat_ws(",", F.col("rows").cast("string"), *(f"s{i}" for i in range(8))), 256).alias("digest"))


def timed(run: Callable[[], DataFrame], topics: int) -> tuple[int, float, float]:
    """(rows, seconds, milliseconds a topic) of a result that is counted, not kept."""
    began = time.perf_counter()
    rows = run().count()
    taken = time.perf_counter() - began
    return rows, taken, 1000 * taken / max(1, topics)
