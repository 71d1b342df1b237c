"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common
from lexispark.llm.common import few, file_bytes, same_files, stored, words

#: An encoded fingerprint holds the hash above and the position in its chunk below.
POSITION_BITS = 17
MASK = (1 << POSITION_BITS) - 1
#: Salts of a fingerprint in the join that is not a broadcast.
SALTS = 8
#: Words of a chunk; long texts are cut into overlapping chunks.
CHUNK = 1 << 16


def grams(w: Column, k: int) -> Column:
    """Encoded hashes of all k-grams of the words ``w``."""
    last = F.size(w) - F.lit(k)

    def one(i: Column) -> Column:
        return F.xxhash64(*(w[i + F.lit(j)] for j in range(k))).bitwiseAND(F.lit(~MASK)).bitwiseOR(i.cast("long"))

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<bigint>"))


def minima(g: Column, width: int) -> Column:
    """The distinct minima of all windows of ``width`` encoded hashes."""
    last = F.size(g) - F.lit(width)

    def one(i: Column) -> Column:
        return F.least(*(g[i + F.lit(j)] for j in range(width))) if width > 1 else g[i]

    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), one))).otherwise(F.array().cast("array<bigint>"))


def shape(length: int, k: int) -> tuple[int, int]:
    """k-gram size and hashes in a window, so that a span of ``length`` words has a fingerprint."""
    k = min(k, length)
    return k, length - k + 1


def benchmark_windows(bench: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(length, win, words, items): the distinct windows and the sorted ids of the items that have each."""
    items = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words(F.col(text_col)).alias("w"))
    items = items.withColumn("length", F.least(F.size("w"), F.lit(window))).filter("length > 0")
    pairs = items.select("item_id", "length", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("length")), lambda i: F.slice("w", i + F.lit(1), F.col("length")))).alias("words"))
    return pairs.groupBy("length", F.array_join("words", " ").alias("win")).agg(F.first("words").alias("words"), F.sort_array(F.collect_set("item_id")).alias("items"))


def looked_up(chunks: DataFrame, prints: DataFrame, lengths: list[int], widest: int) -> DataFrame:
    """(row, doc_id, n_words, base, fp, pos, low, words): the documents'
    fingerprints that the benchmark has, and one row with nulls for each chunk.

    The benchmark's distinct fingerprints are joined in the scan if they are
    few. If they are not, those that no document has are taken out first, and
    if the rest is not small either, both sides are hashed, with salts. The
    words around a fingerprint, as far as any window that holds it reaches, are
    cut out after the join in the scan, before the other. Length classes share
    k-gram hashes; what one finds for another is compared like any hit.
    """
    known = stored(prints.select("fp").distinct(), "fingerprints")
    own = ["row", "doc_id", "n_words", "base"]
    fp = F.col("m").bitwiseAND(F.lit(~MASK)).alias("fp")
    pos = F.col("m").bitwiseAND(F.lit(MASK)).cast("int").alias("pos")
    # The null stands for the chunk itself.
    spread = chunks.select(*own, "w", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), *(F.col(f"m{n}") for n in lengths))).alias("m"))
    low = F.greatest(F.col("pos") - F.lit(widest - 1), F.lit(0))
    around = (low.alias("low"), F.slice("w", low + F.lit(1), F.col("pos") - low + F.lit(lengths[-1])).alias("words"))
    kept = F.col("known") | F.col("fp").isNull()
    if file_bytes(known) > common.BROADCAST_BYTES:
        known = stored(known.join(spread.select(fp).distinct(), "fp", "left_semi"), "fingerprints")
    if file_bytes(known) <= common.BROADCAST_BYTES:
        # A lone flag beside the key: joined in the scan, and the words around are cut out of hits only.
        found = spread.select(*own, "w", fp, pos).join(F.broadcast(known.withColumn("known", F.lit(True))), "fp", "left").filter(kept)
        return found.select(*own, "fp", "pos", *around)
    spread = spread.select(*own, "w", fp, pos).select(*own, "fp", "pos", *around)
    return print_join(spread, same_files(known.withColumn("known", F.lit(True)), known)).filter(kept).drop("known")


def print_join(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """A left join of ``rows`` to ``prints`` on fp. If ``prints``, a stored table
    or a view of one, is small, it is broadcast. If not, a common fingerprint
    is salted, and a row without any gets a key of its own that nothing else
    has, so that neither meets in one task."""
    if file_bytes(prints) <= common.BROADCAST_BYTES:
        return rows.join(F.broadcast(prints), "fp", "left")
    none = F.col("fp").isNull()
    salt = F.when(none, F.lit(-1)).otherwise(F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS))).cast("int")
    keyed = rows.withColumn("salt", salt).withColumn("at fp", F.when(none, F.xxhash64("row", "base")).otherwise(F.col("fp")))
    salted = prints.withColumnRenamed("fp", "at fp").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.join(salted, ["at fp", "salt"], "left").drop("at fp", "salt")


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, k: int = 5, share: float = 0.05) -> DataFrame:
    """How much of each document lies in passages of the benchmark.

    Winnowing: of every ``window - k + 1`` successive k-gram hashes the smallest
    is kept, so each span of ``window`` words in common has a fingerprint in
    common. Documents' and benchmark's fingerprints are joined; only hits, with
    the few words around them, are joined to the benchmark's windows and
    compared word for word. A hit extends to every window that holds its
    fingerprint. No text is shuffled; fingerprints stay in tables, whatever the
    size of the benchmark.

    Items of fewer than ``window`` words are one window, with fingerprints of
    their own length class. Returns for each row of ``docs``: doc_id, n_words,
    n_hit, n_items, items (sorted array of strings), spans (sorted array of
    start and end), items_sha256 and contaminated (n_hit > 0 and
    n_hit >= share * n_words, with ``share`` as the decimal fraction it is
    written as). Null and empty texts have no words and are clean; so is
    everything if the benchmark is empty. Rows are told apart by their place in
    the scan, so repeated or null ids give a row each. A null item id counts as
    the empty string. Other columns are ignored.
    """
    wins = stored(benchmark_windows(bench, item_col, item_text_col, window), "windows")
    lengths = sorted(r[0] for r in wins.select("length").distinct().collect())  # at most `window` values
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    if not lengths:
        clean = rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"))
        return verdicts(clean, share)
    prints = []
    for n in lengths:
        size, width = shape(n, k)
        prints.append(wins.filter(F.col("length") == n).select("length", "win", grams(F.col("words"), size).alias("g")).select("length", "win", minima(F.col("g"), width)[0].alias("m")))
    prints = reduce(DataFrame.unionByName, prints).select("length", "win", F.col("m").bitwiseAND(F.lit(~MASK)).alias("fp"), F.col("m").bitwiseAND(F.lit(MASK)).cast("int").alias("at"))
    prints = stored(prints, "prints")

    rows = rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"int(greatest(size(w) - 1, 0) / {CHUNK})")), lambda c: F.struct((c * CHUNK).alias("base"), F.slice("w", c * CHUNK + F.lit(1), F.lit(CHUNK + window - 1)).alias("w")))).alias("c"))
    rows = rows.select("row", "doc_id", "n_words", F.col("c.base").alias("base"), F.col("c.w").alias("w"))
    sizes = sorted({shape(n, k)[0] for n in lengths})
    rows = rows.select("*", *(grams(F.col("w"), s).alias(f"g{s}") for s in sizes))
    rows = rows.select("row", "doc_id", "n_words", "base", "w", *(minima(F.col(f"g{shape(n, k)[0]}"), shape(n, k)[1]).alias(f"m{n}") for n in lengths))

    hits = looked_up(rows, prints, lengths, max(shape(n, k)[1] for n in lengths))
    hits = print_join(hits, prints)
    start = F.col("pos") - F.col("at")
    same = (start >= 0) & (F.array_join(F.slice("words", F.greatest(start - F.col("low"), F.lit(0)) + F.lit(1), F.col("length")), " ") == F.col("win"))
    hits = hits.select("row", "doc_id", "n_words", F.when(same, F.col("win")).alias("win"), F.when(same, F.struct((F.col("base") + start).cast("long").alias("start"), (F.col("base") + start + F.col("length")).cast("long").alias("end"))).alias("span"))
    # One row for each document and window before the items of a window come in.
    hits = hits.groupBy("row", "win").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_set("span").alias("spans"))
    # A row without a window has a key that is none, as words hold no NUL.
    hits = hits.withColumn("at", F.coalesce("win", F.concat(F.lit("\0"), F.col("row").cast("string"))))
    hits = hits.join(few(stored(wins.select(F.col("win").alias("at"), "items"), "window-items")), "at", "left")
    found = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("items", F.array().cast("array<string>")))))).alias("items"))
    return verdicts(found, share)


def verdicts(found: DataFrame, share: float) -> DataFrame:
    """Covered words and the verdict from the sorted spans of each row."""
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0).cast("bigint"))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")),
        lambda a: a["n"],
    )
    part = Fraction(str(share))
    return found.withColumn("n_hit", covered).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(part.denominator) * F.col("n_hit") >= F.lit(part.numerator) * F.col("n_words"))).alias("contaminated"), "items", "spans",
    )
