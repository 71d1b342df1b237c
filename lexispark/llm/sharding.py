"""Sharding by extendible hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import discard, few, stored

#: Bits of the hash; two keys that share all of them cannot be parted.
HASH_BITS = 60
#: Bits that the directory deepens at once.
STEP = 8


def key_hash(id_col: str, text_col: str) -> Column:
    """The first 60 bits of md5 over the id and the text's md5."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, HASH_BITS - depth)


def bits(p: Column, depth: Column) -> Column:
    """A prefix of ``depth`` bits as a string; depth 0 is the empty string."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(p), depth, "0"))


def directory(keys: DataFrame, limit: int) -> DataFrame:
    """The leaves (depth, p, shard_bytes, shard_docs), a stored table, for keys (h, bytes).

    Depths are tried in steps of eight: one partial aggregate counts the bytes
    of the prefixes of the oversized buckets of the step before, sums of those
    counts give every depth between, and a bucket becomes a shard at the first
    depth where it fits. Only oversized buckets go on. A bucket that is still
    oversized when all bits are used holds equal keys or one large text, and
    stays one shard.
    """
    leaves, read, active, base = [], [], keys, 0
    while True:
        depth = min(base + STEP, HASH_BITS)
        cells = active.groupBy(prefix(F.col("h"), depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        levels = cells.select(F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("depth"), "*")
        levels = levels.groupBy("depth", F.expr(f"shiftright(cell, cast({depth} - depth as int))").alias("p")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("low").alias("low"), F.max("high").alias("high"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high"))
        levels = stored(levels.withColumn("fits", fits), "directory")
        read.append(levels)
        above = levels.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up"), F.col("fits").alias("ended"))
        new = levels.join(above, (levels["depth"] == above["depth"]) & (F.shiftright(levels["p"], 1) == above["up"]), "left").select(levels["depth"], "p", "shard_bytes", "shard_docs", "fits", F.coalesce("ended", F.lit(False)).alias("ended"))
        leaves.append(new.filter(F.col("fits") & ~F.col("ended")).select("depth", "p", "shard_bytes", "shard_docs"))
        over = levels.filter((F.col("depth") == depth) & ~F.col("fits")).select(F.col("p").alias("cell"))
        if depth == HASH_BITS or over.isEmpty():
            break
        over = stored(over, "oversized")
        read.append(over)
        active, base = active.join(few(over), prefix(F.col("h"), depth) == F.col("cell"), "left_semi"), depth
    out = stored(reduce(DataFrame.unionByName, leaves), "shards")
    discard(*read)
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 32 << 20) -> DataFrame:
    """``docs`` with the columns shard, depth, shard_bytes, shard_docs, bytes.

    Extendible hashing: a directory is indexed by prefix bits of a hash of id
    and text; only buckets above ``limit`` bytes of text split on another bit.
    ``shard`` is the bit string of the bucket. Rows that agree in id and text
    share a shard, whatever its size, and so does a text above the limit, which
    gets a shard of its own. Null texts have no bytes; null ids are hashed as
    the empty string. An empty table gives no rows. Columns of ``docs`` with
    those names are replaced.
    """
    own = ["shard", "depth", "shard_bytes", "shard_docs", "bytes"]
    rows = docs.drop(*own)
    taken = set(rows.columns)
    h, leaf = (next(f"{x}{i}" for i in range(len(taken) + 1) if f"{x}{i}" not in taken) for x in ("h", "leaf"))
    rows = rows.withColumn(h, key_hash(id_col, text_col)).withColumn("bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint"))
    keys = stored(rows.select(F.col(h).alias("h"), "bytes"), "keys")
    leaves = directory(keys, limit)
    discard(keys)
    # The directory proper: an entry for each prefix of so many bits that there are at most four times as many entries
    # as leaves. A leaf above that depth has several entries; those below it stand in their entry, by their first hash.
    deepest, n = leaves.agg(F.max("depth"), F.count(F.lit(1))).first()
    depth = min(deepest or 0, (4 * n).bit_length() - 1 if n else 0)
    one = F.struct(F.expr(f"shiftleft(p, cast({HASH_BITS} - depth as int))").alias("low"), "depth", "p", "shard_bytes", "shard_docs")
    up, span = F.expr(f"shiftright(p, cast(greatest(depth - {depth}, 0) as int))"), F.expr(f"shiftleft(1L, cast(greatest({depth} - depth, 0) as int))")
    entries = leaves.select(one.alias("leaf"), F.explode(F.sequence(up * span, (up + 1) * span - 1)).alias("entry"))
    entries = stored(entries.groupBy("entry").agg(F.array_sort(F.collect_list("leaf")).alias(leaf)), "entries")
    out = rows.join(few(entries), prefix(F.col(h), depth) == F.col("entry"))
    x = F.element_at(F.col(leaf), F.size(F.filter(leaf, lambda v: v["low"] <= F.col(h))))
    found = out.select(*docs.drop(*own).columns, "bytes", x.alias(leaf))
    return found.select(*docs.drop(*own).columns, bits(F.col(f"{leaf}.p"), F.col(f"{leaf}.depth")).alias("shard"), F.col(f"{leaf}.depth").cast("int").alias("depth"), F.col(f"{leaf}.shard_bytes").alias("shard_bytes"), F.col(f"{leaf}.shard_docs").alias("shard_docs"), "bytes")
