"""Repair of conversations: the cheapest edits that make their roles alternate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import discard, few, stored

#: What may stand around a text without being part of it.
BLANKS = " \t\n\x0b\x0c\r"
#: Turns of a segment of a conversation, and segments of a wider one.
SPAN = 64
#: Rows of a batch that one DuckDB query takes.
BATCH = 20_000
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The role that a rerole or an insert gives in each state: at the start, after s, after u, after a.
NEXT = ("user", "user", "assistant", "user")

# The grammar `(s?(ua)+)?` has four states: 0 at the start, 1 after s, 2 after u, 3 after a; it may end in 0 and 3.
_INSERTS = [(0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (2, 2, 2), (3, 3, 0), (3, 2, 1), (3, 3, 2)]
_STEPS = [("s", 0, 1), *(("u", s, 2) for s in (0, 1, 3)), ("a", 2, 3)]


def grammar() -> list[tuple[str, int, int, int, str]]:
    """(initial, s, e, cost, letters): the best way to keep or rerole a row of that initial, after up to two inserts, between two states.

    Inserts stand right before a row that stays: before one that goes they
    would be later in ASCII order. Two inserts reach every state. No audit of
    the same rows that ends in a row is a prefix of another, so the least
    letters of a part are part of the least audit.
    """
    best: dict[tuple[str, int, int], tuple[int, str]] = {}
    for initial in "sua ":
        keep = [(a, b, 0, "K") for i, a, b in _STEPS if i == initial]
        rerole = [(s, 3 if s == 2 else 2, REROLE, "R") for s in range(4)]
        for s, at, n in _INSERTS:
            for a, e, cost, letter in keep + rerole:
                if a == at:
                    found = (cost + n * INSERT, "I" * n + letter)
                    best[initial, s, e] = min(best.get((initial, s, e), found), found)
    return [(i, s, e, cost, letters) for (i, s, e), (cost, letters) in best.items()]


_GRAMMAR = ", ".join(f"('{i}', {s}, {e}, {cost}, '{letters}')" for i, s, e, cost, letters in grammar())
_BAD = "NOT coalesce({0}, '') || {1} IN ('su', 'ua', 'au')"

#: One step for each distinct row, its repeats included, with what it may cost between two states.
ROWS = f"""
CREATE TEMP TABLE placed AS
SELECT key, seg, row_number() OVER w - 1 AS step, m, forced, truncated, initial, lag(initial) OVER w AS before
FROM given WINDOW w AS (PARTITION BY key, seg ORDER BY turn NULLS FIRST, role, digest);
CREATE TEMP TABLE seams AS
SELECT key, seg, CAST(max(step) + 1 AS BIGINT) AS steps, arg_min(initial, step) AS first, arg_max(initial, step) AS last,
       CAST(sum(m - 1) + count(*) FILTER (step > 0 AND {_BAD.format("before", "initial")}) AS BIGINT) AS illegal
FROM placed GROUP BY key, seg;
CREATE TEMP TABLE edits AS
SELECT key, seg, step, s, s AS e, {DELETE} * m AS cost, repeat('D', m) AS letters FROM placed, (SELECT unnest(range(4)) AS s)
UNION ALL
SELECT key, seg, step, s, e, g.cost + {DELETE} * (m - 1) + CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END, letters || repeat('D', m - 1)
FROM placed p JOIN (VALUES {_GRAMMAR}) g(initial, s, e, cost, letters) ON g.initial = CASE WHEN p.initial IN ('s', 'u', 'a') THEN p.initial ELSE ' ' END
WHERE NOT forced"""

#: One step for each part of a wider segment.
PARTS = f"""
CREATE TEMP TABLE parts AS SELECT key, wide AS seg, dense_rank() OVER (PARTITION BY key, wide ORDER BY seg) - 1 AS step, s, e, cost, audit, first, last, illegal FROM given;
CREATE TEMP TABLE seams AS
SELECT key, seg, CAST(max(step) + 1 AS BIGINT) AS steps, arg_min(first, step) AS first, arg_max(last, step) AS last,
       CAST(sum(illegal) + count(*) FILTER (step > 0 AND {_BAD.format("before", "first")}) AS BIGINT) AS illegal
FROM (SELECT *, lag(last) OVER (PARTITION BY key, seg ORDER BY step) AS before FROM parts WHERE s = 0 AND e = 0) GROUP BY key, seg;
CREATE TEMP TABLE edits AS SELECT key, seg, step, s, e, cost, audit AS letters FROM parts"""

#: Each recursion advances one step in all segments of the batch and keeps the least cost and audit for each pair of states.
WALK = """
WITH RECURSIVE walk AS (
  SELECT key, seg, s, s AS e, 0::BIGINT AS step, 0::BIGINT AS cost, '' AS audit FROM seams, (SELECT unnest(range(4)) AS s)
  UNION ALL
  SELECT key, seg, s, e, step + 1, best.cost, best.audit FROM (
    SELECT w.key, w.seg, w.s, x.e, w.step, min({'cost': w.cost + x.cost, 'audit': w.audit || x.letters}) AS best
    FROM walk w JOIN edits x ON x.key = w.key AND x.seg = w.seg AND x.step = w.step AND x.s = w.e GROUP BY ALL))
SELECT w.key, w.seg, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e, CAST(cost AS BIGINT) AS cost, audit, first, last, illegal
FROM walk w JOIN seams USING (key, seg) WHERE step = steps"""

PART_SCHEMA = "key string, seg bigint, s int, e int, cost bigint, audit string, first string, last string, illegal bigint"


def walked(rows: DataFrame, number: int, prepare: str) -> DataFrame:
    """(key, seg, s, e, cost, audit, first, last, illegal): whole segments, dealt
    by a hash to batches, each of which is one recursive DuckDB query."""

    def run(batch: pa.Table) -> pa.Table:
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as db:
            db.register("given", batch)
            for statement in prepare.split(";"):
                db.execute(statement)
            return db.sql(WALK).to_arrow_table()

    batches = max(1, -(-number // BATCH))
    return rows.withColumn("batch", F.pmod(F.xxhash64("key", F.col("wide" if "wide" in rows.columns else "seg")), F.lit(batches))).groupBy("batch").applyInArrow(run, PART_SCHEMA)


def keyed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(key, conv_id, turn, role, text, digest): names of our own; a null id has a key too, null roles and texts are one blank."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))
    return rows.select(key.alias("key"), F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), one(role_col).alias("role"), one(text_col).alias("text")).withColumn("digest", F.sha2("text", 256))


def audits(rows: DataFrame) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each key of ``rows`` (as ``keyed`` gives them).

    Texts stay behind: what is shuffled is a digest and flags, and equal rows
    of one turn are one row with a count. A conversation is dealt out in
    segments of 64 turns, so a long one is work for many tasks; segments'
    results, at most sixteen, are joined 64 at a time by the same query.
    """
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    flags = rows.select("key", "turn", "role", "digest", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open"))
    light = stored(flags.groupBy("key", "turn", "role", "digest", "blank", "open").agg(F.count(F.lit(1)).alias("m")), "turns")
    said = light.filter("not blank").groupBy("key", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.count(F.lit(1)).alias("turns"))
    again = stored(said.filter("turns > 1").select("key", "role", "digest", F.col("first.turn").alias("said"), F.lit(True).alias("again")), "said")
    faults = light.join(few(again), ["key", "role", "digest"], "left").withColumn("repeat", F.coalesce(F.col("again") & ~F.col("turn").eqNullSafe(F.col("said")), F.lit(False)))
    faults = stored(faults.select("key", "turn", "role", "digest", "m", "blank", "repeat", (F.col("open") & ~F.col("blank") & ~F.col("repeat")).alias("truncated")), "faults")

    seg = F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(1 << 62)))
    steps = faults.select("key", seg.alias("seg"), "turn", "role", "digest", "m", (F.col("blank") | F.col("repeat")).alias("forced"), "truncated", F.substring("role", 1, 1).alias("initial"))
    parts = stored(walked(steps, faults.count(), ROWS), "parts")
    while (most := parts.filter("s = 0 and e = 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > 1:
        wide = F.lit(0).cast("bigint") if most <= SPAN else F.floor(F.col("seg") / SPAN)
        wider = stored(walked(parts.withColumn("wide", wide), parts.count(), PARTS), "parts")
        discard(parts)
        parts = wider
    close = F.col("cost") + F.when(F.col("e") == 1, 2 * INSERT).when(F.col("e") == 2, INSERT).otherwise(0)
    ended = F.concat("audit", F.when(F.col("e") == 1, "II").when(F.col("e") == 2, "I").otherwise(""))
    best = parts.filter("s = 0").groupBy("key").agg(F.min(F.struct(close.alias("cost"), ended.alias("audit"))).alias("x"), F.first("illegal").alias("illegal"))

    n = lambda c: F.sum(F.when(c, F.col("m")).otherwise(0))
    copies = F.sum(F.when(F.col("blank"), 0).when(F.col("repeat"), F.col("m")).otherwise(F.col("m") - 1))
    turns = faults.groupBy("key", "turn").agg(n(F.col("blank")).alias("blank"), copies.alias("duplicate"), F.sum(F.col("truncated").cast("bigint")).alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = turns.groupBy("key").agg(gaps.alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    out = stored(counts.join(best.select("key", "illegal", "x.cost", "x.audit"), "key"), "audits")
    discard(light, again, faults, parts)
    return out


TURNS = pa.schema([("key", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
HASHES = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in zip(columns, schema, strict=True)], schema=schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, place, edit, role, text): the turns that the audits in ``found``
    (key, audit) make of ``rows`` (as ``keyed`` gives them), in order within each partition.

    Rows are dealt by conversation and stream by in order behind their audit,
    so a task holds a batch and one audit, however long a conversation is.
    """
    columns = ["key", "kind", "late", "turn", "role", "digest", "text"]
    heads = found.select("key", F.lit(0).alias("kind"), F.lit(False).alias("late"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    lines = rows.select("key", F.lit(1).alias("kind"), F.col("turn").isNotNull().alias("late"), "turn", "role", "digest", "text")
    stream = heads.unionByName(lines).repartition("key").sortWithinPartitions(*columns[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, state, place = None, "", 0, 0, 0
        out: list[tuple] = []

        def put(edit: str, role: str, text: str) -> None:
            nonlocal state, place
            out.append((key, place, edit, role, text))
            state, place = {"s": 1, "u": 2, "a": 3}[role[0]], place + 1

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", NEXT[state], "")
                at += 1

        for b in batches:
            for k, kind, role, text in rows_of(b):
                if kind == 0:
                    inserts()  # those at the end of the conversation before
                    key, audit, at, state, place = k, text, 0, 0, 0
                    continue
                inserts()
                if (edit := audit[at]) != "D":
                    put(edit, NEXT[state] if edit == "R" else role, text)
                at += 1
            yield batch_of(out, TURNS)
            out.clear()
        inserts()
        yield batch_of(out, TURNS)

    return stream.select("key", "kind", "role", "text").mapInArrow(run, "key string, place bigint, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of what ``repaired`` returns: its ``role:text`` lines in order, joined by newlines, hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            done = []
            for k, place, role, text in rows_of(b):
                if place == 0:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield batch_of(done, HASHES)
        if state is not None:
            yield batch_of([(key, state.hexdigest())], HASHES)

    return turns.select("key", "place", "role", "text").mapInArrow(run, "key string, repaired_sha256 string")


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``rows`` with planted faults, by crc32 of ``conv:turn`` modulo 20: 0 drops
    the row, 1 empties its text, 2 takes out its sentence marks, 3 repeats it,
    4 makes it the user's; nulls count as one blank there, and so they become in roles and texts."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.pmod(F.crc32(F.concat(one(conv_col), F.lit(":"), one(turn_col)).cast("binary")), F.lit(20))
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(one(text_col), "[.!?]", "")).otherwise(one(text_col))
    copies = F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    taken = rows.filter(h != 0).select(F.col(conv_col), F.col(turn_col), F.when(h == 4, "user").otherwise(one(role_col)).alias(role_col), text.alias(text_col), copies.alias("copy 0"))
    return taken.drop("copy 0")


def repair(rows: DataFrame, ids: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row for each distinct id in ``ids`` (its column ``conv_col``).

    A row's first fault counts: its text is blank, its role and text were seen
    earlier in the conversation, or its text does not end in a sentence mark.
    Edits are Keep (free), Rerole (1), Delete (2; a must for the first two
    faults) and Insert (5); a truncated row that stays adds 5. ``audit`` has
    the initials of the cheapest edits that make the roles ``(s?(ua)+)?``, the
    first in ASCII order of equally cheap ones.

    Rows come by turn, null turns first; rows of one turn come by role and
    digest of the text, since a table has no order. Null ids are one
    conversation; null roles and texts are one blank. An id without rows has
    zeros, an empty audit and the digest of the empty string; empty ``ids``
    give no rows. Other columns are not read. ``repaired`` gives the turns.
    """
    rows = keyed(rows, conv_col, turn_col, role_col, text_col)
    found = audits(rows)
    hashed = digests(repaired(rows, found.select("key", "audit")))
    ids = ids.select(F.col(conv_col).alias("conv_id")).distinct().withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    out = ids.join(found, "key", "left").join(hashed, "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
