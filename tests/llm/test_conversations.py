"""Conversation repair against a search over all edits that carries whole audits."""

import hashlib
import heapq
import random
import re
import zlib

from lexispark.llm import conversations
from lexispark.llm.queries import op13_conversations

STEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The columns but the id for (turn, role, text) in order: cheapest paths first, whole audits break ties."""
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(conversations.BLANKS)
        faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            break
        for role in ("user", "assistant"):
            if (role[0], state) in STEP:
                heapq.heappush(heap, (cost + 5, audit + "I", i, STEP[role[0], state], (*out, f"{role}:")))
        if i < len(rows):
            _, own, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if faults[i] not in ("b", "d"):
                paid = cost + 5 * (faults[i] == "t")
                for letter, price, role in (("K", 0, own), ("R", 1, "user"), ("R", 1, "assistant")):
                    if (role[:1], state) in STEP:
                        heapq.heappush(heap, (paid + price, audit + letter, i + 1, STEP[role[:1], state], (*out, f"{role}:{text}")))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damaged(rows):
    for c, t, role, text in rows:
        one = lambda v: " " if v is None else str(v)
        h, role, text = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20, one(role), one(text)
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            yield from [(c, t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)


def check(got, ids, rows):
    want = {i: [] for i in ids}
    for c, t, role, text in rows:
        want[c].append((t, " " if role is None else role, " " if text is None else text))
    assert len(got) == len(want)
    for c, *found in got:
        ordered = sorted(want[c], key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.sha256(v[2].encode()).hexdigest()))
        assert tuple(found) == brute(ordered), c


def test_query_against_a_search(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(op13_conversations(spark, sf).collect(), {r[0] for r in rows}, list(damaged(rows)))


def test_nulls_ties_repeats_and_far_turns(spark):
    rng = random.Random(3)
    turns, roles = [None, 0, 1, 2, 3, 5, 70, 200, -70, 9999, 10**7], ["system", "user", "assistant", "user", "assistant", None, "", "tool"]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6]) if i % 3 else i, rng.choice(turns), rng.choice(roles), rng.choice(["a.", "b!", "c?", "d", "e. ", "f\n", "", " ", None, "g.", "h."])) for i in range(600)]
    rows += [(8, 1, "user", "same.")] * 500 + [(9, i, "user", "again?") for i in range(200)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, seg int, key string")
    check(conversations.repair(df, df).collect(), {r[0] for r in rows}, rows)


def test_one_long_conversation_goes_over_segments(spark):
    rng = random.Random(4)
    rows = [(7, i, rng.choice(["system", "user", "assistant", "user", "assistant"]), f"t{rng.randint(0, 3000)}{rng.choice('.....!?x')}") for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert conversations.SPAN**2 < 5000  # so there are three levels
    check(conversations.repair(df, df).collect(), {7}, rows)


def test_batches_do_not_matter(spark, monkeypatch):
    rows = [(i % 40, i, ["user", "assistant"][i % 3 > 0], f"x{i % 7}.") for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(conversations, "BATCH", 50)
    check(conversations.repair(df, df).collect(), set(range(40)), rows)


def test_very_long_texts_and_no_rows(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "b" * 1_000_000), (2, 0, "assistant", " " * 100_000)]
    df, ids = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1,), (2,), (3,), (None,)], "conv_id long")
    check(conversations.repair(df, ids).collect(), {1, 2, 3, None}, rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(empty, empty).collect() == []
    assert [tuple(r)[1:7] for r in conversations.repair(empty, ids).collect()] == [(0,) * 6] * 4


def test_the_repaired_turns(spark):
    rows = conversations.keyed(spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "tool", "u."), (1, 2, "tool", "u."), (1, 3, "user", "end.")], SCHEMA), *("conv_id", "turn", "role", "text"))
    found = conversations.audits(rows)
    assert [r.audit for r in found.collect()] == ["RKRDR"]
    turns = conversations.repaired(rows, found.select("key", "audit")).orderBy("place").collect()
    assert [(r.edit, r.role, r.text) for r in turns] == [("R", "user", "s."), ("K", "assistant", "a."), ("R", "user", "u."), ("R", "assistant", "end.")]
