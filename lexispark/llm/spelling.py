"""Spelling variants: words one edit apart, found by Aho-Corasick automata over word halves."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import ascii_lower, discard, few, same_files, stored

#: A run of letters after A-Z are lower-cased.
RUN = r"[a-zÀ-ÿ]+"
#: Words of fewer code points have no variants; a word's half then has two code points or more.
LEAST_LENGTH = 5
#: Words of a shard of an automaton; a fuller shard becomes several blocks.
SHARD_WORDS = 20_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, damage: int | None = None) -> DataFrame:
    """(word, n): the words of at least five code points with ``least`` occurrences or more.

    ``damage``: if crc32 of ``<id>:<run>`` is a multiple of it, the run loses
    the code point at that number modulo its length, wherever it stands. Null
    texts have no words, a null id counts as the empty string.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.char_length("run") >= LEAST_LENGTH)  # damage makes no run longer
    word = F.col("run")
    if damage:
        runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
        cut = F.pmod("h", F.char_length("run")).cast("int")
        word = F.when(F.pmod("h", F.lit(damage)) == 0, F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.char_length("run")))).otherwise(word)
    words = runs.select(word.alias("word")).filter(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def halves(word: str) -> tuple[str, str]:
    """The two segments of a word; the second is the longer one of an odd word."""
    at = len(word) // 2
    return word[:at], word[at:]


def scan(tail: bool, patterns: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs (pattern, text) one edit apart whose edit spares the pattern's head (or its ``tail``).

    The pattern is the shorter word of a pair or, of equal lengths, the lesser
    one. One automaton holds the spared segments. A hit counts if the segment
    stands at the text's start (or end) and a pattern with that segment is as
    long as the text or one shorter. The distance is then verified on what the
    segment leaves: the rest of the text equals a pattern's rest but for one
    code point, or equals it without one. That is a look-up of the rest with a
    gap, so a segment with thousands of patterns costs no more than one.
    A pair whose edit spares both halves is given for the head only.
    """
    automaton = ahocorasick.Automaton()
    rests: dict[str, dict[str, list[str]]] = {}
    for w in patterns:
        head, end = halves(w)
        segment, rest = (end, head) if tail else (head, end)
        found = rests.setdefault(segment, {})
        found[rest] = [w]  # one word has this segment and this rest
        for i in range(len(rest)):
            found.setdefault(f"{rest[:i]}\0{rest[i + 1 :]}", []).append(w)
    for segment, found in rests.items():
        automaton.add_word(segment, (len(segment), found))
    if not rests:
        return
    automaton.make_automaton()
    for v in texts:
        size = len(v)
        for end, (k, found) in automaton.iter(v):
            if end != (size if tail else k) - 1 or not 2 * k - 1 <= size <= 2 * k + 2:
                continue
            rest = v[: size - k] if tail else v[k:]
            for i in range(len(rest)):
                for w in found.get(f"{rest[:i]}\0{rest[i + 1 :]}", ()):
                    if w < v and len(w) == size:
                        yield w, v
            for shorter in {rest[:i] + rest[i + 1 :] for i in range(len(rest))}:
                for w in found.get(shorter, ()):
                    if len(w) == size - 1 and not (tail and v.startswith(w[: len(w) // 2])):
                        yield w, v


def near_pairs(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words (word, n; distinct, five code points
    or more) one edit apart, once; ``a`` is the shorter or lesser word.

    A word is a pattern and a text in two shards: one goes by its first two
    code points and has an automaton of heads, the other by its last three and
    has one of tails, so words meet where a half of one can stand in the other
    and nowhere else. Shards are dealt by a hash of those code points. One with
    more than ``shard_words`` words is a square of blocks, each with the
    automaton of some patterns and some of the texts; no pair is lost.
    """
    shards = max(1, -(-words.count() // shard_words))
    anchor = F.explode(F.array(F.struct(F.lit(False).alias("tail"), F.substring("word", 1, 2).alias("anchor")), F.struct(F.lit(True).alias("tail"), F.substring("word", -3, 3).alias("anchor"))))
    dealt = words.select("word", "n", anchor.alias("x")).select("word", "n", "x.tail", F.pmod(F.xxhash64("x.anchor"), F.lit(shards)).alias("shard"))
    sizes = stored(dealt.groupBy("tail", "shard").agg(F.ceil(F.count(F.lit(1)) / shard_words).cast("int").alias("blocks")), "shards")
    own = F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int")
    dealt = dealt.join(few(sizes), ["tail", "shard"]).select("word", "n", "tail", "shard", "blocks", own.alias("own"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.col("own").alias("p"), i.alias("t")))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("p"), F.col("own").alias("t")))
    cells = dealt.select("word", "n", "tail", "shard", "own", F.explode(F.array_union(every, others)).alias("cell")).select("word", "n", "tail", "shard", "own", "cell.p", "cell.t")

    def pairs(rows: pa.Table) -> pa.Table:
        c = rows.to_pydict()
        n = dict(zip(c["word"], c["n"], strict=True))
        patterns, texts = ([w for w, own, at in zip(c["word"], c["own"], c[x], strict=True) if own == at] for x in "pt")
        found = list(scan(c["tail"][0], patterns, texts))
        a, b = ([f[i] for f in found] for i in (0, 1))
        return pa.table([pa.array(a, pa.string()), pa.array([n[w] for w in a], pa.int64()), pa.array(b, pa.string()), pa.array([n[w] for w in b], pa.int64())], names=["a", "n_a", "b", "n_b"])

    return cells.groupBy("tail", "shard", "p", "t").applyInArrow(pairs, "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root), a stored table, for (word, form): forms are followed to the
    last, twice as far in each round. A form has at least twice its word's
    count, so a chain has fewer than 64 words and ends."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ends = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stored(now.join(few(same_files(ends, now)), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        if new.filter("moved").isEmpty():
            return new
        now = new


def variants(words: DataFrame, ratio: int = 2, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of ``words`` (word, n), which must be distinct.

    ``n_near`` counts the words that differ by exactly one inserted, deleted or
    replaced code point. ``form`` is the near word of the largest n (of equal
    ones the first in code-point order) if that is at least ``ratio`` times the
    word's n, else null; ``root`` is where following forms ends, the word
    itself if it has none. An empty table gives no rows; columns beside word
    and n are left out.
    """
    words = stored(words.select("word", "n"), "words")
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("m"))))
    links = near_pairs(words, shard_words).select(both.alias("x")).select("x.*")
    best = links.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "near")).alias("best"))
    enough = -F.col("best.minus") >= ratio * F.col("n")
    near = stored(best.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")), "near")
    ends = roots(near.filter("form is not null"))
    found = words.join(few(near), "word", "left").join(few(ends), "word", "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, ratio: int = 2, damage: int | None = None) -> DataFrame:
    """Variants of the words of whole texts; see ``word_counts`` and ``variants``.

    Each row's text counts, repeated rows too. Null and empty texts have no
    words; without words there are no rows. Other columns are not read.
    """
    return variants(word_counts(docs, id_col, text_col, least, damage), ratio)
