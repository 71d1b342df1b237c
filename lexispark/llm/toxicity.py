"""Toxicity scores after noisy-channel deobfuscation."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import stored

#: Character classes of the language model: 0 is a word's end, 1-26 a-z, then Latin letters with marks; the last is any other letter.
K = 64
#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c",
}
SEPARATORS = frozenset(" .-_*~^'")
#: Places where a word may be disguised: signs for letters, separators inside a token, single characters set apart.
#: SIGN and INNER begin with a plain class, which the search skips to quickly; a letter three times is sought by comparing arrays.
SIGN = re.compile(r"[0-9@$|+€£¡*]")
INNER = re.compile(r"[._\-~^!(<'](?=\S)")
#: A spaced span stands between any signs that are no letters or digits, with runs of separators inside; not after an elision ("i'd i ...").
SPACED = re.compile(r"(?:[^\W_]|[@$!|+€£¡])(?![^\W_])(?<![^\W_].)(?<![^\W_]['’].)(?:[ .\-_~^*]+(?:[^\W_]|[@$!|+€£¡(<])(?![^\W_])){2,}")
LETTER = re.compile(r"[^\W\d_]")
REPEATED = re.compile(r"([^\W\d_])\1\1")
TOKEN = re.compile(r"[^\W\d_]{3,}")
#: Lengths of word beginnings that can be evidence, beside whole words.
STARTS = (4, 5, 6, 7, 8)


def classes() -> np.ndarray:
    """Class by code point, for code points below 0x250; others are looked up in letter_class."""
    out = np.zeros(0x250, np.int32)
    for c in range(0x250):
        if chr(c).isalpha():
            out[c] = K - 1
    for i in range(26):
        out[97 + i] = out[65 + i] = 1 + i
    for i, c in enumerate(range(0xDF, 0x100)):
        if chr(c).isalpha():
            out[c] = 27 + i
    return out


CLASSES = classes()


def letter_class(ch: str) -> int:
    c = ord(ch)
    return int(CLASSES[c]) if c < 0x250 else K - 1 if ch.isalpha() else 0


def count_trigrams(texts: Iterable[str | None], into: np.ndarray, size: int = 1 << 20) -> None:
    """Add the character trigrams of lower-cased texts, each between word ends; works on ``size`` characters at once."""
    some, n = [], 0

    def add() -> None:
        codes = np.frombuffer(("  " + "  ".join(some) + "  ").lower().encode("utf-32-le", "replace"), np.uint32)
        x = np.where(codes < 0x250, CLASSES[np.minimum(codes, 0x24F)], K - 1)
        into.__iadd__(np.bincount((x[:-2] * K + x[1:-1]) * K + x[2:], minlength=K**3))
        some.clear()

    for t in texts:
        for at in range(0, len(t or ""), size):  # two characters of the piece before are read again
            some.append(t[max(0, at - 2) : at + size])
            n += size if at else len(t)
            if n >= size:
                add()
                n = 0
    if some:
        add()


def trigram_table(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts over all documents. At most K ** 3 sums reach the driver, however many documents there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(K**3, np.int64)
        for b in batches:
            count_trigrams(b["t"], n)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"g": some, "n": n[some]})

    sums = docs.select(F.col(text_col).alias("t")).mapInPandas(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(K**3, np.int64)
    out[sums["g"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def log_probabilities(n: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated over trigrams, bigrams and single characters."""
    tri = n.reshape(K, K, K).astype(np.float64)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 0.5) / (uni.sum() + 0.5 * K)
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


#: Longer spans are decoded each time, so that the cache of readings has a bound in bytes too.
CACHED = 200


class Decoder:
    """Viterbi decoding of a disguised span to the likeliest letters."""

    def __init__(self, logp: np.ndarray) -> None:
        self.logp = logp.tolist()
        self.kept = lru_cache(1 << 16)(self._decode)

    def decode(self, span: str) -> str:
        return self.kept(span) if len(span) <= CACHED else self._decode(span)

    def options(self, span: str) -> Iterator[list[tuple[str, float]]]:
        """For each sign or run of a letter, what it may be and at what cost."""
        at = 0
        while at < len(span):
            ch, end = span[at], at + 1
            while end < len(span) and span[end] == ch:
                end += 1
            n, at = end - at, end
            if ch in SEPARATORS:
                found = [("", 0.5 if ch != "*" else 1.5), (" ", 1.5)] + ([(v, 1.0) for v in "aeiou"] if ch == "*" and n == 1 else [])
            elif ch.isalpha():
                found = [(ch * n, 0.0)] if n < 3 else [(ch, 0.5), (ch * 2, 1.0), (ch * n, 1.5)]
            elif ch in LEET:
                found = [(c * m, 1.0 * m) for c in LEET[ch] for m in ({1, min(n, 2)})]
            else:
                found = [(" ", 0.0)]
            yield found

    def _decode(self, span: str) -> str:
        # A state's reading is a chain of (text, rest), so a step costs the same at any length.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for found in [*self.options(span), [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, out) in states.items():
                for text, cost in found:
                    x, y, s = a, b, score - cost
                    for ch in text:
                        c = letter_class(ch)
                        if c == 0 and y == 0:
                            continue
                        s += self.logp[x][y][c]
                        x, y = y, c
                    if (x, y) not in new or new[x, y][0] < s:
                        new[x, y] = (s, (text, out))
            states = new  # at most K * K
        best = max(s for s, _ in states.values())
        return max(self.reading(out) for s, out in states.values() if s == best).strip()

    @staticmethod
    def reading(chain: tuple | None) -> str:
        parts = []
        while chain:
            text, chain = chain
            parts.append(text)
        return "".join(reversed(parts))

    def restored(self, text: str) -> list[tuple[str, bool]]:
        """The decoded spans of a lower-cased text; true: set apart in single characters, where word ends are lost."""
        text = f" {text} ".replace("\n", " ").replace("\t", " ").replace("\r", " ")
        found = []
        for m in SPACED.finditer(text):
            found.append((self.decode(m[0]), True))
            # A mark at the end may be a letter or punctuation; both readings count.
            if (short := m[0].rstrip("!|+(<@$€£¡ .-_~^*")) != m[0] and len(short) > 4:
                found.append((self.decode(short), True))
        end = -1
        for at in self.places(text):
            if at < end:
                continue
            low, end = text.rfind(" ", 0, at) + 1, text.find(" ", at)
            span = text[low:end].strip("\"'`.,;:?#%()[]{}<>").rstrip("!*")
            if len(span) > 2 and not span.isalpha() or REPEATED.search(span):
                if LETTER.search(span):
                    found.append((self.decode(span), False))
        return found

    @staticmethod
    def places(text: str) -> list[int]:
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        same = codes[1:] == codes[:-1]
        again = np.flatnonzero(same[1:] & same[:-1])
        found = [i for i in again.tolist() if text[i].isalpha()] if len(again) else []
        found += [m.start() for m in SIGN.finditer(text)]
        found += [i for m in INNER.finditer(text) if text[(i := m.start()) - 1].isalpha() and text[i + 1].isalpha()]
        found.sort()
        return found


@dataclass
class Model:
    """Language model, evidence and weights; small and of fixed size."""

    logp: np.ndarray
    whole: list[str] = field(default_factory=list)
    starts: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])


class Scorer:
    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.model, self.decoder = model, Decoder(model.logp)
        self.find = ahocorasick.Automaton()
        for w in model.starts:
            self.find.add_word(w, (len(w), False))
        for w in model.whole:
            self.find.add_word(w, (len(w), w not in model.starts))
        self.any = bool(model.whole or model.starts)
        if self.any:
            self.find.make_automaton()

    def hits(self, text: str, loose: bool = False) -> int:
        """Words of the text that are evidence."""
        n, last = 0, -1
        for end, (size, whole) in self.find.iter(text) if self.any else ():
            low = end - size + 1
            if low <= last:
                continue
            if not loose and (low > 0 and text[low - 1].isalpha() or whole and end + 1 < len(text) and text[end + 1].isalpha()):
                continue
            n, last = n + 1, end
        return n

    def features(self, text: str | None) -> tuple[float, float]:
        t = (text or "").lower()
        n = self.hits(t) + sum(self.hits(s, spaced) for s, spaced in self.decoder.restored(t))
        return math.log1p(n), math.log1p(n) / math.log(10 + len(t) / 6)

    def score(self, text: str | None) -> float:
        x, y = self.features(text)
        a, b, c = self.model.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def evidence(text: str | None, decoder: Decoder) -> set[str]:
    """A document's words ("=word") and word beginnings, disguised ones restored."""
    t = (text or "").lower()
    found = set(TOKEN.findall(t))
    for s, _ in decoder.restored(t):
        found.update(TOKEN.findall(s))
    return {f"={w}" for w in found} | {w[:n] for w in found for n in STARTS if len(w) > n}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def prune(found: dict[str, tuple[int, int]]) -> tuple[list[str], list[str]]:
    """Whole words and beginnings, each only if no other explains it: a
    beginning stays if it holds notably more toxic documents than any longer
    beginning or whole word inside it, and then covers those."""
    at: dict[str, int] = {}
    for f, (t, _) in found.items():
        w = f.lstrip("=")
        for n in STARTS:
            if len(w) > n and (f[0] == "=" or n < len(w)):
                at[w[:n]] = max(at.get(w[:n], 0), t)
    starts = [f for f, (t, _) in sorted(found.items()) if f[0] != "=" and t > 1.1 * at.get(f, 0)]
    starts = [s for s in starts if not any(s[:n] in starts for n in STARTS if n < len(s))]
    cover = set(starts)
    whole = [f[1:] for f in sorted(found) if f[0] == "=" and not any(f[1 : n + 1] in cover for n in STARTS)]
    return whole, starts


def held_out(id_col: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves no remainder; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, odds: float = 4.0, spare: int = 3) -> Model:
    """Language model over all documents, classifier over labelled rows outside the held-out fold.

    At most ``max_rows`` labelled rows are used, those of the smallest id
    hashes; texts are whole. Evidence is every word, and every beginning of 4 to
    8 letters of a word, that stands in at least ``odds`` times as many toxic
    rows as others and ``spare`` more, and whose log-likelihood ratio chance
    does not explain; there is no bound on how many. Rows without a label are
    left out; of several labels of an id the largest counts. Without labels all
    scores are 0.2.
    """
    model = Model(log_probabilities(trigram_table(docs, text_col)))
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).filter(~held_out(F.col(id_col)))
    chosen = chosen.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    sample = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id"), "toxic-sample")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder, seen = Decoder(model.logp), {0: Counter(), 1: Counter()}
        for b in batches:
            for t, y in zip(b["t"], b["y"], strict=True):
                seen[y].update(evidence(t, decoder))
        names = list(seen[0] | seen[1])
        for low in range(0, len(names), 20_000):  # plain objects in slices: large string columns of pandas come in chunks, which the transfer refuses
            some = names[low : low + 20_000]
            yield pd.DataFrame({"f": pd.Series(some, dtype=object), "pos": [seen[1][f] for f in some], "neg": [seen[0][f] for f in some]})

    n1, n0 = (sample.filter(F.col("y") == y).count() for y in (1, 0))
    if not n1 or not n0:
        model.weights = [math.log((n1 + 0.5) / (n0 + 2)) if n1 + n0 else math.log(0.25), 0.0, 0.0]
        return model
    sums = sample.mapInPandas(tally, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rate = F.lit(n1 / (n1 + n0))
    both = F.col("pos") + F.col("neg")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
    ratio = 2 * (part(F.col("pos"), both * rate) + part(F.col("neg"), both * (1 - rate)))
    # A chance threshold: about one in twenty corpora of 100,000 features has a false one.
    strong = sums.filter(F.col("pos") >= odds * F.col("neg") + spare).withColumn("ratio", ratio).filter(F.col("ratio") > 2 * math.log(20 * 100_000))
    rows = strong.select("f", "pos", "neg").collect()  # of at most max_rows rows, whatever the number of documents
    model.whole, model.starts = prune({r["f"]: (r["pos"], r["neg"]) for r in rows})

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in batches:
            x = [scorer.features(t) for t in b["t"]]
            yield pd.DataFrame({"y": b["y"], "a": [v[0] for v in x], "b": [v[1] for v in x]})

    seen = sample.mapInPandas(measure, "y int, a double, b double").toPandas().sort_values(["y", "a", "b"])  # at most max_rows rows of three numbers
    x = np.column_stack([np.ones(len(seen)), seen["a"], seen["b"]])
    model.weights = logistic(x, seen["y"].to_numpy(np.float64))
    return model


def scores(model: Model, text: Column) -> Column:
    """The score of a text column, in Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for b in batches:
            yield pd.Series([scorer.score(t) for t in b], dtype="float64")

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting: float) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted.

    Tokens that may be disguised are decoded by Viterbi search over a lattice
    of their signs under a character trigram model of all documents: signs that
    stand for letters, separators between single characters, letters repeated.
    Evidence words and word beginnings are then sought in the text and in what
    was restored. Scores use the text alone. Null and empty texts get the score
    of a text without evidence. Repeated ids get a row each; other columns are
    ignored; an empty table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col, **fitting)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), scores(model, F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
