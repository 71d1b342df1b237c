"""Packing tokens into sequences by minimum bin slack."""

from __future__ import annotations

import struct
import sys
import types
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

#: Pieces that wait in a task for their window; half of them stay when it is full, so windows have a choice.
POOL = 1024
#: Entries of a worker's tables of known runs and words; a full table starts anew.
RUNS, WORDS = 1 << 19, 1 << 20

#: What the vocabulary's own splitting makes of a run without white space, for characters below U+0250.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: A word may end in these: they are one piece, and no contraction begins in them.
MARKS = ".,;:!?()\"*$"
#: A text with one of these is encoded whole: a special token may begin there, or Python alone takes it for white space.
WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


class Known(dict):
    """A table of found ids by text that starts anew when it is full; long texts are found each time."""

    def __init__(self, find: Callable[[str], bytes], most: int):
        self.find, self.most = find, most

    def __missing__(self, text: str) -> bytes:
        found = self.find(text)
        if len(text) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[text] = found
        return found


class Encoder:
    """Ids of whole texts, little-endian unsigned 32-bit, as the tokenizer's ``encode`` without special tokens gives them.

    The tokenizer drops white space and nothing it does reaches across it, so
    a text's ids are those of its runs, and known runs are looked up. A new run
    of characters below U+0250 is put in lower case and split here, where that
    is all its normalizer does, and only its new words go to the model; any
    other run is encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(PIECES).findall
        self.words, self.runs = Known(self.word, WORDS), Known(self.run, RUNS)
        # The vocabulary stands for bytes by printable characters: those that are printable in Latin-1, then others from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(self.shown[b] for b in word.encode())
        ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def run(self, run: str) -> bytes:
        if max(run) >= "ɐ" or "İ" in run or not run.isprintable():
            return self.whole(run)
        low = run.lower()
        if low.isalpha():
            return self.words[low]
        core = low.rstrip(MARKS)
        if core.isalpha():
            return self.words[core] + self.words[low[len(core) :]]
        return b"".join(map(self.words.__getitem__, self.split(low)))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in WHOLE):
            return self.whole(text)
        return b"".join(map(self.runs.__getitem__, text.split()))


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, so that its tables outlast a task; functions travel by value, so it stays in a module of its own."""
    kept = vars(sys.modules.setdefault("lexispark_worker", types.ModuleType("lexispark_worker")))
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def fullest(lengths: list[tuple[int, int]], capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """(sum, [(length, count)]): of the multiset ``lengths`` (length, count; descending) the part whose sum is the closest to ``capacity`` from below.

    Minimum bin slack: the largest length that fits is always taken. A bitset
    holds the sums that can be reached; it grows by each length in binary
    shares of its count, until the capacity itself is reached, and is kept
    before each share. Going back through them gives the counts taken.
    """
    fits = [(n, c) for n, c in lengths if n <= capacity]
    if not fits:
        return 0, []
    first = fits[0][0]
    fits[0] = (first, fits[0][1] - 1)
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1 << first, []
    for n, count in fits:
        share = 1
        while count and not reach >> capacity:
            use = min(share, count)
            steps.append((n, use, reach))
            reach |= reach << (n * use) & mask
            count, share = count - use, share * 2
        if reach >> capacity:
            break
    best = at = reach.bit_length() - 1
    taken = {first: 1}
    for n, use, before in reversed(steps):
        if not before >> at & 1:
            taken[n] = taken.get(n, 0) + use
            at -= n * use
    return best, list(taken.items())


class Pool:
    """Pieces by length, first come first taken."""

    def __init__(self) -> None:
        self.by: dict[int, deque] = {}
        self.pieces = self.tokens = 0

    def add(self, piece: tuple) -> None:
        n = len(piece[-1]) // 4
        self.by.setdefault(n, deque()).append(piece)
        self.pieces, self.tokens = self.pieces + 1, self.tokens + n

    def take(self, n: int) -> tuple:
        queue = self.by[n]
        piece = queue.popleft()
        if not queue:
            del self.by[n]
        self.pieces, self.tokens = self.pieces - 1, self.tokens - n
        return piece

    def window(self, capacity: int) -> list[tuple]:
        """The pieces of the next sequence. Slack that no choice fills is filled by a cut; what is cut off stays in the pool."""
        target = capacity if self.tokens >= capacity else 1 << (self.tokens.bit_length() - 1)
        best, chosen = fullest([(n, len(self.by[n])) for n in sorted(self.by, reverse=True)], target)
        out = [self.take(n) for n, count in chosen for _ in range(count)]
        while best < target:
            doc, start, total, ids = self.take(max(self.by))
            room = min(target - best, len(ids) // 4)
            out.append((doc, start, total, ids[: 4 * room]))
            if len(ids) > 4 * room:
                self.add((doc, start + room, total, ids[4 * room :]))
            best += room
        return out


def windows(docs: Iterator[tuple[object, bytes]], capacity: int, pool_pieces: int) -> Iterator[list[tuple]]:
    """Sequences as lists of (doc, start, doc_tokens, ids) for (doc, ids): whole windows of a long document at once, the rest by the pool."""
    pool, size = Pool(), 4 * capacity
    for doc, ids in docs:
        total, whole = len(ids) // 4, len(ids) // size
        for i in range(whole):
            yield [(doc, i * capacity, total, ids[i * size : (i + 1) * size])]
        if len(ids) > whole * size:
            pool.add((doc, whole * capacity, total, ids[whole * size :]))
        if pool.pieces > pool_pieces:
            while pool.pieces > pool_pieces // 2 and pool.tokens >= capacity:
                yield pool.window(capacity)
    while pool.pieces:
        yield pool.window(capacity)


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str | None], bytes]], id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, pool_pieces: int = POOL) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): each piece of each document and where it stands.

    A document is its text's ids and ``end_id``; ``ids`` are the piece's, as
    little-endian unsigned 32-bit numbers. Documents of more than ``capacity``
    tokens fill whole sequences; what remains of them and shorter ones are
    chosen by minimum bin slack from a pool, and where no choice fills a
    sequence, one piece is cut. A task's last tokens fill sequences of powers
    of two, so nothing is padded at all.

    ``encoder`` gives a task its encoder from text to ids, as ``worker_encoder`` does.
    Each task encodes and packs the rows of its own split in one pass and holds
    no more than the pool and a batch, so nothing is shuffled, no document
    meets all others, and a lost task is done again alike as long as its rows
    come alike, as from files. Null and empty texts are ``end_id`` alone;
    repeated rows and null ids are documents of their own; an empty table gives
    no rows. Other columns are not read.
    """
    schema = f"doc_id {docs.select(id_col).dtypes[0][1]}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence, rows = None, TaskContext.get().partitionId() << 33, []

        def encoded() -> Iterator[tuple[object, bytes]]:
            nonlocal encode
            for b in batches:
                encode = encode or encoder()
                for i, t in zip(b.column(0), b.column(1), strict=True):  # one text at a time becomes a Python string
                    yield i.as_py(), encode(t.as_py()) + end

        def batch() -> pa.RecordBatch:
            doc, start, total, number, offset, ids = zip(*rows, strict=True)
            length = [len(x) // 4 for x in ids]
            columns = zip((doc, start, length, total, number, offset, ids), arrow, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in columns], schema=arrow)

        for sequence, pieces in enumerate(windows(encoded(), capacity, pool_pieces), sequence):
            offset = 0
            for doc, start, total, ids in pieces:
                rows.append((doc, start, total, sequence, offset, ids))
                offset += len(ids) // 4
            if len(rows) >= 256:
                yield batch()
                rows = []
        if rows:
            yield batch()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
