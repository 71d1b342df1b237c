"""N-gram Jaccard join: MinHash LSH forest, then exact verification."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import discard, integral, stored

#: Bytes of text that are worked on at once.
PIECE = 1 << 20
#: Sets and bytes of text of a block; a larger node is verified block against block.
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
#: Copies of one text are dealt over so many salts, by their ids.
SALTS = 60
SALT = f"cast(pmod(xxhash64(doc_id), {SALTS}) as int)"
U = np.uint64
_LUT = np.zeros(256, np.uint8)  # the byte after lower-casing A-Z, 0 for what is not in words
for _c in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _LUT[_c] = _c
for _c in range(0x41, 0x5B):
    _LUT[_c] = _c + 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 bytes, and the place where each begins."""
    low = _LUT[data]
    inside = low != 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, U), start
    out, length = np.zeros(len(start), U), end - start
    # Eight bytes of all words that have them, at a time: words are short, so there are few rounds.
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    live, at = np.arange(len(start)), start.copy()
    while len(live):
        chunk = np.zeros(len(live), U)
        left = np.minimum(end[live] - at[live], 8)
        for j in range(8):
            chunk |= np.where(left > j, padded[at[live] + j].astype(U), U(0)) << U(8 * j)
        out[live] = mixed(out[live] * U(0x9E3779B97F4A7C15) + chunk + U(1))
        at[live] += 8
        live = live[at[live] < end[live]]
    return mixed(out ^ length.astype(U)), start


def shingles(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n successive words; of fewer words, but not none, one for all of them."""
    if not len(w):
        return w
    k = min(n, len(w))
    out = np.zeros(len(w) - k + 1, U)
    for j in range(k):
        out = mixed(out * U(0xD6E8FEB86659FD93) + w[j : len(w) - k + 1 + j])
    return out


def texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a text column: the first row, the rows' byte offsets, the bytes. A longer text is a piece of its own."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(o, o[low] + PIECE, "right")) - 1)
        yield low, o[low : high + 1] - o[low], d[o[low] : o[high]]
        low = high


def rows_of_words(offsets: np.ndarray, data: np.ndarray) -> Iterator[np.ndarray]:
    """The word hashes of each text of a piece. Texts end at a byte outside words, since none is added between them each is cut at its own offset."""
    if len(offsets) == 2:
        yield word_hashes(data)[0] if len(data) <= 8 * PIECE else np.concatenate(list(_long(data)))
        return
    # One separator between texts, so that words do not run together.
    n = len(offsets) - 1
    where = np.repeat(np.arange(n), np.diff(offsets))
    spread = np.zeros(len(data) + n, np.uint8)
    spread[np.arange(len(data)) + where] = data
    h, start = word_hashes(spread)
    cut = np.searchsorted(start, offsets + np.arange(n + 1))
    for i in range(n):
        yield h[cut[i] : cut[i + 1]]


def _long(data: np.ndarray) -> Iterator[np.ndarray]:
    """A very long text in pieces that end outside words."""
    low = 0
    while low < len(data):
        high = min(len(data), low + 4 * PIECE)
        while high < len(data) and _LUT[data[high]]:
            high += 1
        yield word_hashes(data[low:high])[0]
        low = high


class Forest:
    """``trees`` prefix tries over signatures of ``depth`` minimum hashes each."""

    def __init__(self, trees: int = 16, depth: int = 8, seed: int = 11) -> None:
        g = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.a = g.integers(1, 2**63, trees * depth, dtype=np.int64).astype(U) | U(1)
        self.b = g.integers(0, 2**63, trees * depth, dtype=np.int64).astype(U)

    def recall(self, similarity: float, length: int) -> float:
        """Chance that two texts of a similarity share a prefix of a length in any tree."""
        return 1 - (1 - similarity**length) ** self.trees

    def length(self, threshold: float, target: float) -> int:
        """The longest prefix that reaches the target recall for any pair above the threshold: no prefix is ever shortened further."""
        length = self.depth
        while length > 1 and self.recall(threshold, length) < target:
            length -= 1
        return length

    def path(self, s: np.ndarray) -> np.ndarray:
        """For each depth and tree the hash of the first values of the signature of a set: the set's nodes from the root down."""
        out, now = np.zeros((self.depth, self.trees), U), np.zeros(self.trees, U)
        step = max(1, (1 << 16) // max(1, len(s)))
        for j in range(self.depth):
            at = np.arange(j, self.trees * self.depth, self.depth)
            low = np.empty(self.trees, U)
            for t in range(0, self.trees, step):
                part = at[t : t + step]
                low[t : t + step] = (((s[None, :] * self.a[part, None]) + self.b[part, None]) >> U(16)).min(1)
            now = mixed(now * U(0x9E3779B97F4A7C15) + low)
            out[j] = now
        return out


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, forest: Forest, floor: int) -> DataFrame:
    """(doc_id, key, bytes, base, deep), all but the first null where there are
    no words. base has the nodes at depth ``floor`` of each tree, deep those
    below, depth by depth; a node below is told by base and deep together."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("bytes", pa.int64()), ("base", pa.list_(pa.int64())), ("deep", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, offsets, data in texts_of(b.column(1)):
                keys, base, deep = [], [], []
                for w in rows_of_words(offsets, data):
                    s = np.unique(shingles(w, n))
                    path = forest.path(s) if len(s) else None
                    keys.append(key_of(s) if len(s) else None)
                    base.append(path[floor - 1].view(np.int64) if len(s) else None)
                    deep.append((path[floor:] >> U(32)).astype(np.uint32).view(np.int32).ravel() if len(s) else None)
                yield pa.record_batch([b.column(0).slice(low, len(keys)), pa.array(keys, pa.binary()), pa.array(np.diff(offsets)), pa.array(base, pa.list_(pa.int64())), pa.array(deep, pa.list_(pa.int32()))], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, key binary, bytes long, base array<long>, deep array<int>")


def key_of(s: np.ndarray) -> bytes:
    """128 bits for a sorted set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def shingle_sets(texts: DataFrame, n: int) -> DataFrame:
    """(key, base, deep, set) for (key, base, deep, t): the sorted shingle hashes, as bytes. Rows whose text is another one of a repeated id go."""
    schema = pa.schema([("key", pa.binary()), ("base", pa.list_(pa.int64())), ("deep", pa.list_(pa.int32())), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, offsets, data in texts_of(b.column(3)):
                sets = [np.unique(shingles(w, n)) for w in rows_of_words(offsets, data)]
                part = b.slice(low, len(sets))
                same = [i for i, (k, s) in enumerate(zip(part.column(0).to_pylist(), sets, strict=True)) if len(s) and key_of(s) == k]
                yield pa.record_batch([*(part.column(c).take(pa.array(same, pa.int64())) for c in range(3)), pa.array([sets[i].tobytes() for i in same], pa.binary())], schema=schema)

    return texts.select("key", "base", "deep", "t").mapInArrow(run, "key binary, base array<long>, deep array<int>, set binary")


def similar(sets: list[np.ndarray], rows: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j), i < rows, of sets whose Jaccard similarity reaches the threshold, exactly, and that similarity.

    Elements are numbered; those in one set only cannot be in common and are
    left out. Columns of a 0/1 matrix are multiplied some at a time.
    """
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count > 1
    number = np.cumsum(keep) - 1
    use = keep[index]
    columns, owner = number[index[use]], owner[use]
    order = np.argsort(columns, kind="stable")
    columns, owner = columns[order], owner[order]
    common = np.zeros((rows, len(sets)), np.float32)
    width = 4096
    cuts = np.searchsorted(columns, np.arange(0, int(keep.sum()) + width, width))
    for c, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if high > low:
            m = np.zeros((len(sets), width), np.float32)
            m[owner[low:high], columns[low:high] - c * width] = 1
            common += m[:rows] @ m.T
    union = size[:rows, None] + size[None, :] - common
    i, j = np.nonzero(common >= np.ceil(threshold * union - 1e-9))
    return i, j, common[i, j] / union[i, j]


@dataclass
class Block:
    """Members of a node: their sets, nodes and levels."""

    keys: list[bytes]
    weight: np.ndarray
    was: np.ndarray
    now: np.ndarray
    base: np.ndarray
    deep: np.ndarray
    sets: list[np.ndarray]

    def packed(self) -> bytes:
        """All of it in bytes; what many sets share is kept once."""
        values, index = np.unique(np.concatenate(self.sets), return_inverse=True)
        index = index.astype(np.uint16 if len(values) < 1 << 16 else np.uint32)
        rest = (self.keys, self.weight, self.was, self.now, np.ascontiguousarray(self.base.T), np.ascontiguousarray(self.deep.T), values, index, np.cumsum([len(s) for s in self.sets])[:-1])
        return zlib.compress(pickle.dumps(rest, protocol=5), 1)

    @staticmethod
    def unpacked(data: bytes) -> Block:
        keys, weight, was, now, base, deep, values, index, cuts = pickle.loads(zlib.decompress(data))
        return Block(keys, weight, was, now, base.T, deep.T, np.split(values[index], cuts))


FOUND = "key binary, links long, texts long, needed array<double>, to binary"
FOUND_SCHEMA = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("texts", pa.int64()), ("needed", pa.list_(pa.float64())), ("to", pa.binary())])


def links_of(a: Block, b: Block | None, tree: int, level: int, floor: int, forest: Forest, threshold: float) -> Iterator[tuple]:
    """Links inside a block, or between two, that are this node's to count.

    A pair is due at the lower of its members' levels, and is counted at the
    first tree whose node at that level both are in, unless both were in one at
    the level of an earlier round. Gives (key, links, texts, needed, to): counts
    of documents and of sets linked; for each depth from ``floor`` the sum of
    1 / (chance that a link of this similarity is found at that depth); and with
    ``to`` set an edge, so that each linked set is joined. No pair is a row.
    """
    both = [a] if b is None else [a, b]
    keys, sets = [k for x in both for k in x.keys], [s for x in both for s in x.sets]
    weight, was, now = (np.concatenate([getattr(x, f) for x in both]) for f in ("weight", "was", "now"))
    base, deep = (np.concatenate([getattr(x, f) for x in both]) for f in ("base", "deep"))
    first, depths = len(a.keys), np.arange(floor, forest.depth + 1)
    links, texts, root = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), np.arange(len(sets))
    needed = np.zeros((len(depths), len(sets)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def shared(x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
        """For each pair and tree, whether both are in one node at a depth."""
        same = base[x] == base[y]
        if depth > floor:
            at = slice((depth - floor - 1) * forest.trees, (depth - floor) * forest.trees)
            same &= deep[x, at] == deep[y, at]
        return same

    i, j, s = similar(sets, first, threshold)
    keep = (i < j) if b is None else (j >= first)
    keep &= np.minimum(now[i], now[j]) == level
    i, j, s = i[keep], j[keep], s[keep]
    for low in range(0, len(i), 1 << 16):
        x, y, z = (v[low : low + (1 << 16)] for v in (i, j, s))
        own = shared(x, y, level).argmax(1) == tree
        before = np.minimum(was[x], was[y])
        for depth in range(level + 1, forest.depth + 1):
            if (late := own & (before == depth)).any():
                own[late] &= ~shared(x[late], y[late], depth).any(1)
        own &= before > level
        x, y, z = x[own], y[own], z[own]
        odds = 1 / (1 - (1 - z[None, :].astype(np.float64) ** depths[:, None]) ** forest.trees)
        for p, q in ((x, y), (y, x)):
            links += np.bincount(p, weight[q], len(sets)).astype(np.int64)
            texts += np.bincount(p, minlength=len(sets))
            for d in range(len(depths)):
                needed[d] += np.bincount(p, odds[d], len(sets))
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            p, q = top(p), top(q)
            if p != q:
                root[max(p, q)] = min(p, q)
    for x in np.flatnonzero(texts).tolist():
        r = top(x)
        yield keys[x], int(links[x]), int(texts[x]), needed[:, x].tolist(), keys[r] if r != x else None


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    b = pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
    rows.clear()
    return b


#: What tells a node from others.
NODE = ("level", "tree", "node", "below")


def verify_blocks(members: DataFrame, floor: int, forest: Forest, threshold: float) -> DataFrame:
    """Links inside each block of a node; where a node has several blocks, also
    a row (the node, block, blocks, packed) with the block in one piece.
    ``members`` is sorted by node and block."""
    schema = pa.schema([*FOUND_SCHEMA, ("level", pa.int32()), ("tree", pa.int32()), ("node", pa.int64()), ("below", pa.int32()), ("block", pa.int32()), ("blocks", pa.int32()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[bytes, tuple] = {}
        now, out, held = None, [], 0

        def flush() -> None:
            nonlocal held
            level, tree, node, below, number, of = now
            r = [rows[k] for k in sorted(rows)]
            block = Block(sorted(rows), *(np.array([x[i] for x in r]) for i in range(3)), np.stack([x[3] for x in r]), np.stack([x[4] for x in r]), [x[5] for x in r])
            rows.clear()
            if len(r) > 1 and (block.now == level).any():
                out.extend((*x, None, None, None, None, None, None, None) for x in links_of(block, None, tree, level, floor, forest, threshold))
            if of > 1:
                data = block.packed()
                held += len(data)
                out.append((None, None, None, None, None, level, tree, node, below, number, of, data))

        for b in batches:
            tasks = list(zip(*(b.column(c).to_pylist() for c in range(6)), strict=True))
            key, weight, was, level = (b.column(c).to_pylist() for c in range(6, 10))
            base, deep = (np.asarray(b.column(c).flatten()).reshape(len(tasks), -1) for c in (10, 11))
            for k, task in enumerate(tasks):
                if task != now and rows:
                    flush()
                now = task
                if key[k] not in rows:
                    rows[key[k]] = (weight[k], was[k], level[k], base[k].copy(), deep[k].copy(), np.frombuffer(b.column(12)[k].as_py(), U))
                if len(out) > 1000 or held > 8 << 20:
                    held = 0
                    yield batch_of(out, schema)
        if rows:
            flush()
        yield batch_of(out, schema)

    columns = [*NODE, "block", "blocks", "key", "weight", "was", "now", "base", "deep", "set"]
    return members.select(*columns).mapInArrow(run, f"{FOUND}, level int, tree int, node long, below int, block int, blocks int, packed binary")


def verify_pairs(blocks: DataFrame, floor: int, forest: Forest, threshold: float) -> DataFrame:
    """Links between the two blocks of each task (node, lo, hi); ``blocks`` is sorted by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, out = None, None, []
        for b in batches:
            for k, task in enumerate(zip(*(b.column(c).to_pylist() for c in range(6)), strict=True)):
                block = Block.unpacked(b.column(6)[k].as_py())
                if task != now:
                    now, first = task, block
                    continue
                if (first.now == task[0]).any() or (block.now == task[0]).any():
                    out.extend(links_of(first, block, task[1], task[0], floor, forest, threshold))
                first = None
                if len(out) > 1000:
                    yield batch_of(out, FOUND_SCHEMA)
        yield batch_of(out, FOUND_SCHEMA)

    return blocks.select(*NODE, "lo", "hi", "packed").mapInArrow(run, FOUND)


def nodes(members: DataFrame, levels: list[int], floor: int, trees: int) -> DataFrame:
    """The columns of ``members`` and a row for each node of its sets at ``levels``."""
    own = [c for c in members.columns if c not in ("base", "deep")]
    spots = members.select(*own, "deep", F.posexplode("base").alias("tree", "node"))
    spots = spots.select(*own, "deep", "tree", "node", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    below = F.when(F.col("level") == floor, F.lit(0)).otherwise(F.get(F.col("deep"), (F.col("level") - floor - 1) * trees + F.col("tree")))
    return spots.select(*own, "level", "tree", "node", below.alias("below"))


def search(members: DataFrame, sets: DataFrame, levels: list[int], floor: int, forest: Forest, threshold: float) -> list[DataFrame]:
    """A round: the links due at nodes of members whose level was lowered to one of ``levels``; stored tables as FOUND."""
    spots = nodes(members.select("key", "bytes", "weight", "was", "now", "base", "deep"), levels, floor, forest.trees)
    if levels != [forest.depth]:  # at first all nodes are due
        wanted = nodes(members.filter("now < was").select("now", "base", "deep"), levels, floor, forest.trees).filter("level = now").select(*NODE).distinct()
        spots = spots.join(wanted, list(NODE), "left_semi")
    large = spots.groupBy(*NODE).agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("size"), F.expr("bit_xor(xxhash64(key))").alias("who"), F.expr("bit_xor(xxhash64(key, 1))").alias("who2")).filter("m > 1")
    # Nodes of one depth with the same members are one node, that of the first tree.
    large = large.groupBy("level", "m", "size", "who", "who2").agg(F.min(F.struct("tree", "node", "below")).alias("b"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int")
    dealt = spots.drop("bytes").join(large.select("level", "b.*", blocks.alias("blocks")), list(NODE)).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets, "key").repartition(*NODE, "block").sortWithinPartitions(*NODE, "block")
    inside = stored(verify_blocks(dealt, floor, forest, threshold), "links")
    packed = inside.filter("packed is not null")
    if packed.isEmpty():
        return [inside]
    other = F.explode(F.expr("filter(sequence(0, blocks - 1), o -> o <> block)")).alias("other")
    # Block i meets every block j: the task (i, j), i < j, gets both.
    tasks = packed.select(*NODE, "block", other, "packed").select(*NODE, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "packed")
    tasks = tasks.repartition(*NODE, "lo", "hi").sortWithinPartitions(*NODE, "lo", "hi")
    return [inside, stored(verify_pairs(tasks, floor, forest, threshold), "links-between")]


def counted(found: list[DataFrame], depths: int) -> DataFrame:
    """(key, links, texts, need0, need1, ...) sums over the rounds so far."""
    rows = None
    for f in found:
        one = f.filter("key is not null").select("key", "links", "texts", "needed")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("key").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"), *(F.sum(F.col("needed")[d]).alias(f"need{d}") for d in range(depths)))


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(v, class_key), a stored table: the smallest node that each node of (a, b) is joined to.

    Labels fall along edges and then to their own labels' labels, so long
    chains shrink by half; each round is written to the shared folder.
    """
    both = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("c")).select("n", F.least("n", "c").alias("c")), "labels")
    before = labels
    for _ in range(most):
        around = both.join(labels, both["v"] == labels["n"]).groupBy("u").agg(F.min("c").alias("m"))
        low = labels.join(around, labels["n"] == around["u"]).select("n", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("n").alias("k"), F.col("c").alias("next"))
        new = stored(low.join(jump, low["c"] == jump["k"]).select(F.col("n").alias("v"), "old", F.least("c", "next").alias("class_key")), "labels")
        discard(before)
        before, labels = new, new.select(F.col("v").alias("n"), F.col("class_key").alias("c"))
        if new.filter("class_key < old").isEmpty():
            discard(both)
            return new
    raise RuntimeError(f"components did not settle in {most} rounds")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, target: float = 0.9995, forest: Forest | None = None) -> DataFrame:
    """Near-duplicate classes and numbers of links of all documents.

    Two documents are linked if the Jaccard similarity of their sets of n-word
    shingles is at least ``threshold``; a class is what links join. Documents
    of equal sets are one member of the join.

    Signatures stand in a forest of prefix tries. Members are first matched by
    whole signatures, and what is found is verified exactly. Then each member
    shortens its matched prefix until its recall reaches ``target``: its links
    found, and one more at the threshold that may exist, each count as found by
    the chance with which that prefix finds a pair of their similarity. A member
    of many close copies stops at long prefixes; one without links goes on to
    the length at which any pair above the threshold is found with the target
    recall. Rounds end when no member has to shorten further.

    A node's members are dealt into blocks. A member is sent once for each of
    its nodes, as hashes; blocks are then packed, and pairs of blocks meet, so
    no task gets a whole large node. Tasks return counts and a spanning forest,
    never pairs.

    Returns doc_id, class_id (smallest doc_id of the class), n_links (other
    documents linked, equal sets too) and n_texts (linked members of the join
    with another set). Documents without words, null and empty ones too, are
    classes of their own without links. One to n - 1 words are one shingle.
    Null ids are classes of their own (class_id null); rows that repeat an id
    and a text are counted. An empty table gives no rows; other columns are
    ignored. Ids must be integers (else TypeError).
    """
    integral(docs, id_col)
    forest = forest or Forest()
    floor = forest.length(threshold, target)
    signed = stored(signatures(docs, id_col, text_col, n, forest, floor), "signatures")
    members = signed.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rid"), F.count(F.lit(1)).alias("weight"), F.max("bytes").alias("bytes"), F.first("base").alias("base"), F.first("deep").alias("deep"), F.expr(f"bit_or(shiftleft(1L, {SALT}))").alias("used"))
    members = stored(members, "members")
    # Members alone in all their nodes at the shortest prefix have no link.
    lowest = nodes(members.select("key", "base", "deep"), [floor], floor, forest.trees)
    shared = lowest.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    alive = stored(lowest.join(shared, ["tree", "node"], "left_semi").select("key").distinct(), "alive")
    left = F.lit(forest.depth + 1).cast("int").alias("was"), F.lit(forest.depth).cast("int").alias("now")
    matched = stored(members.join(alive, "key").select("key", "rid", "weight", "bytes", "base", "deep", *left), "matched")
    whole = docs.select(F.col(id_col).cast("bigint").alias("rid"), F.col(text_col).alias("t"))
    sets = stored(shingle_sets(whole.join(matched.select("key", "rid", "base", "deep").hint("shuffle_hash"), "rid"), n), "sets")
    depths = list(range(floor, forest.depth + 1))
    found, levels = [], [forest.depth]
    while levels:
        found += search(matched, sets, levels, floor, forest, threshold)
        lowered = F.lit(floor)
        # The second round goes to the length that the links found so far ask for; a member that this does not satisfy goes on to the shortest.
        for d, x in enumerate(depths):
            reached = (F.coalesce("texts", F.lit(0)) + forest.recall(threshold, x)) / (F.coalesce(f"need{d}", F.lit(0.0)) + 1) >= target
            lowered = F.when(reached if levels == [forest.depth] else reached & (F.col("now") == x), F.lit(x)).otherwise(lowered)
        after = matched.join(counted(found, len(depths)), "key", "left").select("key", "rid", "weight", "bytes", "base", "deep", F.col("now").alias("was"), F.least("now", lowered).cast("int").alias("now"))
        after = stored(after, "matched")
        discard(matched)
        matched = after
        levels = sorted(r[0] for r in matched.filter("now < was").select("now").distinct().collect())  # at most ``depth`` values
    counts = counted(found, 0)
    edges = None
    for f in found:
        one = f.filter("to is not null").select(F.col("key").alias("a"), F.col("to").alias("b"))
        edges = one if edges is None else edges.unionByName(one)
    classes = components(edges)
    smallest = classes.join(members.select("key", "rid"), F.col("v") == F.col("key")).groupBy("class_key").agg(F.min("rid").alias("class_id"))
    # A class may hold a third of all texts, so its name goes to its members by salts.
    dealt = classes.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    named = dealt.join(smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["class_key", "salt"]).select(F.col("v").alias("key"), "class_id")
    labels = members.select("key", "rid", "weight", "used").join(counts, "key", "left").join(named, "key", "left")
    # Labels go back by key and salt, once for each salt in use, so no task gets all copies of a text.
    salt = F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright(used, s) & 1L) = 1L)")).alias("salt")
    labels = stored(labels.select("key", salt, F.coalesce("class_id", "rid").alias("class_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts")), "classes")
    discard(members, alive, matched, sets, classes, *found)
    lone = F.col("doc_id").isNull() | F.col("key").isNull()
    rows = signed.select("doc_id", F.when(~lone, F.col("key")).alias("key"), F.expr(SALT).alias("salt"))
    paired = rows.filter("key is not null").join(labels, ["key", "salt"]).select("doc_id", "class_id", "n_links", "n_texts")
    zero = F.lit(0).cast("bigint")
    return paired.unionByName(rows.filter("key is null").select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_texts")))
