"""Places of judged documents, and the first documents, counted where documents lie: no score of another pair leaves its task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators import tallies
from lexispark.operators.index import BROADCAST_ROWS

#: Documents that are scored at once.
DOCUMENTS = 2048
#: Pairs of a document and a topic that are in memory at once.
PAIRS = 2_000_000
#: Judged pairs times settings of one pass; more settings take more passes.
COUNTERS = 2_000_000

#: A function from a batch of documents, and the pairs wanted (null for all), to (row, topic, score): pairs in the order of topics, and the scores of all under a setting.
Read = Callable[[pa.RecordBatch, "np.ndarray | None"], tuple[np.ndarray, np.ndarray, Callable[[int], np.ndarray]]]


def weighted(plan: tallies.Asked, settings: Sequence[tuple[str, float, float]]) -> Read:
    """The scores of ``scoring.score`` over arrays of ``tallies.tallied`` for one field; a setting is (model, k1, b), and cosine takes a table with norms."""
    hits, topics, n, df, k3 = tallies.triples(plan), len(plan.qids), plan.docs[0], np.maximum(plan.df, 1), 8.0
    inverse = {
        "tf": np.ones(len(df)), "tf_idf": np.log2(n / df + 1), "lemur_tf_idf": np.log2(n / df) ** 2, "bm25_engine": np.log2((n - df + 0.5) / (df + 0.5)),
        "bm25": np.log1p((n - df + 0.5) / (df + 0.5)), "cosine": np.log((n + 1) / (df + 1)) + 1,
    }
    per_term = np.repeat(np.arange(len(plan.start) - 1), np.diff(plan.start))
    qnorm = np.sqrt(np.bincount(plan.of, np.where(plan.df[per_term] > 0, ((1 + np.log(plan.qtf)) * inverse["cosine"][per_term]) ** 2, 0.0), topics))

    def read(batch: pa.RecordBatch, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, Callable[[int], np.ndarray]]:
        length, norm = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("lens", "norms"))
        row, topic, _, code, tf, qtf = hits(batch)
        if only is not None:
            mine = np.isin(row * topics + topic, only)
            row, topic, code, tf, qtf = (v[mine] for v in (row, topic, code, tf, qtf))
        order = np.lexsort((row, topic))
        row, topic, code, tf, qtf = (v[order] for v in (row, topic, code, tf, qtf))
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (topic[1:] != topic[:-1])])) if len(row) else np.zeros(0, int)
        size, parts = length / plan.avg[0], {}

        def part(model: str) -> np.ndarray:
            """What a term adds, but for k1 and b."""
            if model not in parts:
                w = inverse[model][code]
                if model in ("tf_idf", "lemur_tf_idf"):
                    w = w * qtf
                elif model == "bm25_engine":
                    w = w * (k3 + 1) * qtf / (k3 + qtf)
                elif model == "cosine":
                    w = (1 + np.log(tf)) * w * (1 + np.log(qtf)) * w
                parts[model] = w if model == "cosine" else w * tf
            return parts[model]

        def score(g: int) -> np.ndarray:
            model, k1, b = settings[g]
            w = part(model)
            if model not in ("tf", "cosine"):
                w = w / (tf + (k1 * (1 - b + b * size))[row])
            total = np.add.reduceat(w, first) if len(first) else np.zeros(0)
            if model == "cosine":
                return total / (norm[row[first]] * qnorm[topic[first]])
            return total * (k1 + 1) if model in ("bm25", "bm25_engine") else total * k1 if model != "tf" else total

        return row[first], topic[first], score

    return read


def judged_pairs(plan: tallies.Asked, table: DataFrame, qrels: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """(topics by number, documents) of the relevant pairs, in the order of topics; None if they are not few or documents' ids are no numbers."""
    if table.schema["docid"].dataType.simpleString() not in ("bigint", "int"):
        return None
    pairs = qrels.filter("label > 0 and docid is not null").select("qid", "docid").limit(BROADCAST_ROWS + 1).collect()
    if len(pairs) > BROADCAST_ROWS:
        return None
    number = {q: i for i, q in enumerate(plan.qids.to_pylist())}
    pairs = sorted({(number[q], d) for q, d in pairs if q in number})
    return np.array([t for t, _ in pairs], np.int64), np.array([d for _, d in pairs], np.int64)


def of_judged(table: DataFrame, plan: tallies.Asked, topics: DataFrame, pairs: tuple[np.ndarray, np.ndarray], read: Read, settings: int, depth: int) -> DataFrame:
    """(g, qid, docid, rank): where the judged pairs stand among all matches of their topic, ordered as by ``ranking.rank``, for each setting, down to ``depth``.

    A pair's place is one more than the number of documents before it. A task has
    the judged pairs' scores, which were taken once, counts how many of its documents
    are before each, and passes on only these counts, which are added up. A pair that
    does not match under a setting has a score of minus infinity, as ``read`` may give it.
    """
    topic, docid = pairs
    count, many, session = len(topic), len(plan.qids), table.sparkSession
    kind = dict(table.dtypes)["docid"]
    asked, low = np.unique(topic, return_index=True)
    high = np.append(low, count)[1:]
    at_once = max(1, min(DOCUMENTS, PAIRS // max(1, len(asked))))
    qids, out = plan.qids, None
    by_doc = np.argsort(docid, kind="stable")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                yield batch.slice(i, at_once)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The judged pairs' scores under every setting, where their documents lie."""
        for b in cut(batches):
            doc = b.column("docid").to_numpy()
            start, end = (np.searchsorted(docid[by_doc], doc, side) for side in ("left", "right"))
            n = end - start
            mine = by_doc[np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            row, t, score = read(b, np.unique(np.repeat(np.arange(len(doc)), n) * many + topic[mine]))
            values = np.stack([score(g) for g in range(settings)], 1).ravel()
            ends = pa.array(np.arange(len(row) + 1, dtype=np.int32) * settings)
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(doc[row].astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(values))], names=["topic", "docid", "scores"])

    judged = table.join(F.broadcast(session.createDataFrame([(int(d),) for d in np.unique(docid)], f"docid {kind}")), "docid", "left_semi")
    known = judged.mapInArrow(own, "topic bigint, docid bigint, scores array<double>").toArrow()
    scores = {(t, d): i for i, (t, d) in enumerate(zip(known.column("topic").to_pylist(), known.column("docid").to_pylist(), strict=True))}
    at = np.array([scores.get(p, -1) for p in zip(topic.tolist(), docid.tolist(), strict=True)], np.int64)
    found = np.concatenate([np.zeros(0), *(c.flatten().to_numpy() for c in known.column("scores").chunks)]).reshape(-1, settings)
    found = np.where((at >= 0)[:, None], found[at], -np.inf) if len(found) else np.full((count, settings), -np.inf)

    def marks(value: np.ndarray) -> list:
        """For a setting's values of the judged pairs, by topic: those that match, in order, their values, and for equal values what their ids add."""
        mine = []
        for a, e in zip(low, high, strict=True):
            j = np.flatnonzero(np.isfinite(value[a:e])) + a
            o = np.lexsort((docid[j], value[j]))
            j, v = j[o], value[j[o]]
            ranked = np.unique(docid[j])
            tie = np.searchsorted(v, v) * (len(j) + 1) + np.searchsorted(ranked, docid[j])
            mine.append((j, v, ranked, tie))
        return mine

    for start in range(0, settings, max(1, COUNTERS // max(1, count))):
        part = range(start, min(settings, start + max(1, COUNTERS // max(1, count))))
        values = -np.round(found[:, part.start : part.stop].T, 9)

        def run(batches: Iterator[pa.RecordBatch], part: range = part, values: np.ndarray = values) -> Iterator[pa.RecordBatch]:
            each, before = [marks(v) for v in values], np.zeros((len(part), count), np.int64)
            for b in cut(batches):
                row, t, score = read(b, None)
                doc = b.column("docid").to_numpy()[row]
                ends = np.searchsorted(t, asked), np.searchsorted(t, asked, "right")
                for g, mine in zip(part, each, strict=True):
                    value = -np.round(score(g), 9)
                    for a, e, (j, v, ranked, tie) in zip(*ends, mine, strict=True):
                        if a == e or not len(j):
                            continue
                        x = value[a:e]
                        near = x <= v[-1]  # others are after all judged ones
                        x, d = x[near], doc[a:e][near]
                        at = np.searchsorted(v, x)
                        same = np.flatnonzero(v[at] == x)
                        # Of equal scores the lower id is first.
                        at[same] = np.searchsorted(tie, at[same] * (len(j) + 1) + np.searchsorted(ranked, d[same], "right") - 1, "right")
                        before[g - part.start, j] += np.cumsum(np.bincount(at, minlength=len(j) + 1))[:-1]
            # A pair without a match has no place.
            before[~np.isfinite(values)] = depth
            yield pa.RecordBatch.from_arrays([pa.array(np.array(part, np.int32)), pa.array(list(before), pa.list_(pa.int64()))], names=["g", "before"])

        def added(group: pa.Table) -> pa.Table:
            total = 1 + sum(np.array(v.values) for v in group.column("before"))
            j = np.flatnonzero(total <= depth)
            return pa.table({"g": pa.repeat(group.column("g")[0], len(j)), "qid": qids.take(pa.array(topic[j])), "docid": pa.array(docid[j]).cast(pa.int64() if kind == "bigint" else pa.int32()), "rank": pa.array(total[j])})

        kinds = f"qid {topics.schema['qid'].dataType.simpleString()}, docid {kind}"
        one = table.mapInArrow(run, "g int, before array<bigint>").groupBy("g").applyInArrow(added, f"g int, {kinds}, rank bigint")
        out = one if out is None else out.unionByName(one)
    return out


def judged(index, topics: DataFrame, qrels: DataFrame, settings: Sequence[tuple[str, float, float]], depth: int, known: tuple[DataFrame, tallies.Asked] | None = None) -> DataFrame | None:
    """(g, qid, docid, rank) of the relevant documents in the first ``depth`` of each topic under each setting (model, k1, b), numbered
    from 0. None where counts are not in one row (``known`` has them, if they were taken before), or judgements are many."""
    found = known or tallies.tallied(index, topics, index.fields, any(m == "cosine" for m, *_ in settings))
    pairs = None if found is None else judged_pairs(found[1], found[0], qrels)
    if pairs is None:
        return None
    plan = tallies.only(found[1], np.unique(pairs[0]))  # topics without a judged pair need no scores
    return of_judged(found[0], plan, topics, pairs, weighted(plan, settings), len(settings), depth)


def first(scores: DataFrame, k: int) -> DataFrame:
    """The rows (qid, docid, score) that ``ranking.rank`` may find in its first k: of each task's rows the first k of every topic. Ids are whole numbers."""
    scores = scores.select("qid", "docid", "score")
    kind = {"bigint": np.int64, "int": np.int32}[dict(scores.dtypes)["docid"]]

    def least(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        q, d, s = pc.rank(t.column("qid"), tiebreaker="dense").to_numpy().astype(np.int64), pc.fill_null(t.column("docid"), np.iinfo(kind).min).to_numpy(), np.round(t.column("score").to_numpy(), 9)
        order = np.lexsort((d, -s, q))
        q = q[order]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        keep = order[np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < k]
        return t.take(pa.array(keep)).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows, most = [], 0, 1 << 18
        for b in batches:
            if b.num_rows:
                kept, rows = [*kept, b], rows + b.num_rows
            if rows > most:
                kept = [least(kept)]
                rows, most = kept[0].num_rows, max(most, 2 * kept[0].num_rows)
        if rows:
            yield least(kept)

    return scores.mapInArrow(run, scores.schema)


def scores(table: DataFrame, plan: tallies.Asked, topics: DataFrame, setting: tuple[str, float, float]) -> DataFrame:
    """(qid, docid, score) of every match under one setting, put together in tasks."""
    read, qids = weighted(plan, [setting]), plan.qids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, DOCUMENTS):
                b = batch.slice(i, DOCUMENTS)
                row, topic, score = read(b, None)
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(topic)), b.column("docid").take(pa.array(row)), pa.array(score(0))], names=["qid", "docid", "score"])

    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c, d in (("qid", topics), ("docid", table)))
    return table.mapInArrow(run, f"{kinds}, score double")
