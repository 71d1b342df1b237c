"""Indexes of many preprocessing variants in one table, and their measures in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.porter import stem
from lexispark.functions.text import FIELD_SETS, Analyzer, alnum
from lexispark.operators import evaluation, index, places, ranking, reports
from lexispark.operators.index import BROADCAST_ROWS, small
from lexispark.operators.tallies import DEALT, Asked, asked, words_of
from lexispark.operators.tallies import lists as listed
from lexispark.operators.scoring import term_weight
from lexispark.sources.store import stored

STEMMERS = ("none", "weak", "porter")
#: The most frequent words, which are looked up by broadcast.
FREQUENT = 50_000
#: A variant is a field set, a stemmer and a stop list.
VARIANT = ("fields", "stemmer", "stop")


def stems_of(terms: DataFrame, stemmers: Sequence[str] = STEMMERS) -> DataFrame:
    """(stemmer, term, stem) for the distinct words of ``terms``; each is stemmed once by each stemmer."""
    for s in stemmers:
        terms = terms.withColumn(f"by_{s}", F.col("term")) if s == "none" else stem(terms, out=f"by_{s}", stemmer=s)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("stemmer"), F.col(f"by_{s}").alias("stem")) for s in stemmers)))
    return terms.select("term", each.alias("x")).select("x.stemmer", "term", "x.stem")


def kept_by(term: Column, stops: Mapping[str, Sequence[str]]) -> Column:
    """The names of the stop lists that do not have the word."""
    names = (F.when(~term.isin(*words) if words else F.lit(True), F.lit(name)) for name, words in stops.items())
    return F.filter(F.array(*names), lambda n: n.isNotNull())


def matches(docs: DataFrame, topics: DataFrame, stops: Mapping[str, Sequence[str]], stemmers: Sequence[str] = STEMMERS, field_sets: Mapping[str, Sequence[str]] = FIELD_SETS) -> DataFrame:
    """(fields, stemmer, stop, qid, docid, term, qtf, tf, df, len, n, avg): what each variant's index has for the topics.

    The texts are read and counted once, before stop words and stems, as (field,
    docid, term, tf); those counts are stored. Only the words whose stem is one of
    a topic's become rows of variants: which words these are is found from the
    vocabulary, not from the postings. Lengths do not depend on stemmers, so they
    are one sum over the counts for each field set and stop list, side by side in
    one row of a document. Every variant has the same documents, empty ones too.
    """
    tf = stored(index.build(docs, Analyzer(stop=())).tf, "counts")
    asked = topics.select("qid", F.explode(alnum(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    stems = stored(stems_of(tf.select("term").union(asked.select("term")).distinct(), stemmers), "stems")
    terms = asked.select("qid", "term", "qtf", F.explode(kept_by(F.col("term"), stops)).alias("stop"))
    terms = terms.join(stems, "term").groupBy("stemmer", "stop", "qid", "stem").agg(F.sum("qtf").alias("qtf"))
    terms = stored(terms, "topic-terms")

    words = stems.join(small(terms.select("stemmer", "stem").distinct()), ["stemmer", "stem"], "left_semi")
    rows = tf.join(small(words), "term").withColumn("stop", F.explode(kept_by(F.col("term"), stops)))
    sets = [F.when(F.col("field").isin(*fields), F.lit(name)) for name, fields in field_sets.items()]
    rows = rows.withColumn("fields", F.explode(F.filter(F.array(*sets), lambda n: n.isNotNull())))
    found = stored(rows.groupBy(*VARIANT, "stem", "docid").agg(F.sum("tf").alias("tf")), "variants")
    df = found.groupBy(*VARIANT, "stem").agg(F.count(F.lit(1)).alias("df"))

    sizes = {(f, s): F.sum(F.when(F.col("field").isin(*fields) & (~F.col("term").isin(*words_) if words_ else F.lit(True)), F.col("tf")).otherwise(0)) for f, fields in field_sets.items() for s, words_ in stops.items()}
    counted = tf.groupBy("docid").agg(*(c.alias(f"{f}__{s}") for (f, s), c in sizes.items()))
    lengths = docs.select("docid").join(counted, "docid", "left").fillna(0)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("fields"), F.lit(s).alias("stop"), F.col(f"{f}__{s}").alias("len")) for f, s in sizes)))
    lengths = stored(lengths, "lengths")
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), *(F.greatest(F.avg(f"{f}__{s}"), F.lit(1e-12)).alias(f"{f}__{s}") for f, s in sizes))
    averages = totals.select("n", each.alias("x")).select("n", "x.fields", "x.stop", F.col("x.len").alias("avg"))  # a row for each field set and list

    terms = terms.join(df, ["stemmer", "stop", "stem"]).join(F.broadcast(averages), ["fields", "stop"])
    hits = found.join(small(terms), [*VARIANT, "stem"])
    of = F.filter(F.array(*(F.struct(F.lit(f).alias("f"), F.lit(s).alias("s"), F.col(f"{f}__{s}").alias("len")) for f, s in sizes)), lambda x: (x["f"] == F.col("fields")) & (x["s"] == F.col("stop")))
    return hits.join(lengths, "docid").select(*VARIANT, "qid", "docid", F.col("stem").alias("term"), "qtf", "tf", "df", of[0]["len"].alias("len"), "n", "avg")


def vocabulary(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(term): the words of the fields, each once for every batch of texts that has it."""
    none = pa.array([], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pc.unique(pa.concat_arrays([words_of(b.column(f), none)[2] for f in fields]))
            yield pa.RecordBatch.from_arrays([found.filter(pc.not_equal(found, ""))], names=["term"])

    return docs.select(*(Analyzer(stop=()).lowered(F.col(f)).alias(f) for f in fields)).mapInArrow(run, "term string")


def places_in_rows(docs: DataFrame, topics: DataFrame, qrels: DataFrame, stops: Mapping[str, Sequence[str]], stemmers: Sequence[str] = STEMMERS, field_sets: Mapping[str, Sequence[str]] = FIELD_SETS, depth: int = 1000, k1: float = 1.2, b: float = 0.75, k3: float = 8.0) -> DataFrame | None:
    """(fields, stemmer, stop, qid, docid, rank): the relevant documents among the first ``depth`` of each topic by BM25 over each variant.

    A document's row has its counts of the words that share a stem with a topic's, by field set; stems, stop lists and
    scores of all variants are put together from them where they lie, and only the judged documents' places are passed on.
    None if ids repeat, are null or no whole numbers, or if topics, their words or judgements are many.
    """
    sets, lists, fields = list(field_sets), list(stops), list(dict.fromkeys(f for fs in field_sets.values() for f in fs))
    kind, session = dict(docs.dtypes)["docid"], docs.sparkSession
    few = asked(topics, Analyzer(stop=()))
    if kind not in ("bigint", "int") or few is None or not docs.groupBy("docid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or docid is null").isEmpty():
        return None
    ids, terms = few
    own = session.createDataFrame([(t,) for t in sorted({t for _, t, _ in terms})], "term string")
    stems = stored(stems_of(vocabulary(docs, fields).union(own).distinct(), stemmers), "stems")
    stem_of_term = {(s, t): x for s, t, x in stems.join(F.broadcast(own), "term").select("stemmer", "term", "stem").collect()}  # the topics' words
    number = [{x: i for i, x in enumerate(sorted({x for (s, _), x in stem_of_term.items() if s == name}))} for name in stemmers]
    wanted = session.createDataFrame([(s, x) for s, n in zip(stemmers, number, strict=True) for x in n], "stemmer string, stem string")
    same = stems.join(F.broadcast(wanted), ["stemmer", "stem"], "left_semi").limit(BROADCAST_ROWS + 1).collect()
    if len(same) > BROADCAST_ROWS:
        return None
    words_ = sorted({r["term"] for r in same})
    place, size = {t: i for i, t in enumerate(words_)}, len(words_)
    stem_at = np.full((len(stemmers), size), -1)  # a word's stem, by stemmer; -1 if no topic has it
    for s, t, x in ((r["stemmer"], r["term"], r["stem"]) for r in same):
        i = list(stemmers).index(s)
        stem_at[i, place[t]] = number[i][x]
    known = pa.array(words_, pa.string())
    kept = np.array([[t not in set(stops[w]) for t in words_] for w in lists]).reshape(len(lists), size)
    out = [pa.array(list(stops[w]), pa.string()) for w in lists]
    within = np.array([[int(f in field_sets[x]) for x in sets] for f in fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.array([], pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = batch.slice(at, 4096)
                n, lens, keys, held = x.num_rows, np.zeros((x.num_rows, len(sets), len(lists)), np.int64), [], []
                for f, name in enumerate(fields):
                    row, word, found = words_of(x.column(name), none)
                    for w, stop in enumerate(out):
                        stays = ~pc.is_in(found, value_set=stop).to_numpy(zero_copy_only=False)
                        lens[:, :, w] += np.bincount(row[stays[word]], minlength=n)[:, None] * within[f]
                    p = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy(zero_copy_only=False)[word]
                    keys.append((row * max(1, size) + p)[p >= 0])
                    held.append(np.full(len(keys[-1]), f))
                key, back = np.unique(np.concatenate(keys), return_inverse=True)
                tf = np.bincount(back * len(fields) + np.concatenate(held), minlength=len(key) * len(fields)).reshape(-1, len(fields)) @ within
                row, numbers = key // max(1, size), lambda v: pa.array(v.astype(np.int32))
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * (len(sets) * len(lists)))
                columns = [x.column("docid"), pa.ListArray.from_arrays(ends, numbers(lens.ravel())), listed(row, numbers(key % max(1, size)), n), *(listed(row, numbers(v), n) for v in tf.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["docid", "lens", "codes", *(f"n_{i}" for i in range(len(sets)))])

    schema = f"docid {kind}, lens array<int>, codes array<int>, " + ", ".join(f"n_{i} array<int>" for i in range(len(sets)))
    table = stored(docs.select("docid", *(Analyzer(stop=()).lowered(F.col(f)).alias(f) for f in fields)).mapInArrow(count, schema), "variants", "zstd")
    sums = table.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("lens")[i]).alias(f"l_{i}") for i in range(len(sets) * len(lists)))).first()
    n = sums["n"]
    avg = np.array([max((sums[f"l_{i}"] or 0) / max(n, 1), 1e-12) for i in range(len(sets) * len(lists))])
    tasks = max(2 * session.sparkContext.defaultParallelism, n // DEALT + 1)
    table = table.repartition(tasks, "docid")

    def grouped(batch: pa.RecordBatch, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, stem, tf): the stems of a batch's documents by a stemmer, ``tf`` by stop list and field set."""
        codes = batch.column("codes")
        row, code = np.repeat(np.arange(batch.num_rows), pc.list_value_length(codes).to_numpy(zero_copy_only=False)), codes.flatten().to_numpy(zero_copy_only=False)
        stem_ = stem_at[s][code]
        mine = np.flatnonzero(stem_ >= 0)
        key = row[mine] * max(1, len(number[s])) + stem_[mine]
        order = np.argsort(key, kind="stable")
        mine, key = mine[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        tfs = [batch.column(f"n_{i}").flatten().to_numpy(zero_copy_only=False)[mine].astype(np.int64) for i in range(len(sets))]
        tf = np.array([[np.add.reduceat(v * kept[w][code[mine]], first) if len(first) else np.zeros(0, np.int64) for v in tfs] for w in range(len(lists))])
        return key[first] // max(1, len(number[s])), key[first] % max(1, len(number[s])), tf

    order = [(s, w, f) for s in range(len(stemmers)) for w in range(len(lists)) for f in range(len(sets))]

    def documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(number[s]), np.int64) for s, *_ in order]
        for batch in batches:
            for s in range(len(stemmers)):
                _, stem_, tf = grouped(batch, s)
                for g, (of, w, f) in enumerate(order):
                    if of == s:
                        total[g] += np.bincount(stem_[tf[w, f] > 0], minlength=len(total[g]))
        for g, v in enumerate(total):
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(at.astype(np.int32)), pa.array(v[at])], names=["g", "stem", "df"])

    df = [np.zeros(len(number[s])) for s, *_ in order]
    for g, x, v in table.mapInArrow(documents_with, "g int, stem int, df bigint").groupBy("g", "stem").agg(F.sum("df").alias("df")).collect():  # the topics' stems
        df[g][x] = v
    inverse = [np.log2((n - v + 0.5) / (v + 0.5)) for v in df]
    length = np.zeros(0)
    asks = Asked(pa.array(ids), length, known, length, length, length, length, length, length)
    pairs = places.judged_pairs(asks, table, qrels)
    if pairs is None:
        return None
    judged_topics = np.unique(pairs[0])
    names, active = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(judged_topics.tolist())}
    postings = []
    for s, name in enumerate(stemmers):
        qtf: dict[tuple[int, int], np.ndarray] = {}
        for q, t, k in terms:
            if names[q] in active:
                at = number[s][stem_of_term[name, t]], active[names[q]]
                qtf[at] = qtf.get(at, 0) + np.array([k * (t not in stops[w]) for w in lists], float)
        by = sorted(qtf)
        start = np.searchsorted(np.array([x for x, _ in by]), np.arange(len(number[s]) + 1)) if by else np.zeros(len(number[s]) + 1, int)
        v = np.array([qtf[x] for x in by]).reshape(-1, len(lists)).T
        postings.append((start, np.array([t for _, t in by], int), (k3 + 1) * v / (k3 + v)))
    many = len(ids)

    def read(batch: pa.RecordBatch, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, Callable[[int], np.ndarray]]:
        rows = batch.num_rows
        lens = batch.column("lens").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)
        row, topic = np.tile(np.arange(rows), len(judged_topics)), np.repeat(judged_topics, rows)
        some = None if only is None else np.flatnonzero(np.isin(row * many + topic, only))
        held: dict = {}

        def hits(s: int, w: int) -> tuple:
            """A stemmer's stems of documents, and their hits that topics have under a stop list: kept for the settings that follow."""
            if s not in held:
                held.clear()
                r, x, tf = grouped(batch, s)
                start, of, q = postings[s]
                k = start[x + 1] - start[x]
                again = np.repeat(np.arange(len(x)), k)
                at = start[x[again]] + np.arange(len(again)) - np.repeat(np.cumsum(k) - k, k)
                held[s] = r, x, tf, again, at, of[at] * rows + r[again], q
            r, x, tf, again, at, key, q = held[s]
            if (s, w) not in held:
                for old in [o for o in held if isinstance(o, tuple)]:
                    del held[old]
                v = q[w][at]
                mine = np.flatnonzero(v > 0)
                held[s, w] = again[mine], key[mine], v[mine]
            return r, x, tf[w], *held[s, w]

        def score(g: int) -> np.ndarray:
            s, w, f = order[g]
            r, x, tf, again, key, v = hits(s, w)
            i, t = f * len(lists) + w, tf[f]
            weight = inverse[g][x] * ((k1 + 1) * t / ((k1 * (1 - b + b * lens[:, i] / avg[i]))[r] + t))
            if not (t > 0).all():
                mine = np.flatnonzero((t > 0)[again])
                again, key, v = again[mine], key[mine], v[mine]
            total = np.bincount(key, weight[again] * v, len(row))
            total[np.bincount(key, minlength=len(row)) == 0] = -np.inf
            return total if some is None else total[some]

        return (row, topic, score) if some is None else (row[some], topic[some], score)

    found = places.of_judged(table, asks, topics, pairs, read, len(order), depth)
    variants = session.createDataFrame([(g, sets[f], stemmers[s], lists[w]) for g, (s, w, f) in enumerate(order)], "g int, fields string, stemmer string, stop string")
    return found.join(F.broadcast(variants), "g").select(*VARIANT, "qid", "docid", "rank")


def measured(found: DataFrame, topics: DataFrame, qrels: DataFrame, variants: DataFrame, model: str = "bm25_engine", depth: int = 1000, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(fields, stemmer, stop, qid and each measure) of the run of each of ``variants`` over every topic, in one plan."""
    scores = found.groupBy(*VARIANT, "qid", "docid").agg(F.sum(term_weight(model, F.lit(k1), F.lit(b))).alias("score"))
    return judged_by(ranking.rank(scores.select(F.struct(*VARIANT, "qid").alias("qid"), "docid", "score"), depth), topics, qrels, variants)


def judged_by(run: DataFrame, topics: DataFrame, qrels: DataFrame, variants: DataFrame) -> DataFrame:
    """(fields, stemmer, stop, qid and each measure) of a run (qid, docid, rank) whose ``qid`` has variant and topic; documents that are not relevant may be left out."""
    both = F.struct(*VARIANT, "qid").alias("qid")
    # The variants are few, so topics and judgements are repeated for each.
    asked_ = topics.select("qid").crossJoin(F.broadcast(variants)).select(both)
    judged = qrels.crossJoin(F.broadcast(variants)).select(both, "docid", "label")
    return evaluation.measures(run, judged, asked_).select("qid.*", *(F.col(f"`{m}`") for m in evaluation.METRICS))


def grid(docs: DataFrame, topics: DataFrame, qrels: DataFrame, stops: Mapping[str, Sequence[str]], stemmers: Sequence[str] = STEMMERS, field_sets: Mapping[str, Sequence[str]] = FIELD_SETS, model: str = "bm25_engine", depth: int = 1000) -> DataFrame:
    """(name, fields, stemmer, stop, each measure, place): every variant by the means of its measures over topics, best average precision first."""
    names = [(f, s, w) for f in field_sets for s in stemmers for w in stops]
    variants = docs.sparkSession.createDataFrame(names, "fields string, stemmer string, stop string")
    found = places_in_rows(docs, topics, qrels, stops, stemmers, field_sets, depth) if model == "bm25_engine" else None
    if found is None:
        per = measured(matches(docs, topics, stops, stemmers, field_sets), topics, qrels, variants, model, depth)
    else:
        per = judged_by(found.select(F.struct(*VARIANT, "qid").alias("qid"), "docid", "rank"), topics, qrels, variants)
    means = per.groupBy(*VARIANT).agg(*(F.avg(F.col(f"`{m}`")).alias(m) for m in evaluation.METRICS))
    return reports.by_metric(means.withColumn("name", F.concat_ws("__", *VARIANT)), "AP")


def words(docs: DataFrame, stops: Mapping[str, Sequence[str]], field_sets: Mapping[str, Sequence[str]] = FIELD_SETS) -> DataFrame:
    """(docid, term, mask, n_0, n_1, ...), stored: a row for each word of a document, counted where it lies. ``n`` has its
    occurrences by field set; a bit of ``mask`` for each field set and stop list, in turn, tells whether that variant has the word."""
    fields = list(dict.fromkeys(f for fs in field_sets.values() for f in fs))
    within = np.array([[int(f in fs) for fs in field_sets.values()] for f in fields])
    lists = [pa.array(list(w), pa.string()) for w in stops.values()]
    counts = [f"n_{i}" for i in range(len(field_sets))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                found = [words_of(b.column(f), pa.array([], pa.string())) for f in fields]
                row, field = np.concatenate([r for r, *_ in found]), np.repeat(np.arange(len(fields)), [len(r) for r, *_ in found])
                terms = pa.concat_arrays([w.take(pa.array(i)) for _, i, w in found]).dictionary_encode()
                w = max(1, len(terms.dictionary))
                key, place = np.unique(row * w + terms.indices.to_numpy(zero_copy_only=False), return_inverse=True)
                n = np.bincount(place * len(fields) + field, minlength=len(key) * len(fields)).reshape(-1, len(fields)) @ within
                kept = np.stack([~pc.is_in(terms.dictionary, value_set=x).to_numpy(zero_copy_only=False) for x in lists], 1)[key % w]
                bits = ((n > 0)[:, :, None] & kept[:, None, :]).reshape(len(key), -1)
                mask = bits @ (1 << np.arange(bits.shape[1]))
                numbers = [pa.array(v.astype(np.int32)) for v in (mask, *n.T)]
                yield pa.RecordBatch.from_arrays([b.column("docid").take(pa.array(key // w)), terms.dictionary.take(pa.array(key % w)), *numbers], names=["docid", "term", "mask", *counts])

    plain = Analyzer(stop=())
    kinds = ", ".join([f"docid {dict(docs.dtypes)['docid']}, term string, mask int", *(f"{c} int" for c in counts)])
    out = docs.select("docid", *(plain.lowered(F.col(f)).alias(f) for f in fields)).mapInArrow(run, kinds)
    if not docs.groupBy("docid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():  # rows of one id are one document
        out = out.groupBy("docid", "term").agg(F.bit_or("mask").alias("mask"), *(F.sum(c).cast("int").alias(c) for c in counts))
    return stored(out, "words", "zstd")


def statistics(docs: DataFrame, stops: Mapping[str, Sequence[str]], field_sets: Mapping[str, Sequence[str]] = FIELD_SETS, stemmers: Sequence[str] = STEMMERS) -> DataFrame:
    """(fields, stemmer, stop, terms, postings, tokens) of every variant that has a term.

    A row of a document and word has a bit for each field set and stop list, so variants are no rows. Tokens do
    not depend on stemmers, and a stem of one word has that word's documents; only rows of words that share their
    stem are put together by document and stem.
    """
    pairs = [(f, s) for f in field_sets for s in stops]
    found, sets = words(docs, stops, field_sets), list(field_sets)
    has = lambda i, m="mask": F.shiftright(m, i).bitwiseAND(F.lit(1))
    sums = [F.sum(has(i)).alias(f"p_{i}") for i in range(len(pairs))] + [F.sum(has(i) * F.col(f"n_{sets.index(f)}")).alias(f"t_{i}") for i, (f, _) in enumerate(pairs)]
    by_term = stored(found.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.bit_or("mask").alias("mask"), *sums), "terms")
    out, ids = None, by_term.select("term", "df")
    ends = by_term.agg(*(F.sum(f"t_{i}").alias(f"t_{i}") for i in range(len(pairs))))  # one row
    parts = []
    for s in stemmers:
        if s == "none":
            parts.append(by_term.agg(*(F.sum(has(i)).alias(f"terms_{i}") for i in range(len(pairs))), *(F.sum(f"p_{i}").alias(f"p_{i}") for i in range(len(pairs)))).withColumn("stemmer", F.lit(s)))
            continue
        stems = stored(stem(by_term, stemmer=s), "stems")
        classes = stems.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.bit_or("mask").alias("mask"), *(F.sum(f"p_{i}").alias(f"p_{i}") for i in range(len(pairs))))
        classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
        alone = lambda i: F.sum(F.when(F.col("n") == 1, F.col(f"p_{i}")).otherwise(0)).alias(f"p_{i}")
        parts.append(classes.agg(*(F.sum(has(i)).alias(f"terms_{i}") for i in range(len(pairs))), *(alone(i) for i in range(len(pairs)))).withColumn("stemmer", F.lit(s)))
        shared = stems.select("term", "stem").join(classes.filter("n > 1").select("stem", F.col("id").alias(f"id_{s}")), "stem").select("term", f"id_{s}")
        ids = ids.join(shared, "term", "left")
    ids = stored(ids.filter(F.coalesce(*(F.col(c) for c in ids.columns if c.startswith("id_")), F.lit(None)).isNotNull()), "shared") if len(ids.columns) > 2 else None
    if ids is not None:
        # The most frequent words are looked up in the scan; only rows of others are sent to theirs.
        often = F.broadcast(stored(ids.orderBy(F.desc("df"), "term").limit(FREQUENT), "frequent").drop("df"))
        rare = ids.join(often.select("term"), "term", "left_anti").drop("df")
        rows, rest = found.select("docid", "term", "mask"), found.select("docid", "term", "mask").join(often.select("term"), "term", "left_anti")
        rows = rows.join(often, "term").unionByName(rest.join(small(rare), "term"))
        names = [c for c in ids.columns if c.startswith("id_")]
        each = F.explode(F.filter(F.array(*(F.struct(F.lit(c[3:]).alias("stemmer"), F.col(c).alias("id")) for c in names)), lambda x: x["id"].isNotNull()))
        merged = rows.select("docid", "mask", each.alias("x")).groupBy("docid", "x.stemmer", "x.id").agg(F.bit_or("mask").alias("mask"))
        parts.append(merged.groupBy("stemmer").agg(*(F.lit(0).cast("bigint").alias(f"terms_{i}") for i in range(len(pairs))), *(F.sum(has(i)).alias(f"p_{i}") for i in range(len(pairs)))))
    for p in parts:
        out = p if out is None else out.unionByName(p)
    out = out.groupBy("stemmer").agg(*(F.sum(f"{c}_{i}").alias(f"{c}_{i}") for c in ("terms", "p") for i in range(len(pairs)))).crossJoin(F.broadcast(ends))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("fields"), F.lit(s).alias("stop"), F.col(f"terms_{i}").alias("terms"), F.col(f"p_{i}").alias("postings"), F.col(f"t_{i}").alias("tokens")) for i, (f, s) in enumerate(pairs))))
    return out.select("stemmer", each.alias("x")).select("x.fields", "stemmer", "x.stop", "x.terms", "x.postings", "x.tokens").filter("terms > 0")
