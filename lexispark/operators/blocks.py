"""Postings in blocks of neighbouring documents, and the best documents by bounds on blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators import tallies
from lexispark.operators.index import Index, small
from lexispark.operators.ranking import rank
from lexispark.operators.scoring import topic_terms
from lexispark.sources.store import stored

#: Bits of a document's place in its block; a block spans 2 ** BITS ids, so a term has no more postings in it.
BITS = 12


def build(index: Index, k1: float = 1.2, b: float = 0.75, bits: int = BITS) -> DataFrame:
    """(term, block, n, first, last, places, weights, bound) of an index of one field.

    Block ``x`` has the documents from x * 2^bits on; ``places`` are their
    distances from there, ascending, in two bytes each, and ``weights`` the
    parts of BM25 that do not depend on the topic. ``bound`` is the largest of
    them. A term in every document is many rows, of which none is longer than
    a block, and a block is put together from what partial aggregates sent.
    """
    if not 1 <= bits <= 15:
        raise ValueError("a block's places must fit in two bytes")
    listed = tallies.listed(index)
    if listed is not None:
        return _built(listed, k1, b, bits)
    norm = k1 * (1 - b + b * F.col("len") / F.col("avg"))
    rows = index.tf.join(index.dl, "docid").crossJoin(F.broadcast(index.stats.select("avg")))  # one row
    one = F.struct((F.col("docid") - F.shiftleft("block", bits)).cast("smallint").alias("place"), ((k1 + 1) * F.col("tf") / (F.col("tf") + norm)).alias("weight"))
    rows = rows.withColumn("block", F.shiftright("docid", bits)).select("term", "block", one.alias("x"))
    found = rows.groupBy("term", "block").agg(F.sort_array(F.collect_list("x")).alias("x"), F.max("x.weight").alias("bound"))
    base = F.shiftleft("block", bits)
    return found.select("term", "block", F.size("x").alias("n"), (base + F.col("x")[0]["place"]).alias("first"), (base + F.element_at("x", -1)["place"]).alias("last"), F.col("x.place").alias("places"), F.col("x.weight").alias("weights"), "bound")


def _built(listed: DataFrame, k1: float, b: float, bits: int) -> DataFrame:
    """``build`` of documents with their terms: a block's documents are dealt to one task, as they are, and its postings are put together there."""
    avg = listed.agg(F.greatest(F.avg("len"), F.lit(1e-12))).first()[0]
    kind = dict(listed.dtypes)["docid"]

    def put(rows: pa.Table) -> pa.RecordBatch:
        block, docid, length = (rows.column(c).to_numpy() for c in ("block", "docid", "len"))
        terms, tfs = rows.column("terms").combine_chunks(), rows.column("tfs").combine_chunks()
        row = np.repeat(np.arange(len(docid)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        word, tf = terms.flatten().dictionary_encode(), tfs.flatten().to_numpy(zero_copy_only=False).astype(float)
        code = word.indices.to_numpy(zero_copy_only=False)
        weight = (k1 + 1) * tf / (tf + (k1 * (1 - b + b * length / avg))[row])
        order = np.lexsort((docid[row], code, block[row]))
        row, code, weight = row[order], code[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (block[row][1:] != block[row][:-1])]))
        ends = np.append(first, len(row)).astype(np.int32)
        place = (docid[row] - (block[row].astype(docid.dtype) << bits)).astype(np.int16)
        each = lambda v: pa.ListArray.from_arrays(pa.array(ends), pa.array(v))
        last = docid[row[ends[1:] - 1]]
        columns = [word.dictionary.take(pa.array(code[first])), pa.array(block[row[first]]), pa.array(np.diff(ends)), pa.array(docid[row[first]]), pa.array(last), each(place), each(weight), pa.array(np.maximum.reduceat(weight, first))]
        return pa.RecordBatch.from_arrays(columns, names=["term", "block", "n", "first", "last", "places", "weights", "bound"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []  # documents of blocks that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            block = batch.column("block").to_numpy()
            start = int(np.searchsorted(block, block[-1]))
            if start or block[0] != kept[0].column("block")[0].as_py():
                whole = pa.Table.from_batches([*kept[:-1], batch.slice(0, start)])
                kept = [batch.slice(start)]
                if whole.num_rows:
                    yield put(whole)
        if kept:
            yield put(pa.Table.from_batches(kept))

    dealt = listed.filter(F.size("terms") > 0).withColumn("block", F.shiftright("docid", bits))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "docid")
    return dealt.mapInArrow(run, f"term string, block {kind}, n int, first {kind}, last {kind}, places array<smallint>, weights array<double>, bound double")


def documents(blocks: DataFrame, *columns: str, bits: int = BITS) -> DataFrame:
    """(term, docid, weight) and the given columns: the postings of blocks."""
    each = F.explode(F.arrays_zip("places", "weights")).alias("x")
    return blocks.select("term", *columns, "block", each).select("term", *columns, (F.shiftleft("block", bits) + F.col("x.places")).alias("docid"), F.col("x.weights").alias("weight"))


def asked_terms(index: Index, topics: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(qid, term, df, idf) of the topics' terms that the collection has; few, and broadcast by those who use it if so."""
    if blocks is not None and index.rows is not None and index.rows.filter("docid is null").isEmpty():
        # Blocks have every posting, and texts are counted without being read.
        n = F.broadcast(index.rows.agg(F.count(F.lit(1)).alias("n")))
        asked = small(topic_terms(topics, index.analyzer))
        known = blocks.select("term", "n").join(small(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df")).join(asked, "term").crossJoin(n)
        return known.select("qid", "term", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    n = F.broadcast(index.stats.select("n"))
    known = index.df.join(small(topic_terms(topics, index.analyzer)), "term").crossJoin(n)
    return known.select("qid", "term", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def top(index: Index, blocks: DataFrame, topics: DataFrame, k: int = 10, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """((qid, docid, score, rank), (qid, blocks, skipped)): the first k by BM25, and the blocks of each topic's terms that need not be opened.

    First, for each topic, its rarest term that k documents have is opened, and
    these documents are scored in full, in their blocks alone. The k-th best of
    them is a score that the k-th best of all reaches too. Then only spans of
    documents are opened in which the bounds of all the topic's terms add up to
    that score; ties at it stay. What is skipped holds no document of the
    first k, so the rows are those of scoring every match.
    """
    terms = stored(asked_terms(index, topics, blocks), "terms")
    # Bounds alone, without places or weights: a row for each block of a topic's term.
    bounds = stored(blocks.select("term", "block", "n", "bound").join(small(terms), "term").select("qid", "term", "block", "idf", (F.col("bound") * F.col("idf")).alias("most")), "bounds")
    enough = terms.withColumn("few", F.col("df") < k)
    rarest = enough.groupBy("qid").agg(F.min(F.struct("few", "df", "term")).alias("x")).filter("not x.few").select("qid", "x.term")
    opened = documents(blocks.join(small(rarest), "term"), "qid", bits=bits).select("qid", "docid", F.shiftright("docid", bits).alias("block"))
    opened = stored(opened, "candidates")
    spans = opened.select("qid", "block").distinct()
    near = small(bounds.join(small(spans), ["qid", "block"], "left_semi").select("qid", "term", "block", "idf"))
    scores = documents(blocks.join(near, ["term", "block"]), "qid", "idf", bits=bits)
    scores = scores.join(opened.select("qid", "docid"), ["qid", "docid"], "left_semi").groupBy("qid", "docid").agg(F.sum(F.col("idf") * F.col("weight")).alias("score"))
    least = rank(scores, k).filter(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    most = bounds.groupBy("qid", "block").agg(F.sum("most").alias("most"), F.count(F.lit(1)).alias("lists"))
    # Scores are compared to nine places, so a bound may fall short by that much.
    kept = stored(most.join(small(least), "qid", "left").withColumn("open", F.col("most") >= F.coalesce("least", F.lit(0.0)) - 2e-9), "spans")
    skipped = kept.groupBy("qid").agg(F.sum("lists").alias("blocks"), F.sum(F.when(F.col("open"), 0).otherwise(F.col("lists"))).alias("skipped"))
    wanted = bounds.join(small(kept.filter("open").select("qid", "block")), ["qid", "block"], "left_semi").select("qid", "term", "block", "idf")
    found = documents(blocks.join(small(wanted), ["term", "block"]), "qid", "idf", bits=bits)
    return rank(found.groupBy("qid", "docid").agg(F.sum(F.col("idf") * F.col("weight")).alias("score")), k), skipped
