"""Twenty-two query-document features for each field."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators import tallies
from lexispark.operators.index import FIELDS, Index, bounded, small
from lexispark.operators.scoring import topic_sizes, topic_terms

#: Names and order of the features.
FEATURES = (
    "query_term_number", "query_term_ratio", "stream_length", "idf",
    "tf_sum", "tf_min", "tf_max", "tf_mean", "tf_variance",
    "normalized_tf_sum", "normalized_tf_min", "normalized_tf_max", "normalized_tf_mean", "normalized_tf_variance",
    "tfidf_sum", "tfidf_min", "tfidf_max", "tfidf_mean", "tfidf_variance",
    "boolean", "vector_space", "bm25",
)


#: Pairs at once where rows of like values are put together.
PAIRS = 1 << 17
#: Rows of a batch that goes back to Spark.
ROWS = 1 << 15


def features_by_field(index: Index, topics: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, qid, docid, the features), for pairs that match in the field; all fields in one pass.

    Moments run over all distinct terms of a topic, and a term that the
    document lacks counts 0; they follow in closed form from the sum, the sum
    of squares and the number of terms, so no zero is ever a row. Any other
    pair has its field's length as stream_length and 0 elsewhere.
    """
    some = lambda d: d.filter(F.col("field").isin(*fields))
    terms = topic_terms(topics, index.analyzer)
    stats = F.broadcast(some(index.stats).select("field", F.col("n").alias("docs"), "avg"))  # a row for each field
    idf = F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1
    known = some(index.df).join(small(terms), "term").join(stats, "field").select("field", "qid", "term", "df", "docs", "avg", idf.alias("term_idf"), ((1 + F.log("qtf")) * idf).alias("qw"))
    qnorms = known.groupBy("field", "qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    weight = (1 + F.log("tf")) * F.col("term_idf")
    norms = some(index.tf).join(some(index.df).join(stats, "field").select("field", "term", idf.alias("term_idf")), ["field", "term"]).groupBy("field", "docid").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    hit = some(index.tf).join(bounded(known, terms), ["field", "term"]).join(some(index.dl), ["field", "docid"])
    bm25 = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg")))
    tf = F.col("tf").cast("double")
    hit = hit.select("field", "qid", "docid", "len", "term_idf", tf.alias("x_tf"), (tf / F.greatest("len", F.lit(1))).alias("x_normalized_tf"), (tf * F.col("term_idf")).alias("x_tfidf"), bm25.alias("bm"), (weight * F.col("qw")).alias("product"))
    aggs = [F.count(F.lit(1)).alias("matched"), F.first("len").alias("stream_length"), F.sum("term_idf").alias("idf"), F.sum("bm").alias("bm25"), F.sum("product").alias("dot")]
    for x in ("tf", "normalized_tf", "tfidf"):
        c = F.col(f"x_{x}")
        aggs += [F.sum(c).alias(f"{x}_sum"), F.min(c).alias(f"{x}_low"), F.max(c).alias(f"{x}_max"), F.sum(c * c).alias(f"{x}_squares")]
    pairs = hit.groupBy("field", "qid", "docid").agg(*aggs).join(small(topic_sizes(topics, terms)), "qid").join(bounded(qnorms, terms), ["field", "qid"]).join(norms, ["field", "docid"])
    out = {"query_term_number": F.col("matched").cast("double"), "query_term_ratio": F.col("matched") / F.col("n"), "stream_length": F.col("stream_length").cast("double"), "idf": F.col("idf"), "boolean": F.lit(1.0), "vector_space": F.col("dot") / (F.col("norm") * F.col("qnorm")), "bm25": F.col("bm25")}
    for x in ("tf", "normalized_tf", "tfidf"):
        mean = F.col(f"{x}_sum") / F.col("n")
        out |= {f"{x}_sum": F.col(f"{x}_sum"), f"{x}_min": F.when(F.col("matched") < F.col("n"), 0.0).otherwise(F.col(f"{x}_low")), f"{x}_max": F.col(f"{x}_max"), f"{x}_mean": mean, f"{x}_variance": F.greatest(F.col(f"{x}_squares") / F.col("n") - mean * mean, F.lit(0.0))}
    return pairs.select("field", "qid", "docid", *(out[f].alias(f) for f in FEATURES))


def assembled(plan: tallies.Asked, names: tuple[str, ...] = FEATURES) -> Callable:
    """A function from a batch of ``tallies.tallied`` to (row, topic, features) of the pairs that match in any field: the sums of ``features_by_field`` over arrays."""
    hits, place, width, topics = tallies.triples(plan), {n: i for i, n in enumerate(names)}, len(names), len(plan.qids)
    docs, avg, size = plan.docs, plan.avg, max(1, len(plan.vocabulary))
    idf = np.log((np.repeat(docs, size) + 1) / (plan.df + 1)) + 1
    inverse = np.log1p((np.repeat(docs, size) - plan.df + 0.5) / (plan.df + 0.5))
    n = plan.sizes
    # The norm of a topic in a field: over its terms that the field has.
    per_term = np.repeat(np.arange(len(plan.start) - 1), np.diff(plan.start))
    qnorm = np.array([np.sqrt(np.bincount(plan.of, np.where(plan.df[f * size + per_term] > 0, ((1 + np.log(plan.qtf)) * idf[f * size + per_term]) ** 2, 0.0), topics)) for f in range(len(docs))])

    def run(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lens, norms = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) for c in ("lens", "norms"))
        row, topic, field, code, tf, qtf = hits(batch)
        key = row * topics + topic
        pairs = np.unique(key)
        x = np.zeros((len(pairs), len(docs) * width))
        x[:, place["stream_length"] :: width] = lens[pairs // topics]
        for f in range(len(docs)):
            mine = np.flatnonzero(field == f)
            if not len(mine):
                continue
            mine = mine[np.argsort(key[mine], kind="stable")]
            k = key[mine]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            r, q = k[first] // topics, k[first] % topics
            t, w = tf[mine], idf[code[mine]]
            length = lens[row[mine], f]
            total = lambda v: np.add.reduceat(v, first)  # noqa: B023, E731
            bm25 = inverse[code[mine]] * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * length / avg[f]))
            matched, terms = np.diff(np.append(first, len(mine))).astype(float), n[q]
            out = {"query_term_number": matched, "query_term_ratio": matched / terms, "idf": total(w), "boolean": np.ones(len(first)), "bm25": total(bm25)}
            out["vector_space"] = total((1 + np.log(t)) * w * (1 + np.log(qtf[mine])) * w) / (norms[r, f] * qnorm[f, q])
            for name, v in (("tf", t), ("normalized_tf", t / np.maximum(length, 1)), ("tfidf", t * w)):
                added = total(v)
                mean = added / terms
                out |= {f"{name}_sum": added, f"{name}_min": np.where(matched < terms, 0.0, np.minimum.reduceat(v, first)), f"{name}_max": np.maximum.reduceat(v, first), f"{name}_mean": mean, f"{name}_variance": np.maximum(total(v * v) / terms - mean * mean, 0.0)}
            at = np.searchsorted(pairs, k[first])
            for name, v in out.items():
                x[at, f * width + place[name]] = v
        return pairs // topics, pairs % topics, x

    return run


def slices(batches: Iterator[pa.RecordBatch], n: int | None = None) -> Iterator[pa.RecordBatch]:
    n = n or tallies.SLICE
    for b in batches:
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)


def in_rows(index: Index, topics: DataFrame, fields: tuple[str, ...], schema: str, columns: Callable, known: tuple[DataFrame, tallies.Asked] | None = None, once: bool = False) -> DataFrame | None:
    """(qid, docid and what ``columns`` makes of a batch's features) of the pairs that match in any field, none of
    which is shuffled or stored: they are put together where a document's counts lie (``known``, if they were taken before). None if those are not in one row.

    ``once``: the result is read once, so the counts are not stored, and rows of like idf and tf stand together, so files of them are smaller.
    """
    found = known or tallies.tallied(index, topics, fields, keep=not once)
    if found is None:
        return None
    table, plan = found
    pairs, qids, keys = assembled(plan), plan.qids, [(c, d.schema[c].dataType.simpleString()) for c, d in (("qid", topics), ("docid", table))]

    at_once = max(1, PAIRS // max(1, len(qids))) if once else None
    like = [FEATURES.index(f) for f in ("tf_sum", "idf")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at_once):
            row, topic, x = pairs(b)
            if once:
                order = np.lexsort((topic, *x[:, like].T))
                row, topic, x = row[order], topic[order], x[order]
            values = columns(x)
            del x
            out = pa.RecordBatch.from_arrays([qids.take(pa.array(topic)), b.column("docid").take(pa.array(row)), *values.values()], names=["qid", "docid", *values])
            for at in range(0, out.num_rows, ROWS):
                yield out.slice(at, ROWS)

    return table.mapInArrow(run, ", ".join([f"{c} {t}" for c, t in keys]) + ", " + schema)


def columns_of(names: Sequence[str], places: int | None = None) -> Callable:
    """A function from a batch's features to a column for each, rounded to ``places``, exact halves upward."""
    unit = 10.0 ** (places or 0)

    def run(x: np.ndarray) -> dict[str, pa.Array]:
        x = np.array(x.T, order="C")  # a copy, rounded in its place
        if places is not None:
            x += 1e-10
            x *= unit
            x += 0.5
            np.floor(x, out=x)
            x /= unit
        return {f: pa.array(v) for f, v in zip(names, x, strict=True)}

    return run


def field_features(index: Index, field: str, topics: DataFrame, places: int | None = None) -> DataFrame:
    """(qid, docid, the features) of one field, rounded to ``places``, exact halves upward, for pairs that match in it."""
    found = in_rows(index, topics, (field,), ", ".join(f"{x} double" for x in FEATURES), columns_of(FEATURES, places), once=True)
    if found is not None:
        return found
    by = features_by_field(index, topics, (field,)).drop("field")
    return by if places is None else by.select("qid", "docid", *((F.round(F.col(f) + F.lit(1e-10), places) + F.lit(0.0)).alias(f) for f in FEATURES))


def feature_table(index: Index, topics: DataFrame, places: int, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(qid, docid, a column for each feature), rounded to ``places``, exact halves upward, for pairs that match in any field."""
    names = [f.replace(".", "_") for f in feature_names(fields)]
    found = in_rows(index, topics, fields, ", ".join(f"{x} double" for x in names), columns_of(names, places))
    if found is not None:
        return found
    v = feature_vectors(index, topics, fields)
    return v.select("qid", "docid", *((F.round(F.col("features")[i] + F.lit(1e-10), places) + F.lit(0.0)).alias(n) for i, n in enumerate(names)))


def means(index: Index, topics: DataFrame, names: Sequence[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(feature, mean) of the named features over the pairs that match in any field. A task passes on its sums alone.

    Norms, for which all terms are counted, are taken only if a vector_space is among the names.
    """
    every = feature_names(fields)
    at = [every.index(n) for n in names]
    found = tallies.tallied(index, topics, fields, any(n.endswith(".vector_space") for n in names))
    if found is None:
        v = feature_vectors(index, topics, fields)
        one = v.agg(F.array(*(F.struct(F.lit(n).alias("feature"), F.avg(F.col("features")[i]).alias("mean")) for n, i in zip(names, at, strict=True))).alias("x"))
        return one.select(F.explode("x").alias("x")).select("x.*")
    table, plan = found
    pairs = assembled(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(len(at))
        with np.errstate(divide="ignore", invalid="ignore"):  # norms that were not taken
            for b in slices(batches):
                x = pairs(b)[2]
                n, total = n + len(x), total + x[:, at].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array(np.full(len(at), n)), pa.array(total)], names=["feature", "n", "total"])

    sums = table.mapInArrow(run, "feature string, n bigint, total double").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    every = table.sparkSession.createDataFrame([(n,) for n in names], "feature string")  # also without any pair
    return every.join(F.broadcast(sums), "feature", "left").select("feature", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"))


def feature_names(fields: tuple[str, ...] = FIELDS) -> list[str]:
    return [f"{field}.{f}" for field in fields for f in FEATURES]


def bare_features(index: Index, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(docid, features): what a document has for any topic that it does not match: field lengths, and 0 elsewhere."""
    lengths = index.dl.groupBy("docid").pivot("field", list(fields)).agg(F.first("len"))
    parts = [F.array(*(F.coalesce(F.col(f), F.lit(0)).cast("double") if x == "stream_length" else F.lit(0.0) for x in FEATURES)) for f in fields]
    return lengths.select("docid", F.concat(*parts).alias("features"))


def feature_vectors(index: Index, topics: DataFrame, fields: tuple[str, ...] = FIELDS, known: tuple[DataFrame, tallies.Asked] | None = None) -> DataFrame:
    """(qid, docid, features): an array in the order of feature_names, for pairs that match in any field."""

    def columns(x: np.ndarray) -> dict[str, pa.Array]:
        ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
        return {"features": pa.ListArray.from_arrays(ends, pa.array(x.ravel()))}

    found = in_rows(index, topics, fields, "features array<double>", columns, known)
    if found is not None:
        return found
    one = features_by_field(index, topics, fields).select("qid", "docid", "field", F.array(*FEATURES).alias("v"))
    out = one.groupBy("qid", "docid").agg(*(F.first(F.when(F.col("field") == f, F.col("v")), ignorenulls=True).alias(f"v_{f}") for f in fields))
    out = out.join(bare_features(index, fields).withColumnRenamed("features", "bare"), "docid")
    parts = [F.coalesce(F.col(f"v_{f}"), F.slice("bare", 1 + i * len(FEATURES), len(FEATURES))) for i, f in enumerate(fields)]
    return out.select("qid", "docid", F.concat(*parts).alias("features"))
