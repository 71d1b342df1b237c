"""The linear ranker as a stage of Spark ML pipelines."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lexispark.operators import tallies
from lexispark.operators.features import FEATURES, feature_names, feature_vectors
from lexispark.operators.index import FIELDS, Index
from lexispark.operators.learning import BLOCK, VERSION, rank_all
from lexispark.operators.places import first
from lexispark.operators.ranking import rank as first_by_rank
from lexispark.operators.reports import table_digest


class _Reader(DefaultParamsReader):
    """Reads a stage and refuses one whose scoring is of another version."""

    def load(self, path: str) -> LinearRanker:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)["paramMap"]
        if found.get("version") != VERSION:
            raise ValueError("the stage's scoring version differs; train again")
        return super().load(path)


class LinearRanker(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the linear decision of an array of features: their weighted sum and the intercept.

    Params are what a bundle holds: version of the scoring, names of the
    features in their order, weights, intercept, and digests of the tables that
    the model was made from. A null array has a null score; one of another
    length than the weights is an error.
    """

    version = Param(Params._dummy(), "version", "version of the scoring", TypeConverters.toString)
    features = Param(Params._dummy(), "features", "names of the features, in the order of the array", TypeConverters.toListString)
    weights = Param(Params._dummy(), "weights", "weight of each feature", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "what is added to the sum", TypeConverters.toFloat)
    inputs = Param(Params._dummy(), "inputs", "JSON object of table names and their digests", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, weights: Sequence[float] | None = None, intercept: float = 0.0, features: Sequence[str] | None = None, inputs: str = "{}", inputCol: str = "features", outputCol: str = "score"):  # noqa: N803
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**{"intercept": 0.0, "inputs": "{}", "inputCol": "features", "outputCol": "score", **given, "version": VERSION})

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)

    def transformSchema(self, schema: StructType) -> StructType:  # noqa: N802
        """The schema with the score; an error if the input is no array of doubles or the output's name is taken."""
        if not isinstance(schema[self.getInputCol()].dataType, ArrayType) or schema[self.getInputCol()].dataType.elementType.typeName() != "double":
            raise TypeError(f"{self.getInputCol()} must be an array of doubles")
        if self.getOutputCol() in schema.names:
            raise ValueError(f"there is a column {self.getOutputCol()} already")
        return StructType(list(schema.fields)).add(self.getOutputCol(), "double")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self.transformSchema(dataset.schema)
        w, x = self.getOrDefault("weights"), F.col(f"`{self.getInputCol()}`")
        dot = F.aggregate(F.zip_with(x, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) + F.lit(self.getOrDefault("intercept"))
        wrong = F.raise_error(F.lit(f"features are not the {len(w)} that the stage has weights for")).cast("double")
        return dataset.withColumn(self.getOutputCol(), F.when(x.isNotNull() & (F.size(x) != len(w)), wrong).otherwise(dot))

    def changed(self, tables: Mapping[str, DataFrame]) -> list[str]:
        """The names, in order, of the tables whose rows are not those that the model was made from, or that it does not know."""
        known = json.loads(self.getOrDefault("inputs"))
        return sorted(name for name, t in tables.items() if known.get(name) != table_digest(t).first()["digest"])


def ranker(weights: Sequence[float], intercept: float, tables: Mapping[str, DataFrame] | None = None) -> LinearRanker:
    """A stage over the features of all fields, with digests of the given tables."""
    inputs = {name: table_digest(t).first()["digest"] for name, t in (tables or {}).items()}
    return LinearRanker(weights=[float(w) for w in weights], intercept=float(intercept), features=feature_names(), inputs=json.dumps(inputs, sort_keys=True))


def rank(model: Transformer, vectors: DataFrame, bare: DataFrame, topics: DataFrame, k: int) -> DataFrame:
    """(qid, docid, score, rank): the first k of all documents by a stage, or a fitted pipeline that ends in one.

    ``vectors`` (qid, docid, features) has the pairs that match, ``bare`` (docid, features) what is left of a document where it does not.
    """
    scored, rest = model.transform(vectors), model.transform(bare)
    return rank_all(scored.select("qid", "docid", "score"), rest.select("docid", "score"), topics, k)


def rank_in_rows(model: Transformer, index: Index, topics: DataFrame, k: int) -> DataFrame | None:
    """``rank`` where documents are counted in their rows: a task scores its documents' features by the stage, for the topics
    that they match and for any other, and passes on the first k of each topic. None if the counts are not in one row."""
    found = tallies.tallied(index, topics, FIELDS)
    if found is None or dict(found[0].dtypes)["docid"] not in ("bigint", "int"):
        return None
    table, plan = found
    scored = model.transform(feature_vectors(index, topics, known=found))
    bare = F.array(*(F.col("lens")[i].cast("double") if x == "stream_length" else F.lit(0.0) for i in range(len(FIELDS)) for x in FEATURES))
    rest = model.transform(table.withColumn("features", bare)).select("docid", "codes", "tfs", "score")
    hits, qids, many = tallies.triples(plan), plan.qids, len(plan.qids)

    def unmatched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                b = batch.slice(i, BLOCK)
                s = b.column("score").to_numpy(zero_copy_only=False)
                free = np.ones((b.num_rows, many), bool)
                row, topic, *_ = hits(b)
                free[row, topic] = False
                order = np.lexsort((b.column("docid").to_numpy(), -np.round(s, 9)))
                free = free[order]
                at, topic = np.nonzero(free & (np.cumsum(free, axis=0) <= k))
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(topic)), b.column("docid").take(pa.array(order[at])), pa.array(s[order[at]])], names=["qid", "docid", "score"])

    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c, d in (("qid", topics), ("docid", table)))
    fill = rest.mapInArrow(unmatched, f"{kinds}, score double")
    return first_by_rank(first(scored, k).unionByName(first(fill, k)), k)
