"""Writers of processed collections, index files, runs and tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators.boolean import answer_blocks
from lexispark.operators.index import header, postings


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Text lines in order: ranged over files, so that the files in turn are sorted."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def write_file(lines: DataFrame, path: str, order: list[str]) -> None:
    """Text lines in order as one file at ``path``.

    Parts are written in parallel to a folder of their own beside it, then
    joined in their order under a temporary name, and that file is renamed.
    Until then what stands at ``path`` stays, also if anything fails. The
    parts pass the driver's JVM by the buffer: this is for files that other
    programs read whole, such as runs; larger results stay folders.
    """
    spark, temporary = lines.sparkSession, f"{path}._{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop
    parts, joined, target = (hadoop.fs.Path(p) for p in (f"{temporary}-parts", temporary, path))
    disk = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        lines.orderBy(*order).select("line").write.text(parts.toString())
        out = disk.create(joined, False)
        try:
            for name in sorted(f.getPath().getName() for f in disk.listStatus(parts)):
                if name.startswith("part-"):
                    part = disk.open(hadoop.fs.Path(parts, name))
                    hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                    part.close()
        finally:
            out.close()
        disk.delete(target, True)
        if not disk.rename(joined, target):
            raise OSError(f"cannot rename {joined.toString()} to {path}")
    finally:
        disk.delete(parts, True)
        disk.delete(joined, True)


def write_processed(docs: DataFrame, path: str) -> None:
    """(docid, tokens) as tagged records, in the order of ids."""
    write_lines(docs.select("docid", F.concat(F.lit(".I "), F.col("docid").cast("string"), F.lit("\n.S\n"), F.array_join("tokens", " ")).alias("line")), path, ["docid"])


def index_lines(tf: DataFrame) -> DataFrame:
    """(kind, term, line): the header, then a line for each term."""
    return _lines(header(tf), postings(tf))


def _lines(header: DataFrame, postings: DataFrame) -> DataFrame:
    head = header.select(F.lit(0).alias("kind"), F.lit("").alias("term"), F.concat_ws(", ", F.col("vocabulary").cast("string"), F.col("max_docid").cast("string")).alias("line"))
    rows = postings.select(F.lit(1).alias("kind"), "term", F.concat_ws(" ", "term", F.array_join("docids", ",")).alias("line"))
    return head.unionByName(rows)


def write_index(tf: DataFrame, path: str) -> None:
    write_lines(index_lines(tf), path, ["kind", "term"])


def write_postings(postings: DataFrame, path: str) -> None:
    """The file of ``write_index`` from (term, docids), ids in order; the table is read twice, so it should be a stored one."""
    last = F.coalesce(F.max(F.try_element_at("docids", F.lit(-1))), F.lit(0)).cast("bigint")
    write_lines(_lines(postings.agg(F.count(F.lit(1)).alias("vocabulary"), last.alias("max_docid")), postings), path, ["kind", "term"])


def write_run(lines: DataFrame, path: str, single: bool = False) -> None:
    """A run as a folder of files that are sorted in turn, or as a single file."""
    (write_file if single else write_lines)(lines, path, ["qid", "rank"])


def write_answers(answers: DataFrame, path: str) -> bool:
    """Boolean answers as blocks with an empty line between them. If no query was
    parsed nothing is written, what stands at ``path`` stays, and the result is false."""
    if answers.isEmpty():
        return False
    write_lines(answer_blocks(answers), path, ["query_id"])
    return True


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small value as indented JSON, on any file system that Spark writes."""
    spark.createDataFrame([(json.dumps(value, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown(df: DataFrame) -> str:
    """A result as a table for a report. It is gathered on the driver, so it is for tables of measures."""
    some = df.collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in some])
