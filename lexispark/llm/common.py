"""Column helpers and storage helpers shared by the operators of this package."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, after A-Z are lower-cased: ASCII digits, a-z and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast path of ``lower``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """The words of a text; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset on one machine, as in tests, a temporary folder
    becomes the session's checkpoint folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lexispark-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: What ``stored`` has written in this process, until discarded.
_written: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, not made yet; ``release`` deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that it is
    neither computed again nor lost with an executor."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def same_files(view: DataFrame, of: DataFrame) -> DataFrame:
    """``view``, known to be made of the columns of the stored table ``of``, so that it can be judged by its files."""
    view._stored_at = of._stored_at
    return view


def free(df: DataFrame, name: str) -> str:
    """``name`` with the first number that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return next(f"{name}{i}" for i in range(len(taken) + 1) if f"{name}{i}".lower() not in taken)


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table that ``stored`` returned."""
    at, disk = _files(df.sparkSession, df._stored_at)
    return disk.getContentSummary(at).getLength()


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for tables that no later plan reads."""
    for df in tables:
        at, disk = _files(df.sparkSession, df._stored_at)
        disk.delete(at, True)
        _written.remove(df._stored_at)


def release(spark: SparkSession) -> int:
    """Delete all that the operators have stored in this process and not yet
    discarded; for when their results have been written. Gives the number of folders."""
    n = len(_written)
    while _written:
        at, disk = _files(spark, _written.pop())
        disk.delete(at, True)
    return n


#: Stored tables whose files (compressed columns) are larger than this are never broadcast by the operators here.
BROADCAST_BYTES = 4 << 20


def few(table: DataFrame) -> DataFrame:
    """A table that ``stored`` returned, with a broadcast hint if its files are small, else as it is: a plain shuffle join."""
    return F.broadcast(table) if file_bytes(table) <= BROADCAST_BYTES else table


def integral(df: DataFrame, *columns: str) -> None:
    """Raise TypeError at the call, not deep in a job, if an id column is no integer."""
    for c in columns:
        if (kind := df.select(c).dtypes[0][1]) not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError(f"column {c} must hold integers, not {kind}")
