"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.session import shared_dir

#: ASCII white space, the only separators of words: \x20 and \x09 to \x0D.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again.

    Cuts the lineage without losing anything when an executor goes: the copy lies in the
    shared store, compressed and column-pruned on the way back. It is deleted by drop_stored(), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, at = _located(spark, path)
    system.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop_stored(df: DataFrame) -> None:
    """Deletes what stored() wrote for df; df must not be read afterwards."""
    for file in df.inputFiles()[:1]:
        system, at = _located(df.sparkSession, file)
        system.delete(at.getParent(), True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n: the fold a row belongs to (null: null)."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)


def pieces(texts: Sequence[str | None], most: int = 1 << 20) -> Iterator[list[str]]:
    """texts in order, in lists of about `most` characters, or of one longer text."""
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


#: Rows of a table that may be broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 100_000


def sent(table: DataFrame, rows: int | None = None, most: int | None = None) -> DataFrame:
    """table, broadcast if it has no more rows than `most`. rows: their number where it is known; else they are counted, so table should be stored."""
    n = table.count() if rows is None else rows
    return F.broadcast(table) if n <= (MOST_BROADCAST if most is None else most) else table
