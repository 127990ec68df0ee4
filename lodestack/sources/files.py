"""Listings and text sources: JSON lines, images, labels, manifests, catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import path_order, stem
from lodestack.operators.pairing import IMAGE_SUFFIXES, has_suffix
from lodestack.schemas import ARCHIVE_CATALOG, REPOSITORY_CATALOG, SPLIT_ROW
from lodestack.sources.archives import ArchiveSource

#: Bytes of a file that one value holds.
MOST_CONTENT = (1 << 31) - (1 << 20)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file or folder; blank lines are skipped, a malformed line stops the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_training_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """read_jsonl(), and an error if there are no rows; a missing path is an error of the reader."""
    rows = read_jsonl(spark, path, schema)
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows


def list_files(spark: SparkSession, root: str, recursive: bool = True, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """(path, size) of files with a suffix; the content is not read. Order by path_order() where order matters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    listed = files.load(root).select(F.regexp_replace("path", "^file:(?=/)", "").alias("path"), F.col("length").alias("size"))
    return listed.filter(has_suffix(F.col("path"), suffixes))


def list_split_images(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Images below root/split in order of paths; a missing folder is an error of the reader."""
    return list_files(spark, f"{root}/{split}").withColumn("split", F.lit(split)).orderBy(path_order(F.col("path")))


def read_images(spark: SparkSession, root: str, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """(path, content, md5) of files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = files.filter(has_suffix(F.col("path"), suffixes))
    return kept.select(F.regexp_replace("path", "^file:(?=/)", "").alias("path"), "content", F.md5("content").alias("md5"))


def read_archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, size, content) of the files in .tar.gz archives, each file whole; one of more than MOST_CONTENT bytes gives several rows, in order."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("chunkBytes", MOST_CONTENT).load(path).drop("chunk")


def checked_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, size, ok) of downloaded files (name, content) against a catalogue (name, size, md5)."""
    found = files.select("name", F.md5("content").alias("_md5"), F.length("content").alias("_size"))
    ok = (F.col("_md5") == F.col("md5")) & (F.col("_size") == F.col("size"))
    return wanted.join(found, "name", "left").select("name", "size", F.coalesce(ok, F.lit(False)).alias("ok"))


def read_label_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, stem, line) of polygon labels."""
    lines = spark.read.option("recursiveFileLookup", "true").text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return lines.select("path", stem(F.col("path")).alias("stem"), "line")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPLIT_ROW).option("header", "true").csv(path)


def read_archive_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARCHIVE_CATALOG).option("multiLine", "true").json(path)


def read_repository_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPOSITORY_CATALOG).option("multiLine", "true").json(path)
