"""Exact dedup by a 128-bit content hash, with a comparison of the bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import SPACES


def normalised(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACES, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256, hash128.

    Texts are equal when identical after each run of ASCII white space has become one space.
    Rows are grouped by the 128-bit hash *and* the normalised text itself, so the hash
    aggregation compares the bytes of every group; it combines before the shuffle, so a group
    that holds a third of the corpus reaches the reducers as one row per map task and each
    distinct text is moved about once. Verdicts go back to the rows by (hash, SHA-256), a narrow
    join that adaptive execution can split where one group is hot. Were two different texts to
    share both hashes, the query would stop with an error instead of merging them.

    Defined cases: a null text counts as empty, and empty texts equal one another; a null id
    never becomes keep_id unless the whole group has none, and such rows are kept only then; rows
    that repeat both id and text are one document, given the same verdict, and each counts
    in group_size; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_norm"))
    hashed = rows.withColumn("_h", F.unhex(F.md5("_norm")))

    texts = hashed.groupBy("_h", "_norm").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    groups = (
        texts.select(F.col("_h").alias("_gh"), F.unhex(F.sha2("_norm", 256)).alias("_gsha"), "_keep", "_n")
        .groupBy("_gh", "_gsha")
        .agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_texts"))
    )
    clash = F.raise_error(F.lit("two different texts share a 128-bit and a 256-bit hash"))
    groups = groups.withColumn("_n", F.when(F.col("_texts") == 1, F.col("_n")).otherwise(clash.cast("long")))

    members = hashed.select("_id", "_h", F.unhex(F.sha2("_norm", 256)).alias("_sha"))
    joined = members.join(groups, (F.col("_h") == F.col("_gh")) & (F.col("_sha") == F.col("_gsha")))
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        F.lower(F.hex("_h")).alias("hash128"),
    )


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' columns, whatever their names: one of each group of equal texts.

    Verdicts are joined by one key of hash and id, so rows that share an id and differ in text are judged apart. Rows that repeat both are reduced to one before they
    are shuffled, so no key has more rows than there are map tasks, and each text moves about once here. Other cases are as in exact_dedup().
    """

    def key(h: Column, own: Column) -> Column:
        return F.coalesce(F.concat(h, F.lit("="), own.cast("string")), h)

    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(key(F.col("hash128"), F.col(id_col)).alias("key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), key(F.md5(normalised(text_col)), F.col(id_col)).alias("key"))
    return rows.groupBy("key").agg(F.first("row").alias("row")).join(kept, "key", "left_semi").select("row.*")
