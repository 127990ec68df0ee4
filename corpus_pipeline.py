"""A corpus made ready for training: STAGES one after the other over the table `documents`.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is
written as Parquet before the next stage reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import drop_stored, fold, read_table, stored
from lodestack.llm.exact_dedup import kept_rows
from lodestack.llm.mixing import mixed_rows
from lodestack.llm.quality_rules import fit_quality, score_quality
from lodestack.llm.queries import QUALITY_CUT
from lodestack.llm.sentencepiece_unigram import encode_documents, load_vocabulary
from lodestack.llm.shingle_dedup import near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches QUALITY_CUT; rules learnt from the labels outside the held-out fold."""
    labels = read_table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    rows = docs.select(F.struct("*").alias("row"), "text")  # whole, so that no column's name can clash
    scored = score_quality(rows, fit_quality(docs, labels))
    return scored.filter(F.col("score") >= QUALITY_CUT).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the smallest id."""
    return kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: texts of similarity 0.8 or more over 5-word shingles. Rows that share an id are one document."""
    verdicts = near_copies(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = verdicts.select(F.col("doc_id").alias("kept")).distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id")
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document instead of its text, and whether they decode to it."""
    coded = encode_documents(docs, load_vocabulary(), check=True)
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").alias("n_tokens"), "round_trip", "token_ids")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("mixing sources", mixing),
    ("sentencepiece encoding", encoding),
]

#: The learnt rules and XXH64 fingerprints are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, f"stage-{n}")
            if before is not None:
                drop_stored(before)
            before = docs
    return docs
