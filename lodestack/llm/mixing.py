"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import WORD, sent, stored

#: No document, shard or source is taken more often than this.
MOST_EPOCHS = 3
#: Different rows (by id and text) of a source that share a shard, about. A shard is ordered in one task.
SHARD_ROWS = 4_000
#: Words of a block: the largest power of two up to this that is a hundredth of the smallest target or less.
BLOCK_WORDS = 1_024


def capped_targets(sizes: Sequence[float], weights: Sequence[float], most: float = MOST_EPOCHS) -> list[float]:
    """Shares of sum(sizes) by weight; none above most times its size, the excess reshared by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, free, rest = np.zeros(len(sizes)), sizes > 0, float(sizes.sum())
    while free.any():
        share = np.where(free, rest * weights / weights[free].sum(), 0.0)
        over = free & (share > most * sizes)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = most * sizes[over]
        rest -= float(out[over].sum())
        free &= ~over
    return out.tolist()


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int]) -> np.ndarray:
    """Seats by highest quotients votes / (2 s + 1), at most most[i] each; ties to the earlier.

    The last quotient that wins is bisected, so the time does not depend on the number of seats.
    """
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    most = np.where(votes > 0, most, 0)
    seats = int(min(seats, most.sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)

    def won(least: float) -> np.ndarray:
        return np.minimum(np.floor((votes / least + 1) / 2), most).astype(np.int64)

    low, high = votes[votes > 0].min() / (2.0 * most.max() + 3), votes.max() * 2
    for _ in range(200):
        mid = math.sqrt(low * high)
        if not low < mid < high:
            break
        low, high = (mid, high) if won(mid).sum() >= seats else (low, mid)
    got = won(high)
    while (left := seats - int(got.sum())) > 0:
        quotients = np.where(got < most, votes / (2 * got + 1), -1.0)
        best = np.argsort(-quotients, kind="stable")[:left]
        got[best[quotients[best] >= quotients.max() * (1 - 1e-12)]] += 1
    return got


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = (1, 2, 3),
    seed: int = 42,
) -> DataFrame:
    """One row per input row: id_col, size, source_size, target, taken.

    A row's size is its number of words. Sources in order of code points, null last, take the weights in
    turn and share the sum of all sizes, each up to MOST_EPOCHS times its own size. Blocks of equally
    many words go to sources by highest quotients; each source's blocks go to its shards, hashed
    slices of about SHARD_ROWS rows, the same way. A shard with a quota of e whole rounds and r words
    takes each of its rows e times and then, in an order seeded by hash, the blocks that hold the first r words; a row
    that the last block cuts is taken in part.

    The driver holds one row per source name, never rows, and shards are apportioned on executors. Source and shard are one key
    of the order, and rows are dealt by id and text, so a source, or an id, of any size is split over its shards; rows that repeat both are one row with a count until
    their words are dealt out. So no task orders more than about SHARD_ROWS short rows. Texts are not moved.

    Defined cases: a null text has size 0, and rows without words are taken 0 times; null is a source
    of its own; null ids are hashed like any other; repeated rows are separate; texts of any length count whole; an empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    ranked, _ = _ranked(docs, id_col, source_col, text_col, weights, seed)
    joined = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)))
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("rest") - F.col("_before") - F.col("_copy") * F.col("_size")))
    return joined.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("rounds") * F.col("_size") + part).cast("long").alias("taken")
    )


def _key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))


def _cell(seed: int, own: Column, printed: Column, shards: Column, key: Column) -> Column:
    """Source and shard as one value: were they two, a join by source would keep all shards of a source in one task."""
    return F.concat_ws(" ", F.pmod(F.xxhash64(F.lit(seed), own, printed), shards).cast("string"), key)


def _print(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _ranked(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: Sequence[int], seed: int) -> tuple[DataFrame, DataFrame]:
    """Different rows (_id, _print, _size) with the number of their _copies, _cell, _hash, source_size and target, the words _before them in their shard's order, its whole rounds, and the
    rest of its words; and the sources."""
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), _key(source_col).alias("_key"), size.alias("_size"), _print(text_col).alias("_print"))
    rows = stored(rows.groupBy("_id", "_key", "_size", "_print").agg(F.count(F.lit(1)).alias("_copies")), "sizes")
    rows = rows.withColumn("_words", F.col("_size") * F.col("_copies"))
    found = rows.groupBy("_key").agg(F.sum("_words").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    found.sort(key=lambda r: (r["_key"] == "", r["_key"]))
    sizes = [r["n"] for r in found]
    targets = capped_targets(sizes, [weights[k % len(weights)] for k in range(len(found))])
    least = min((t for t in targets if t > 0), default=1.0)
    block = max(1, 1 << min(int(math.log2(BLOCK_WORDS)), max(0, int(math.log2(max(1.0, least / 100))))))
    quotas = sainte_lague(targets, round(sum(targets) / block), [MOST_EPOCHS * n // block for n in sizes])
    sources = docs.sparkSession.createDataFrame(
        [(r["_key"], r["n"], t, int(q), max(1, math.ceil(r["rows"] / SHARD_ROWS))) for r, t, q in zip(found, targets, quotas)],
        "_source string, source_size long, target double, blocks long, shards int",
    )
    sources = sent(sources, len(found))
    placed = rows.join(sources, F.col("_key") == F.col("_source")).withColumn("_cell", _cell(seed, F.col("_id"), F.col("_print"), F.col("shards"), F.col("_key")))

    def apportion(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_cell")
        got = sainte_lague(pdf["words"], int(pdf["blocks"].iloc[0]), MOST_EPOCHS * pdf["words"].to_numpy() // block)
        return pdf[["_cell", "words"]].assign(quota=got * block)

    shards = placed.groupBy("_cell", "_key").agg(F.sum("_words").alias("words"), F.first("blocks").alias("blocks"))
    shards = shards.groupBy("_key").applyInPandas(apportion, "_cell string, words long, quota long")
    rounds = F.expr("if(words > 0, quota div words, 0)")
    shards = shards.select(F.col("_cell").alias("_of"), rounds.alias("rounds"), (F.col("quota") - rounds * F.col("words")).alias("rest"))

    hashed = placed.select("_id", "_print", "_size", "_copies", "_words", "_cell", "source_size", "target", F.xxhash64("_id", "_print", F.lit(seed)).alias("_hash"))
    order = Window.partitionBy("_cell").orderBy("_hash", "_id", "_print", "_size")
    before = F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_words")
    return hashed.withColumn("_before", before).join(shards, F.col("_cell") == F.col("_of")), sources


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = (1, 2, 3), seed: int = 42) -> DataFrame:
    """The rows of docs as the mix takes them: one copy for each whole time, with docs' columns, whatever their names.

    The one row in a shard that its last block cuts is kept if half of its words or more are taken. Sizes are ranked without their texts; what comes back to the
    rows is, for each shard, its rounds and the last hash that the cut takes, so texts stay where they are read. Rows that repeat id and text are taken alike, all or none by
    half of their words. Null and empty texts are never taken; null is a source of its own; an empty table stays empty.
    """
    ranked, sources = _ranked(docs, id_col, source_col, text_col, weights, seed)
    half = (F.col("_size") > 0) & (2 * (F.col("rest") - F.col("_before")) >= F.col("_words"))
    cells = ranked.groupBy(F.col("_cell").alias("_of")).agg(F.first("rounds").alias("rounds"), F.max(F.when(half, F.col("_hash"))).alias("last"))
    cells = stored(cells, "cells")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), _print(text_col).alias("_print"), _key(source_col).alias("_key"), F.coalesce(F.col(text_col).cast("string").rlike(WORD), F.lit(False)).alias("_any"))
    rows = rows.join(sources.select("_source", "shards"), F.col("_key") == F.col("_source"))
    rows = rows.withColumn("_cell", _cell(seed, F.col("_id"), F.col("_print"), F.col("shards"), F.col("_key"))).join(sent(cells), F.col("_cell") == F.col("_of"))
    more = F.coalesce(F.xxhash64("_id", "_print", F.lit(seed)) <= F.col("last"), F.lit(False)).cast("int")
    copies = F.when(F.col("_any"), F.col("rounds").cast("int") + more).otherwise(0)
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")
