"""Streams: verification of records as they arrive, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestack.operators.claims import kept, verify


def read_jsonl_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def verified_stream(rows: DataFrame, answer: str, out: str, kept_out: str, checkpoint: str) -> StreamingQuery:
    """Verified rows to `out` and kept rows to `kept_out`, each batch in a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        checked = verify(batch, answer).persist()
        checked.write.mode("overwrite").json(f"{out}/batch={number}")
        kept(checked).write.mode("overwrite").json(f"{kept_out}/batch={number}")
        checked.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_successes_stream(rows: DataFrame, n: int, split: str = "split", path: str = "image") -> DataFrame:
    """Of each split's rows without an error the first n over all batches; within a batch in order of paths. The count of each split is the stream's state, so it goes on after a restart.

    Rows with an error pass and do not count. A split's rows of a batch are gone through in Arrow batches, of which no more than are still wanted are held.
    Rows without a split are one split.
    """
    names, schema = rows.columns, rows.schema

    def of(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        held = None
        for batch in batches:
            failed = batch["error"].notna()
            if failed.any():
                yield batch[failed][names]
            good = batch[~failed]
            if seen < n and len(good):
                held = good if held is None else pd.concat([held, good])
                parts = [(p or "").split("/") for p in held[path]]
                held = held.iloc[sorted(range(len(held)), key=parts.__getitem__)[: n - seen]]
        if held is not None:
            yield held[names]
            seen += len(held)
        state.update((seen,))

    keyed = rows.withColumn("_split", F.coalesce(F.col(split), F.lit("")))
    return keyed.groupBy("_split").applyInPandasWithState(of, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by event time; what comes later than `late` is left out of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def stream_to_parquet(frame: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs what there is now; the whole result of each batch replaces the table at path, so a repeated batch does no harm. Rows never pass the driver."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    frame.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
