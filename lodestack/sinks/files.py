"""Writers: JSON lines, manifests, several outputs of one computation."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack import providers
from lodestack.functions.text import path_order
from lodestack.operators.pairing import rows_per_split
from lodestack.operators.records import instruction_record, sft_record
from lodestack.session import drop_written, written
from lodestack.sources.volumes import located


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite", keep_nulls: bool = False) -> None:
    """One JSON object a line. Null fields are left out unless they are to be kept."""
    rows.write.mode(mode).option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    write_jsonl(rows, path, mode="append")


def write_manifest(pairs: DataFrame, path: str, split: str) -> None:
    """id, seis and fault of one split, by number; rows that lack a side are left out."""
    own = pairs.filter((F.col("split") == split) & F.col("seis").isNotNull() & F.col("fault").isNotNull())
    own.select("id", "seis", "fault").orderBy(F.col("id").cast("int")).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def fan_out(rows: DataFrame, outputs: Callable[[DataFrame], Mapping[str, DataFrame | None]], mode: str = "overwrite") -> None:
    """Writes several outputs that come from rows: outputs(rows) gives a frame, or None to be skipped, for each path.

    rows are written to the shared folder first, so they are computed once whatever executor is lost, and all outputs are made of the same rows.
    """
    table = written(rows, "fan-out")
    for path, frame in outputs(table).items():
        if frame is not None:
            write_jsonl(frame, path, mode)
    drop_written(table)


def write_verified(verified: DataFrame, path: str, kept_path: str | None = None) -> None:
    """All verified rows, and those that are kept."""
    fan_out(verified, lambda rows: {path: rows} | ({kept_path: rows.filter(~F.col("verification.remove"))} if kept_path else {}))


def verified_paths(path: str) -> tuple[str, str]:
    """Where the verified rows of an output go, and those that are kept: x_verified.jsonl and x_verified_filtered.jsonl of x.jsonl."""
    stem = path.removesuffix(".jsonl")
    return f"{stem}_verified.jsonl", f"{stem}_verified_filtered.jsonl"


def write_splits(rows: DataFrame, path: str) -> None:
    """A folder split=... for each split, so readers prune to those they want; only splits that are written are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").json(path)


def write_generated(rows: DataFrame, folder: str, split: str, limit: int | None = None, mode: str = "append") -> None:
    """Instruction rows, chat rows and error rows of providers.generate() to split.jsonl, split_sft.jsonl and split_errors.jsonl below folder.

    With a limit, the first so many successes in order of paths are written, and of the errors those before the last of them, as if images had been tried one by one.
    All images have been sent to the model by then; generate_split() stops in time.
    """

    def outputs(table: DataFrame) -> dict[str, DataFrame]:
        good, bad = providers.succeeded(table), providers.failed(table)
        if limit is not None:
            good = good.orderBy(path_order(F.col("image"))).limit(limit)
            place = good.agg(F.max(path_order(F.col("image"))).alias("last"), F.count(F.lit(1)).alias("n")).first()
            if place["n"] >= limit:
                bad = bad.filter(path_order(F.col("image")) < F.lit(place["last"] or []).cast("array<string>"))
        c = F.col
        sides = [(c(f"{s}_answer_raw"), c(f"{s}_reasoning"), c(f"{s}_answer")) for s in ("generator", "second", "merged")]
        records = good.select(*instruction_record(c("image"), c("split"), c("question"), c("detections"), *sides))
        chats = good.select(*sft_record(c("image"), c("question"), c("merged_reasoning"), c("merged_answer"), c("answer_source"), c("detections")))
        return {f"{folder}/{split}{end}.jsonl": frame for frame, end in ((records, ""), (chats, "_sft"), (bad, "_errors"))}

    fan_out(rows, outputs, mode)


def generate_split(images: DataFrame, run: Callable[[DataFrame], DataFrame], folder: str, split: str, limit: int | None = None, mode: str = "append", least: int = providers.ROUND) -> None:
    """Sends a split's images (image, split, detections) through run, such as providers.generate() with its models, and writes what comes back; with a limit, in rounds that stop once there are so many successes."""
    own = images.filter(F.col("split") == split)
    write_generated(run(own) if limit is None else providers.in_rounds(own, run, limit, least), folder, split, mode=mode)


def write_overlay_splits(rows: DataFrame, folder: str, splits: Sequence[str]) -> dict[str, int]:
    """Overlay records (columns of records.overlay_record()) of each split to split_sft.jsonl; their numbers by split, 0 for a split without rows, which is not written."""
    counts = {r["split"]: r["n"] for r in rows_per_split(rows, splits).collect()}
    for split in splits:
        if counts[split]:
            write_jsonl(rows.filter(F.col("split") == split), f"{folder}/{split}_sft.jsonl")
    return counts


def write_history(log: DataFrame, path: str) -> None:
    """A training log (step, and any other columns) as one JSON array in order of steps, an object a line, nulls left out; written by one task as a stream, and there once it is whole."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = located(path)
        folder, _, name = at.rpartition("/")
        system.create_dir(folder, recursive=True)
        part, n = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}", 0
        with system.open_output_stream(part) as out:
            out.write(b"[")
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    out.write((",\n  " if n else "\n  ").encode() + line.encode())
                    n += 1
            out.write(b"\n]\n" if n else b"]\n")
        system.move(part, at)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    lines = log.orderBy("step").select(F.to_json(F.struct("*")).alias("line"))
    if not lines.coalesce(1).mapInArrow(of, "n bigint").collect():  # an empty table has no tasks
        system, at = located(path)
        with system.open_output_stream(at) as out:
            out.write(b"[]\n")


def png(values: bytes, width: int, height: int) -> bytes:
    """A grey image of one byte a pixel as a PNG file."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + values[k * width : (k + 1) * width] for k in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_grey_images(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (name, height, width, values array<int>) as folder/name.png where they are; (path, size) of what is written. A repeated task writes the same files again."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for name, height, width, values in zip(*(batch.column(k).to_pylist() for k in range(4))):
                data = png(bytes(values), width, height)
                with system.open_output_stream(f"{root}/{name}.png") as out:
                    out.write(data)
                paths.append(f"{folder}/{name}.png")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    return rows.select("name", "height", "width", "values").mapInArrow(of, "path string, size bigint")


def write_data_yaml(root: str, names: tuple[str, ...] = ("fault",)) -> str:
    """Writes data_yaml() to root/data.yaml and returns its path; a small file from the driver."""
    system, at = located(root)
    system.create_dir(at, recursive=True)
    with system.open_output_stream(f"{at}/data.yaml") as out:
        out.write(data_yaml(root, names).encode())
    return f"{root}/data.yaml"


def data_yaml(root: str, names: tuple[str, ...] = ("fault",)) -> str:
    """The description of a detection dataset."""
    listed = "\n".join(f"  {k}: {n}" for k, n in enumerate(names))
    return f"path: {root}\ntrain: images/train\nval: images/val\ntest: images/test\nnames:\n{listed}\n"
