"""Fetching files of a catalogue by ranges of bytes: what is there already is not fetched again, and a file appears only once its MD5 is right."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.sources.volumes import located

#: Bytes of a part, and of what is read at a time.
PART, CHUNK = 64 << 20, 1 << 20
#: The folder of parts, below that of the files.
PARTS = ".parts"

Opener = Callable[[str, int, int], Iterator[bytes]]


def read_range(url: str, start: int, stop: int) -> Iterator[bytes]:
    """Bytes start..stop of an address (http, https) or of a file of any file system."""
    if url.startswith(("http://", "https://")):
        with urlopen(Request(url, headers={"Range": f"bytes={start}-{stop - 1}"})) as response:
            if response.status != 206 and start:
                raise HTTPError(url, response.status, "the server does not give ranges", response.headers, None)
            left = stop - start
            while left and (data := response.read(min(CHUNK, left))):
                left -= len(data)
                yield data
        return
    system, at = located(url)
    with system.open_input_file(at) as file:
        file.seek(start)
        left = stop - start
        while left and (data := file.read(min(CHUNK, left))):
            left -= len(data)
            yield data


def _sizes(system: pafs.FileSystem, folder: str) -> dict[str, int]:
    found = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.is_file}


def planned_parts(wanted: DataFrame, part: int = PART) -> DataFrame:
    """(name, url, size, md5, start, stop) of the ranges of a catalogue's files (name, url, size, md5)."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(part).cast("bigint"))
    rows = wanted.select("name", "url", "size", "md5", F.explode(starts).alias("start"))
    return rows.withColumn("stop", F.least(F.col("start") + part, F.col("size")))


def fetch_parts(parts: DataFrame, folder: str, opener: Opener = read_range) -> DataFrame:
    """(name, start, stop, state, error) of each range: `there` if it was, `fetched`, or `failed` with an error, which ends no other range.

    A range is written under another name and moved when it is whole, so what is there is right in length, and a repeated task does no harm. Ranges of one file
    are fetched by many tasks.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        for batch in batches:
            states, errors = [], []
            for r in batch.to_pylist():
                own, state, error = f"{root}/{PARTS}/{r['name']}", "fetched", None
                at = f"{own}/{r['start']:016d}"
                whole = system.get_file_info(f"{root}/{r['name']}")
                there = system.get_file_info(at)
                if (there.is_file and there.size == r["stop"] - r["start"]) or (whole.is_file and whole.size == r["size"]):
                    state = "there"
                else:
                    try:
                        system.create_dir(own, recursive=True)
                        new, n = f"{at}.{TaskContext.get().taskAttemptId()}", 0
                        with system.open_output_stream(new) as out:
                            for data in opener(r["url"], r["start"], r["stop"]):
                                out.write(data)
                                n += len(data)
                        if n != r["stop"] - r["start"]:
                            system.delete_file(new)
                            raise EOFError(f"{n} of {r['stop'] - r['start']} bytes from {r['start']}")
                        system.move(new, at)
                    except Exception as e:  # one range must not end the others
                        state, error = "failed", f"{type(e).__name__}: {e}"
                states.append(state)
                errors.append(error)
            columns = [*(batch.column(batch.schema.names.index(c)) for c in ("name", "start", "stop")), pa.array(states), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["name", "start", "stop", "state", "error"])

    return parts.mapInArrow(of, "name string, start bigint, stop bigint, state string, error string")


def commit_files(wanted: DataFrame, folder: str) -> DataFrame:
    """(name, path, size, ok, error): parts put together in order where all are there and their MD5 is that of the catalogue (any, if it names none).

    Parts whose MD5 is wrong are deleted, so that the next run fetches them anew; those of a file that lacks some stay. A file that is there and right stays as it
    is; one that is wrong goes. One task reads a file, once, as its MD5 asks for all bytes in order; files are checked in parallel.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)

        def copied(paths: list[str], out: object | None) -> tuple[int, str]:
            digest, n = hashlib.md5(), 0
            for p in paths:
                with system.open_input_stream(p) as file:
                    while data := file.read(CHUNK):
                        digest.update(data)
                        n += len(data)
                        if out is not None:
                            out.write(data)
            return n, digest.hexdigest()

        def committed(r: dict) -> str | None:
            path, own = f"{root}/{r['name']}", f"{root}/{PARTS}/{r['name']}"
            right = lambda n, md5: n == r["size"] and r["md5"] in (None, "", md5)
            if system.get_file_info(path).is_file:
                if right(*copied([path], None)):
                    return None
                system.delete_file(path)
            sizes = {k: v for k, v in _sizes(system, own).items() if k.isdigit()}
            if sum(sizes.values()) != r["size"]:
                return f"{sum(sizes.values())} of {r['size']} bytes are there"
            new = f"{own}/whole.{TaskContext.get().taskAttemptId()}"
            with system.open_output_stream(new) as out:
                n, md5 = copied([f"{own}/{k}" for k in sorted(sizes)], out)
            if right(n, md5):
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                system.move(new, path)
            system.delete_dir(own)
            return None if right(n, md5) else f"MD5 is {md5} instead of {r['md5']}"

        for batch in batches:
            rows = batch.to_pylist()
            errors = [committed(r) for r in rows]
            columns = [[r["name"] for r in rows], [f"{folder}/{r['name']}" for r in rows], [r["size"] for r in rows], [e is None for e in errors], errors]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()))], ["name", "path", "size", "ok", "error"])

    return wanted.select("name", "size", "md5").mapInArrow(of, "name string, path string, size bigint, ok boolean, error string")


def fetch(wanted: DataFrame, folder: str, part: int = PART, opener: Opener = read_range, tasks: int | None = None) -> DataFrame:
    """commit_files() after the ranges that are not there yet were fetched; a run that was cut short is gone on with. wanted: (name, url, size, md5), one row a name.

    The fetched ranges are an action of their own, spread evenly over `tasks` (default: those of the cluster); errors are told by commit_files() as missing bytes.
    """
    parts = planned_parts(wanted, part)
    fetch_parts(parts.repartition(tasks or wanted.sparkSession.sparkContext.defaultParallelism), folder, opener).write.format("noop").mode("overwrite").save()
    return commit_files(wanted, folder)
