"""A Spark data source for .tar.gz archives: their files in chunks, from the stream of the file system.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archive").option("chunkBytes", 1 << 20).load("/data/*.tar.gz")

An archive is one partition, as deflated data has one beginning; it is never held whole, nor are its files: memory is bounded by a chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestack.sources.volumes import listed, located

#: Bytes of a header or of the unit to which files are filled up, and of a chunk of a file.
BLOCK, CHUNK = 512, 4 << 20
#: Bytes read from the archive at a time.
READ = 1 << 18
#: Fixed values of the format: kinds of entries.
FILES, LONG_NAME, EXTENDED, EXTENDED_FOR_ALL = b"0\0", b"L", b"x", b"g"


class Gunzipped:
    """The data of a gzip stream of one member or several; read() gives as many bytes as asked for, or what there is."""

    def __init__(self, stream: object) -> None:
        self.stream, self.inflater, self.rest, self.held = stream, zlib.decompressobj(31), b"", bytearray()

    def read(self, n: int) -> bytes:
        while len(self.held) < n:
            data = self.rest or self.stream.read(READ)
            if not data:
                if not self.inflater.eof:
                    raise EOFError("the archive ends early")
                break
            if self.inflater.eof:
                if not data.strip(b"\0"):  # filled up with zeros
                    self.rest = b""
                    continue
                self.inflater = zlib.decompressobj(31)
            self.held += self.inflater.decompress(data, max(READ, n))
            self.rest = self.inflater.unconsumed_tail or self.inflater.unused_data
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


@dataclass
class Entry:
    name: str
    size: int
    kind: bytes


def number(field: bytes) -> int:
    """A number of a header: octal digits, or, with the first bit set, the bytes after it."""
    if field[0] & 128:
        return int.from_bytes(bytes([field[0] & 127]) + field[1:], "big")
    return int(field.strip(b"\0 ") or b"0", 8)


def entry(block: bytes) -> Entry:
    own = sum(block) - sum(block[148:156]) + 8 * 32  # the sum counts its own field as spaces
    if own != number(block[148:156]):
        raise ValueError("not a tar header")
    text = lambda a, b: block[a:b].split(b"\0")[0].decode("utf-8", "replace")
    prefix = text(345, 500) if block[257:263] == b"ustar\0" else ""
    return Entry(f"{prefix}/{text(0, 100)}" if prefix else text(0, 100), number(block[124:136]), block[156:157])


def extended(data: bytes) -> dict[str, str]:
    """Records `length key=value` of an extended header."""
    out = {}
    while data.strip(b"\0"):
        n = int(data[: data.index(b" ")])
        key, _, value = data[data.index(b" ") + 1 : n - 1].partition(b"=")
        out[key.decode()] = value.decode("utf-8", "replace")
        data = data[n:]
    return out


def members(stream: object, chunk: int = CHUNK) -> Iterator[tuple[str, int, int, bytes]]:
    """(name, size, number of the chunk, content) of the files of a .tar.gz stream in order; a file without content has one empty chunk. Folders, links and devices are passed over."""
    source, long, for_next, for_all = Gunzipped(stream), None, {}, {}

    def skip(n: int) -> None:
        while n > 0:
            n -= len(source.read(min(n, chunk)) or b"\0" * n)

    while True:
        block = source.read(BLOCK)
        if len(block) < BLOCK or not block.strip(b"\0"):
            return
        found = entry(block)
        filled = -found.size % BLOCK
        if found.kind in (LONG_NAME, EXTENDED, EXTENDED_FOR_ALL):
            data = source.read(found.size)
            skip(filled)
            if found.kind == LONG_NAME:
                long = data.rstrip(b"\0").decode("utf-8", "replace")
            elif found.kind == EXTENDED:
                for_next = extended(data)
            else:
                for_all |= extended(data)
            continue
        about = for_all | for_next
        name, size = about.get("path") or long or found.name, int(about.get("size", found.size))
        long, for_next = None, {}
        if found.kind not in (b"", *(FILES[k : k + 1] for k in range(2))):
            skip(size + -size % BLOCK)
            continue
        for k in range(max(1, -(-size // chunk))):
            own = min(chunk, size - k * chunk)
            data = source.read(own)
            if len(data) < own:
                raise EOFError("the archive ends early")
            yield name, size, k, data
        skip(-size % BLOCK)


class Archive(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        given = {k.lower(): v for k, v in options.items()}
        self.pattern, self.chunk = given["path"], int(given.get("chunkbytes") or CHUNK)

    def partitions(self) -> list[Archive]:
        paths = sorted(path for part in self.pattern.split(",") for path in listed(part))
        if not paths:
            raise FileNotFoundError(self.pattern)
        return [Archive(p) for p in paths]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        system, at = located(partition.path)
        with system.open_input_stream(at, compression=None) as stream:
            for name, size, k, data in members(stream, self.chunk):
                columns = [pa.array([partition.path]), pa.array([name]), pa.array([size], pa.int64()), pa.array([k], pa.int32()), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["archive", "member", "size", "chunk", "content"])


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, member string, size bigint, chunk int, content binary"

    def reader(self, schema: object) -> ArchiveReader:
        return ArchiveReader(self.options)


def extract_archives(spark: SparkSession, path: str, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Writes the files of archives below folder/<archive without .tar.gz>, each archive by one task as it is read; (archive, member, path, size) of what is there then.

    A file appears once it is whole, so a task that fails leaves no half file, and one that is repeated writes the same again. A name that leads out of the folder is an error.
    """
    spark.dataSource.register(ArchiveSource)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        out, written = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                parts = [p for p in row["member"].split("/") if p not in ("", ".")]
                if ".." in parts or not parts:
                    raise ValueError(f"{row['archive']}: the name {row['member']!r} leads out of the folder")
                inner = "/".join([row["archive"].rsplit("/", 1)[-1].removesuffix(".tar.gz"), *parts])
                if row["chunk"] == 0:
                    system.create_dir(f"{root}/{inner}".rsplit("/", 1)[0], recursive=True)
                    out, written = system.open_output_stream(f"{root}/{inner}.{TaskContext.get().taskAttemptId()}.part"), 0
                out.write(row["content"])
                written += len(row["content"])
                if written == row["size"]:
                    out.close()
                    system.move(f"{root}/{inner}.{TaskContext.get().taskAttemptId()}.part", f"{root}/{inner}")
                    line = [pa.array([row["archive"]]), pa.array([row["member"]]), pa.array([f"{folder}/{inner}"]), pa.array([written], pa.int64())]
                    yield pa.RecordBatch.from_arrays(line, ["archive", "member", "path", "size"])

    chunks = spark.read.format("archive").option("chunkBytes", chunk).load(path)
    return chunks.mapInArrow(of, "archive string, member string, path string, size bigint")
