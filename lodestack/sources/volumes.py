"""A Spark data source for 3-D array volumes: .npy files and .npz archives, one row for each slice.

    spark.dataSource.register(VolumeSource)
    spark.read.format("volume").option("maxSlices", 10).load("/data/*.npz")

Volumes that are stored as they are are dealt to tasks by ranges of bytes, so that one volume feeds many; deflated ones are read whole by one task. Slices are read
one at a time, or, from arrays in column-major order, in blocks of bounded memory. Archives whose directory at the end is lost are read as far as they go.
"""

from __future__ import annotations

import ast
import fnmatch
import glob
import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = b"\x93NUMPY"
ZIP_MEMBER = b"PK\x03\x04"
CHUNK = 1 << 20
#: Bytes of a volume that one task reads, and bytes of the sections that are gathered at a time from a column-major array.
SPLIT, GATHERED = 128 << 20, 64 << 20


class Inflated:
    """A readable view of raw deflate data that ends where the data ends."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.inflater, self.held = file, zlib.decompressobj(-zlib.MAX_WBITS), bytearray()

    def read(self, size: int = -1) -> bytes:
        while (size < 0 or len(self.held) < size) and not self.inflater.eof:
            chunk = self.file.read(CHUNK)
            if not chunk:
                break
            self.held += self.inflater.decompress(chunk)
        n = len(self.held) if size < 0 else size
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def listed(pattern: str) -> list[str]:
    """Files of a pattern in order; below an address, the last part may have wildcards."""
    return [path for path, _ in sized(pattern)]


def sized(pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files of a pattern in order; below an address, the last part may have wildcards."""
    if "://" not in pattern:
        paths = sorted(glob.glob(pattern.removeprefix("file:")))
        return [(f.path, f.size) for f in pafs.LocalFileSystem().get_file_info(paths) if f.is_file]
    folder, _, name = pattern.rpartition("/")
    system, root = located(folder)
    found = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted((f"{folder}/{f.base_name}", f.size) for f in found if f.is_file and fnmatch.fnmatchcase(f.base_name, name))


def opened(path: str) -> BinaryIO | Inflated:
    """The array's bytes: of a .npy file, or of the first member of a zip archive, found by its local header."""
    system, at = located(path)
    file = system.open_input_file(at)
    head = file.read(30)
    if head[:6] == MAGIC:
        file.seek(0)
        return file
    if head[:4] != ZIP_MEMBER or len(head) < 30:
        raise ValueError(f"{path} is neither an array nor an archive")
    method, names, extra = struct.unpack("<H", head[8:10])[0], *struct.unpack("<HH", head[26:30])
    file.seek(30 + names + extra)
    if method == 0:
        return file
    if method != 8:
        raise ValueError(f"{path}: compression method {method} is not supported")
    return Inflated(file)


def header(file: BinaryIO | Inflated, path: str) -> tuple[tuple[int, ...], np.dtype, bool]:
    """Shape and type of an array, and whether it is in column-major order."""
    start = file.read(8)
    if start[:6] != MAGIC:
        raise ValueError(f"{path} does not begin as an array")
    n = struct.unpack("<H", file.read(2))[0] if start[6] == 1 else struct.unpack("<I", file.read(4))[0]
    about = ast.literal_eval(file.read(n).decode("latin1").strip())
    return tuple(about["shape"]), np.dtype(about["descr"]), about["fortran_order"]


def slices(path: str, most: int | None = None, part: int = 0, split: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(index, section) of a volume, or of its part-th range of `split` bytes: sections belong to the range in which they begin. Ends at a section that is not whole."""
    file = opened(path)
    shape, kind, by_column = header(file, path)
    if len(shape) != 3:
        raise ValueError(f"{path} has {len(shape)} axes instead of 3")
    size, n = shape[1] * shape[2] * kind.itemsize, shape[0] if most is None else min(most, shape[0])
    first, last = 0, n
    if split is not None:
        if isinstance(file, Inflated):  # no place in it can be found without reading what is before
            last = n if part == 0 else 0
        elif size:
            first, last = (min(n, -(-k * split // size)) for k in (part, part + 1))
    if by_column:
        yield from _gathered(path, file, shape, kind, first, last)
        return
    if first and first < last:
        file.seek(file.tell() + first * size)
    for k in range(first, last):
        data = file.read(size)
        if len(data) < size:
            return
        yield k, np.frombuffer(data, kind).reshape(shape[1:])


def _gathered(path: str, file: BinaryIO | Inflated, shape: tuple[int, ...], kind: np.dtype, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sections first..last of a column-major array, whose columns (one number of each section) lie together. As many sections as GATHERED bytes hold are put together in one
    pass over the columns: of a deflated array from its beginning, of a stored one by strided reads where a column is long, so that what is skipped is not read."""
    columns, item = shape[1] * shape[2], kind.itemsize
    most = max(1, GATHERED // max(1, columns * item))
    begin = None if isinstance(file, Inflated) else file.tell()
    for low in range(first, last, most):
        high = min(last, low + most)
        out = np.empty((columns, high - low), kind)
        if begin is None and low > first:
            file = opened(path)
            header(file, path)
        strided = begin is not None and shape[0] * item > CHUNK and (high - low) * 4 < shape[0]
        many = max(1, CHUNK // (shape[0] * item))
        for at in range(0, columns, many):
            n = min(many, columns - at)
            if strided:
                data = b"".join(file.read_at((high - low) * item, begin + ((at + k) * shape[0] + low) * item) for k in range(n))
                width, own = high - low, slice(None)
            else:
                if begin is not None:
                    file.seek(begin + at * shape[0] * item)
                data = file.read(n * shape[0] * item)
                width, own = shape[0], slice(low, high)
            if (short := n * width * item - len(data)) > 0:
                # only what ends the last column may be missing; sections before it are whole
                last = min(last, low - own.indices(width)[0] + width - -(-short // item))
                if at + n < columns or last <= low:
                    return
                data += bytes(short)
            out[at : at + n] = np.frombuffer(data, kind).reshape(n, width)[:, own]
        for k in range(min(high, last) - low):
            yield low + k, np.ascontiguousarray(out[:, k].reshape(shape[2], shape[1]).T)
        if last < high:
            return


def load_mask(content: bytes, size: int = 32) -> np.ndarray:
    """A 0/1 mask of an array file's bytes: member `fault` or the first, the middle section of a volume, above 0, nearest cell."""
    array = np.load(io.BytesIO(content))
    if isinstance(array, np.lib.npyio.NpzFile):
        array = array["fault" if "fault" in array.files else array.files[0]]
    if array.ndim == 3:
        array = array[array.shape[0] // 2]
    rows, columns = (((np.arange(size) + 0.5) * n / size).astype(int) for n in array.shape)
    return (np.asarray(array, np.float32)[rows][:, columns] > 0).astype(np.float32)


def masks(files: DataFrame, size: int = 32) -> DataFrame:
    """(path, values) of array files (path, content): the mask of each, size * size numbers row by row, in Arrow batches."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [load_mask(c, size).ravel() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float32()))], ["path", "values"])

    return files.select("path", "content").mapInArrow(of, "path string, values array<float>")


def array_images(files: DataFrame) -> DataFrame:
    """(path, height, width, values) of array files (path, content): axes of length one taken out, of more than two the first channel."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = []
            for c in batch.column(1).to_pylist():
                a = np.squeeze(np.load(io.BytesIO(c)))
                a = np.atleast_2d(a if a.ndim <= 2 else a[..., 0])
                images.append(a.reshape(a.shape[0], -1))
            columns = [pa.array([a.shape[k] for a in images], pa.int32()) for k in (0, 1)]
            values = pa.array([a.ravel().astype(np.float64) for a in images], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, values], ["path", "height", "width", "values"])

    return files.select("path", "content").mapInArrow(of, "path string, height int, width int, values array<double>")


def paired_slices(seis: DataFrame, fault: DataFrame, on: str = "id") -> DataFrame:
    """(on, slice_idx, height, width, seis, fault) of two volumes' slices, matched by place; a pair of other shapes stops the query. Slices that one side lacks are left out.

    Both sides are (on, slice_idx, height, width, values).
    """
    right = fault.select(F.col(on).alias("_on"), F.col("slice_idx").alias("_slice"), F.col("height").alias("_h"), F.col("width").alias("_w"), F.col("values").alias("fault"))
    both = seis.join(right, (F.col(on) == F.col("_on")) & (F.col("slice_idx") == F.col("_slice")))
    same = (F.col("height") == F.col("_h")) & (F.col("width") == F.col("_w"))
    text = F.concat(F.lit("the two volumes of "), F.col(on).cast("string"), F.lit(" differ in shape"))
    height = F.when(same, F.col("height")).otherwise(F.raise_error(text).cast("int"))
    return both.select(on, "slice_idx", height.alias("height"), "width", F.col("values").alias("seis"), "fault")


class VolumePart(InputPartition):
    def __init__(self, path: str, part: int) -> None:
        super().__init__(path)
        self.path, self.part = path, part


class VolumeReader(DataSourceReader):
    """A partition of each `splitBytes` of a file, by its size alone: no file is opened to plan. A part in which no section begins, or of a deflated file after the first, is empty."""

    def __init__(self, options: dict) -> None:
        self.pattern = options["path"]
        given = {k.lower(): v for k, v in options.items()}
        self.most = int(given["maxslices"]) if given.get("maxslices") else None
        self.split = int(given.get("splitbytes") or SPLIT)

    def partitions(self) -> list[VolumePart]:
        files = sorted(f for part in self.pattern.split(",") for f in sized(part))
        if not files:
            raise FileNotFoundError(self.pattern)
        return [VolumePart(path, k) for path, size in files for k in range(max(1, -(-size // self.split)))]

    def read(self, partition: VolumePart) -> Iterator[pa.RecordBatch]:
        for k, section in slices(partition.path, self.most, partition.part, self.split):
            values = pa.ListArray.from_arrays(pa.array([0, section.size], pa.int32()), pa.array(section.astype(np.float32).ravel()))
            shape = [pa.array([v], pa.int32()) for v in (k, *section.shape)]
            yield pa.RecordBatch.from_arrays([pa.array([partition.path]), *shape, values], ["path", "slice_idx", "height", "width", "values"])


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return "path string, slice_idx int, height int, width int, values array<float>"

    def reader(self, schema: object) -> VolumeReader:
        return VolumeReader(self.options)
