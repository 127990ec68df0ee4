"""Line dedup: common lines stay in one document only; what stays is told by a bitmap for each document."""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import pieces, stored

#: Code points of a key from which its lines count, and documents from which a key is common.
LEAST_LENGTH, LEAST_DOCUMENTS = 40, 5
#: White space that is stripped at both ends of a line.
ENDS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """What lines are compared by: ASCII white space stripped at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(ENDS)), string.ascii_uppercase, string.ascii_lowercase)


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _lines(docs: DataFrame, id_col: str, text_col: str, least_length: int) -> DataFrame:
    """A row of each line that counts: the 128 bits of its key, its document (id and a hash of its text), and its place there."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(_text(text_col)).alias("print"), F.posexplode(F.split(_text(text_col), "\n", -1)).alias("place", "line"))
    keys = rows.select("id", "print", "place", line_key(F.col("line")).alias("key")).filter(F.length("key") >= least_length)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "print", "place", F.spark_partition_id().alias("task"))


#: Of a key, or of none: rows (ids, prints, places), or the key's first documents.
Found = tuple[tuple[int, int] | None, tuple[np.ndarray, ...] | None, list | None]


class FirstOccurrences:
    """Lines that go, from rows of one partition in order of (key, document descending, place).

    The first document of a key keeps its lines; from the `least`-th document on it is known that those of all others go, and until then they wait: lines of less
    than `least` documents. The partition's first key may have begun before it, so its rows are handed on with their key, as are those that still wait at the end;
    of both keys the first `least` documents are told, from which all partitions together decide.
    """

    def __init__(self, least: int) -> None:
        self.least, self.key, self.first, self.documents, self.waiting = least, None, False, [], []

    def feed(self, keys: np.ndarray, rows: tuple[np.ndarray, ...]) -> Iterator[Found]:
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
        ends = np.r_[new[1:], len(keys)]
        # runs within the batch that are too short for `least` documents say nothing
        for j in np.unique(np.r_[0, np.flatnonzero(ends - new >= self.least), len(new) - 1]):
            key, own = tuple(keys[new[j]].tolist()), tuple(c[new[j] : ends[j]] for c in rows)
            if key != self.key:
                yield from self.ended(last=False)
                self.key, self.first, self.documents, self.waiting = key, self.key is None, [], []
            yield from self._more(own)

    def _more(self, own: tuple[np.ndarray, ...]) -> Iterator[Found]:
        if len(self.documents) < self.least:
            ids = own[0]
            seen = ids[np.r_[True, ids[1:] != ids[:-1]]][: self.least + 1].tolist()
            if self.documents and seen[0] == self.documents[-1]:
                del seen[0]
            self.documents = (self.documents + seen)[: self.least]
            if not self.first:
                self.waiting.append(own)
                if len(self.documents) < self.least:
                    return
                own = tuple(map(np.concatenate, zip(*self.waiting)))
                self.waiting = []
        if self.first:
            yield self.key, own, None
        else:
            gone = own[0] != self.documents[0]
            yield None, tuple(c[gone] for c in own), None

    def ended(self, last: bool = True) -> Iterator[Found]:
        """The end of a run, and with `last` that of the partition."""
        if self.key is not None and (self.first or last):
            for own in self.waiting:
                yield self.key, own, None
            yield self.key, None, self.documents


def _gone(lines: DataFrame, least: int) -> DataFrame:
    """lines dealt by ranges and gone through in order: (id, print, place) that go, with a key (h1, h2) where other partitions decide; and keys with documents."""
    # the task breaks ties of rows that repeat id and text, so that even these are dealt to several partitions
    order = [F.col("h1"), F.col("h2"), F.col("id").desc_nulls_last(), F.col("print"), F.col("place"), F.col("task")]
    kind = lines.schema["id"].dataType.simpleString()
    names = ["h1", "h2", "id", "print", "place", "documents"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, before = FirstOccurrences(least), None

        def made(found: Iterator[Found], ids: pa.DataType) -> Iterator[pa.RecordBatch]:
            types = [pa.int64(), pa.int64(), ids, pa.int64(), pa.int32(), pa.list_(ids)]
            for key, rows, documents in found:
                n = 1 if rows is None else len(rows[0])
                columns = [*([None] * n if key is None else [h] * n for h in key or (0, 0)), *([[None]] * 3 if rows is None else (c.tolist() for c in rows)), [documents] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in (0, 1)], 1)
            ids = np.empty(len(keys), object)
            ids[:] = batch.column(2).to_pylist()
            rows = (ids, batch.column(3).to_numpy(), batch.column(4).to_numpy())
            same = (keys[1:] == keys[:-1]).all(1)
            for c in rows:
                same &= c[1:] == c[:-1]
            now = [(tuple(keys[k].tolist()), *(c[k] for c in rows)) for k in (0, -1)]
            once = np.flatnonzero(np.r_[now[0] != before, ~same])  # rows that repeat key, document and place count once
            before = now[1]
            if len(once):
                yield from made(state.feed(keys[once], tuple(c[once] for c in rows)), batch.column(2).type)
        if before is not None:
            yield from made(state.ended(), batch.column(2).type)

    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(of, f"h1 bigint, h2 bigint, id {kind}, print bigint, place int, documents array<{kind}>")


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(id_col, print, n_dropped, bitmap) of each document that loses lines; kept_lines() applies bitmaps.

    Lines with equal keys (line_key()) of `least_length` code points in `least_documents` documents or more stay in the document with the largest id alone. bitmap: a
    bit for each line as far as lines go, 1 where it stays, compressed. print: the XXH64 hash of the text that it is for.

    128-bit hashes of lines, not lines, are dealt by ranges of (hash, document, place), so a line that a third of all documents hold fills several partitions. Each
    is read once in order, in bounded memory. Only the keys at the edges of a partition, two of each, depend on others; their first documents, put together and
    broadcast, decide about the rows that were handed on.

    Defined cases: rows that share an id, or have none, are one document, and that without an id is below all others; rows that repeat id and text lose the same
    lines; a null text is one empty line; lines of any length and number are read whole; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    found = stored(_gone(stored(_lines(docs, id_col, text_col, least_length), "lines"), least_documents), "lines-gone")
    edges = found.filter(F.col("documents").isNotNull()).groupBy("h1", "h2").agg(F.array_distinct(F.flatten(F.collect_list("documents"))).alias("documents"))
    common = edges.filter(F.size("documents") >= least_documents).select("h1", "h2", F.array_max("documents").alias("largest"))
    rows = found.filter(F.col("documents").isNull())
    handed_on = rows.filter(F.col("h1").isNotNull()).join(F.broadcast(common), ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("largest")))
    gone = rows.filter(F.col("h1").isNull()).select("id", "print", "place").unionByName(handed_on.select("id", "print", "place"))
    kind = found.schema["id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bitmaps = [], []
            for places in batch.column(2):
                at = places.values.to_numpy()
                bits = np.ones(int(at.max()) // 8 * 8 + 8, np.uint8)
                bits[at] = 0
                bitmaps.append(zlib.compress(np.packbits(bits).tobytes()))
                counts.append(len(at))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(bitmaps, pa.binary())], [id_col, "print", "n_dropped", "bitmap"])

    lists = gone.groupBy("id", "print").agg(F.collect_set("place").alias("places"))
    return lists.mapInArrow(of, f"`{id_col}` {kind}, print bigint, n_dropped bigint, bitmap binary")


def bits_of(bitmap: bytes | None, n: int) -> np.ndarray:
    """Of n lines, which stay: all, as far as the bitmap does not say otherwise."""
    bits = np.ones(n, bool)
    if bitmap is not None:
        own = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n]
        bits[: len(own)] = own
    return bits


def kept_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_lines, n_dropped, text) of each row: what line_bitmaps() leaves of its lines, joined by \\n. Each text moves once; cases are as there."""
    rows = docs.select(F.col(id_col).alias("id"), _text(text_col).alias("text"), F.xxhash64(_text(text_col)).alias("print"))
    found = bitmaps.select(F.col(id_col).alias("of_id"), F.col("print").alias("of_print"), "bitmap").hint("shuffle_hash")
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("print") == F.col("of_print")), "left").select("id", "text", "bitmap")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(1).to_pylist()):
                n_lines, n_dropped, kept = [], [], []
                for text, bitmap in zip(texts, batch.column(2).slice(at, len(texts)).to_pylist()):
                    lines = text.split("\n")
                    bits = bits_of(bitmap, len(lines))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - int(bits.sum()))
                    kept.append(text if bitmap is None else "\n".join(x for x, stays in zip(lines, bits) if stays))
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], [id_col, "n_lines", "n_dropped", "text"])

    return joined.mapInArrow(of, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_lines bigint, n_dropped bigint, text string")
