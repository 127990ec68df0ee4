"""SimHash near-dedup by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import stored
from lodestack.llm.components import components

BITS = 64
#: Links are pairs of fingerprints at this many differing bits or fewer. Two segments are cut: one of
#: them then differs by one bit at most.
RADIUS = 2
SEGMENT = 32
SEED = 42
SHINGLE = 3
#: Fingerprints of one signature that a task holds (16 bytes each); beyond, the exact way of
#: _masked_pairs() takes over.
HELD = 65_536
#: Signatures with more fingerprints than this are linked by sorting under masks, not by comparing all.
COMPARED = 2_048
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes | None) -> int:
    """64 bits, signed: a bit is 1 if set in over half the XXH64 (seed 42) of the 3-word shingles.

    A-Z are lower-cased; words are runs of anything but ASCII white space; repeated shingles count again;
    fewer words than three make one shingle; no words make 0.
    """
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest, set_in = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, n, 50_000):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[k : k + 50_000], ends[k : k + 50_000])]
        octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_in > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(of, f"doc_id {kind}, fp bigint")


def signatures(fps: DataFrame) -> DataFrame:
    """(key, fp): 64 one-wildcard signatures of each fingerprint, made by expressions alone.

    Bit i of a segment is cleared; the key holds the segment, i and what is left, so two
    fingerprints share a key exactly if one segment agrees in all bits but perhaps bit i.
    """
    i = F.col("i")
    ones = F.lit((1 << SEGMENT) - 1).cast("bigint")
    segment = F.when(i < SEGMENT, F.col("fp").bitwiseAND(ones)).otherwise(F.shiftrightunsigned("fp", SEGMENT))
    hole = F.expr("shiftleft(1L, i % 32)")
    key = F.shiftleft(i.cast("bigint"), SEGMENT).bitwiseOR(segment.bitwiseAND(F.bitwise_not(hole)))
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("i")).select(key.alias("key"), "fp")


def linked(x: np.ndarray, hole: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints of x as all pairs within RADIUS bits do, fewer than len(x).

    x: distinct fingerprints that agree in segment `own` in all bits but perhaps bit `hole`.
    """
    if len(x) <= COMPARED:
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= RADIUS
        label = np.arange(len(x))
        while True:
            low = np.where(near, label, len(x)).min(axis=1)
            low = low[low]
            if (low == label).all():
                break
            label = low
    else:
        root = list(range(len(x)))

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        free = [own * SEGMENT + hole, *((1 - own) * SEGMENT + j for j in range(SEGMENT))]
        for p in range(len(free)):
            for q in range(max(p, 0) + 1, len(free)):
                masked = x & ~np.uint64((1 << free[p]) | (1 << free[q]))
                order = np.argsort(masked, kind="stable")
                same = np.flatnonzero(masked[order][1:] == masked[order][:-1])
                for a, b in zip(order[same].tolist(), order[same + 1].tolist()):
                    a, b = top(a), top(b)
                    if a != b:
                        root[max(a, b)] = min(a, b)
        label = np.array([top(k) for k in range(len(x))])
    other = np.flatnonzero(label != np.arange(len(x)))
    return x[other], x[label[other]]


def _links_of_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, links (a, b); (a, null) for the fingerprints of a key with over HELD."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    flooded = None

    def out(a: list, b: list) -> pa.RecordBatch:
        a = np.concatenate(a).view(np.int64) if a else np.zeros(0, np.int64)
        b = np.concatenate(b).view(np.int64) if b else np.zeros(0, np.int64)
        full = np.concatenate((np.ones(len(b), bool), np.zeros(len(a) - len(b), bool)))
        b = np.concatenate((b, np.zeros(len(a) - len(b), np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=~full)], ["a", "b"])

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
        size = ends - starts
        two = starts[size == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= RADIUS
        a, b = [fps[two][near]], [fps[two + 1][near]]
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            i = int(keys[s]) >> SEGMENT
            x, y = linked(fps[s:e], i % SEGMENT, i // SEGMENT)
            a.append(x)
            b.append(y)
        return out(a, b)

    for batch in batches:
        new_keys = batch.column(0).to_numpy(zero_copy_only=False)
        new_fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if flooded is not None:
            n = int(np.searchsorted(new_keys, flooded, "right"))
            if n:
                yield out([new_fps[:n]], [])
            new_keys, new_fps = new_keys[n:], new_fps[n:]
        keys, fps = np.concatenate((keys, new_keys)), np.concatenate((fps, new_fps))
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last:
            yield links(keys[:last], fps[:last])
        keys, fps = keys[last:], fps[last:]
        if len(keys) > HELD:
            flooded = keys[0]
            yield out([fps], [])
            keys, fps = keys[:0], fps[:0]
    if len(keys):
        yield links(keys, fps)


def _masked_pairs(fps: DataFrame) -> DataFrame:
    """Links among fps by clearing each of the 2016 pairs of bits: at most four fingerprints share
    what is left, all of them within two bits, so no group can grow."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(BITS - 1)))
    pairs = fps.withColumn("p", bit).withColumn("q", bit).filter("p < q")
    masked = F.expr("fp & ~(shiftleft(1L, p) | shiftleft(1L, q))")
    groups = pairs.groupBy("p", "q", masked.alias("rest")).agg(F.collect_list("fp").alias("own"), F.min("fp").alias("b"))
    return groups.select(F.explode("own").alias("a"), "b").filter("a != b")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect what pairs within RADIUS bits connect.

    fps: one column fp, distinct. Candidates come from an equality of signatures alone, a
    shuffle of 64 short rows a fingerprint; each is verified by its bits. A signature that many
    share yields fewer links than it has fingerprints, found in one task of bounded memory, or
    by _masked_pairs() if over HELD share it. No link is lost in either way.
    """
    # the session's number of partitions; sorting spills, so a task holds one signature only
    keyed = signatures(fps).repartition("key").sortWithinPartitions("key")
    found = stored(keyed.mapInArrow(_links_of_signatures, "a bigint, b bigint"), "signature-links")
    flood = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    pairs = found.filter("b is not null").select("a", "b")
    return pairs if flood.isEmpty() else pairs.unionByName(_masked_pairs(flood))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of RADIUS bits or fewer, its own included. Rows
    with equal fingerprints are one class before any link is sought, so copies cost one row each.

    Defined cases: null and empty texts and texts of white space have fingerprint 0 and are linked
    like others; a null id is never a component_id unless the component has no other; repeated
    rows are each given back with the same result; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    # short rows, and each becomes 64: dealt over all tasks. By number, as adaptive execution leaves short rows to a few tasks otherwise, and
    # by a hash of its own, as an exchange by the column that the rows are grouped by is taken for needless and removed
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots = components(links(classes.select("fp").repartition(tasks, F.xxhash64("fp"))), "a", "b")
    owned = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root")
    )
    owned = stored(owned, "classes")
    least = owned.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = owned.join(least, "root").select(F.col("fp").alias("own"), "component_id")
    return rows.join(named, F.col("fp") == F.col("own")).select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
