"""Near copies by SimHash and the Jaccard similarity of word shingles: fingerprints are searched and compared, MinHash bands add pairs further than the search reaches, and an exact check of the shingles follows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import drop_stored, stored
from lodestack.llm.components import components
from lodestack.llm.simhash_dedup import LOWER, SEED
from lodestack.llm.simhash_dedup import links as fingerprint_links

#: Words of a shingle, and the similarity from which texts are near copies.
SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits of 64 beyond which two texts are no near copies, and are not read for a check. Sets of similarity 0.8 have an angle whose cosine is 0.889 or more, so about 10 bits differ, by a deviation of 3.
REACH = 28
#: Two texts of similarity s share one of the bands at least with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
#: Tasks over which the members of one key are spread, and members of a block, two of which are compared in one task.
SALTS, HELD = 16, 2_000
#: Rows that Python holds the shingles of at a time.
BATCH = 500

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIXED = _random.integers(0, 1 << 63, ROWS + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of `size` words; words as in simhash_dedup.fingerprint(). Fewer words make one shingle, none an empty array."""
    words = (text or b"").translate(LOWER).split()
    digest = xxhash.xxh64_intdigest
    own = {digest(b" ".join(words[k : k + size]), SEED) for k in range(max(1, len(words) - size + 1))} if words else ()
    return np.sort(np.fromiter(own, np.uint64, len(own)))


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key a band from the minima of BANDS * ROWS hashes of the shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(own), 4_096):
        least = np.minimum(least, (own[k : k + 4_096, None] * _FACTORS + _OFFSETS).min(axis=0))
    mixed = (least.reshape(BANDS, ROWS) >> np.uint64(1)) * _MIXED[:ROWS]
    return mixed.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _MIXED[ROWS]


def simhash(own: np.ndarray) -> int:
    """64 bits, signed: a bit is 1 if set in over half of a set's hashes; none: 0."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(own), 4_096):
        total += np.unpackbits(own[k : k + 4_096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(own), bitorder="little").view(np.int64)[0])


def _of_texts(docs: DataFrame, id_col: str, text_col: str, size: int, sets: bool) -> DataFrame:
    """doc_id and node, the hash of a row's set of shingles; with `sets` the set itself as own, else its bands; and fp, the set's SimHash."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, BATCH) for b in batches for k in range(0, b.num_rows, BATCH)):
            found = [shingles(x.as_py(), size) for x in batch.column(1)]
            nodes = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64))
            lists = [(s if sets else band_keys(s) if len(s) else s).view(np.int64) for s in found]
            fps = pa.array([simhash(s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes, pa.array(lists, pa.list_(pa.int64())), fps], ["doc_id", "node", "own", "fp"])

    return rows.mapInArrow(of, f"doc_id {kind}, node bigint, own array<bigint>, fp bigint")


def searched_pairs(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes whose fingerprints are equal or found by the search of simhash_dedup, within its two bits. prints: node, fp, with distinct nodes.

    The nodes of a fingerprint are paired with the smallest of them, and that stands for all where fingerprints differ, so there are fewer pairs than nodes and links.
    """
    leads = stored(prints.groupBy("fp").agg(F.min("node").alias("lead")), "fingerprint-leads")
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as in simhash_dedup.near_dedup()
    found = fingerprint_links(leads.select("fp").repartition(tasks, F.xxhash64("fp")))
    one, two = (leads.select(F.col("fp").alias(n), F.col("lead").alias(f"of_{n}")) for n in "ab")
    other = found.join(one, "a").join(two, "b").select(F.col("of_a").alias("x"), F.col("of_b").alias("y"))
    same = prints.join(leads, "fp").filter("node != lead").select(F.col("node").alias("x"), F.col("lead").alias("y"))
    return stored(other.unionAll(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "fingerprint-pairs")


def shared_keys(bands: DataFrame) -> DataFrame:
    """(node, key, lead) of keys that two nodes or more share. bands: node, own, with distinct nodes.

    The lead is the member that shares its keys with the most others: of near copies of one text, that text or what is nearest to it, so most members are similar to it. Counts
    and leads are combined on the map side and come back to the members by (key, salt), so the members of a hot key are spread over SALTS tasks.
    """
    salted = bands.select("node", F.explode("own").alias("key")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))

    def to_members(of_key: DataFrame, members: DataFrame) -> DataFrame:
        spread = of_key.withColumnRenamed("key", "_key").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return members.join(spread, (F.col("key") == F.col("_key")) & (F.col("salt") == F.col("_salt"))).drop("_key", "_salt")

    counted = stored(to_members(salted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), salted), "shingle-keys")
    shared = counted.groupBy(F.col("node").alias("_node")).agg(F.sum("n").alias("known"))
    ranked = stored(counted.join(shared, F.col("node") == F.col("_node")).select("node", "key", "salt", "known"), "shingle-ranks")
    leads = ranked.groupBy("key").agg(F.max(F.struct("known", "node"))["node"].alias("lead"))
    met = stored(to_members(leads, ranked).select("node", "key", "lead"), "shingle-leads")
    drop_stored(counted)
    drop_stored(ranked)
    return met


def unlike_cells(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, i, j, node, block, root) of keys whose members are not all connected yet: the members dealt into blocks of about HELD, and a cell for each pair of blocks i <= j.

    A node is in as many cells as its key has blocks, and no row is made for a pair.
    """
    named = met.join(roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col("node") == F.col("_node"), "left")
    named = named.select("node", "key", F.coalesce("_root", "node").alias("root"))
    left_open = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high and n > 2")
    left_open = left_open.select(F.col("key").alias("_key"), F.ceil(F.col("n") / HELD).cast("int").alias("blocks"))
    dealt = named.join(left_open, F.col("key") == F.col("_key")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "root")


def links_in_cell(pdf: pd.DataFrame, similarity: float, reach: int = REACH) -> pd.DataFrame:
    """Links (a, b) between nodes of blocks i and j of a key that have different roots. Pairs that share a key of an earlier band are left to that one.

    pdf: rows of one cell of unlike_cells() with own, the keys of a node's bands, fp and shingles. Shingles are compared within `reach` bits alone. Once linked, parts are one here, and no more of their pairs are compared.
    """
    key, i, j = (pdf[c].iloc[0] for c in ("key", "i", "j"))
    pdf = pdf.sort_values(["block", "node"], kind="stable")
    nodes, block, part = (pdf[c].to_numpy() for c in ("node", "block", "root"))
    part, bands, sets = part.copy(), np.stack(pdf["own"].to_numpy()), [np.asarray(x).view(np.uint64) for x in pdf["shingles"]]
    size, fps = np.array([len(x) for x in sets]), pdf["fp"].to_numpy().view(np.uint64)
    earlier = bands[:, : int(np.argmax(bands[0] == key))]
    found = []
    for x in np.flatnonzero(block == i):
        like = (block == j) & (part != part[x]) & (np.minimum(size, size[x]) >= similarity * np.maximum(size, size[x]) - 1e-9)
        like[: x + 1] &= i != j
        like &= np.bitwise_count(fps ^ fps[x]) <= reach
        like &= ~(earlier == earlier[x]).any(axis=1)
        some = np.flatnonzero(like)
        if not len(some):
            continue
        flat = np.concatenate([sets[y] for y in some])
        at = np.minimum(np.searchsorted(sets[x], flat), size[x] - 1)
        both = np.add.reduceat(sets[x][at] == flat, np.concatenate(([0], np.cumsum(size[some])[:-1])), dtype=np.int64)
        for y in some[both >= similarity * (size[x] + size[some] - both) - 1e-9]:
            if part[x] != part[y]:
                part[part == part[y]] = part[x]
                found.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id_col, component_id, the smallest id reachable over pairs of texts whose shingles have this Jaccard similarity or more.

    Each set of shingles has a SimHash. Pairs within two bits are found by the search of simhash_dedup.links(); a similarity of 0.8 lies further, where segments of 64 bits are too short
    to search by, so bands of minima give the pairs there, and the fingerprints decide which of these are read and compared: those within REACH bits.
    Every candidate is verified by the shingles of both texts; texts without a candidate are not read again. Texts with equal sets of shingles are one class before
    any pair is sought, those without words among them. The members of a band's key are first compared with its lead, so a group of n near copies takes n
    comparisons a band; then members of a key that are not connected by that are compared in blocks, however many share the key, and links alone leave the block. So a pair is missed only if no band holds both. Null ids,
    repeated rows and empty tables are treated as in simhash_dedup.near_dedup(); texts of any length are read whole.
    """
    rows = stored(_of_texts(docs, id_col, text_col, size, False), "shingle-bands")
    classes = rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("own").alias("own"), F.first("fp").alias("fp"))
    prints, reach = classes.select("node", "fp"), REACH
    searched = searched_pairs(prints)
    met = shared_keys(classes.select("node", "own"))
    asked = met.select(F.col("node").alias("asked")).unionAll(searched.select("a")).unionAll(searched.select("b")).distinct()
    wanted = rows.join(asked, F.col("node") == F.col("asked"), "left_semi").select(F.col("doc_id").alias("_wanted")).distinct()
    again = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi")
    sets = stored(_of_texts(again, "doc_id", "text", size, True).groupBy("node").agg(F.first("own").alias("own")), "shingle-sets")
    left, right = sets.select(F.col("node").alias("a"), F.col("own").alias("of_a")), sets.select(F.col("node").alias("b"), F.col("own").alias("of_b"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        both = F.size(F.array_intersect("of_a", "of_b"))
        near = both >= similarity * (F.size("of_a") + F.size("of_b") - both) - 1e-9
        return stored(pairs.join(left, "a").join(right, "b").filter(near).select("a", "b"), name)

    banded = met.filter("node != lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
    of_a, of_b = (prints.select(F.col("node").alias(n), F.col("fp").alias(f"fp_{n}")) for n in "ab")
    banded = banded.join(of_a, "a").join(of_b, "b").filter(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= reach).select("a", "b")
    links = verified(searched.unionAll(banded).distinct(), "shingle-links")
    roots = components(links, "a", "b")
    cells = unlike_cells(met, roots).join(sets.select(F.col("node").alias("_n"), F.col("own").alias("shingles")), F.col("node") == F.col("_n"))
    cells = cells.join(classes.select(F.col("node").alias("_c"), "own", "fp"), F.col("node") == F.col("_c")).drop("_n", "_c")
    more = stored(cells.groupBy("key", "i", "j").applyInPandas(lambda pdf: links_in_cell(pdf, similarity, reach), "a bigint, b bigint"), "more-shingle-links")
    if not more.isEmpty():
        roots = components(links.unionAll(more), "a", "b")
    named = classes.select(F.col("node").alias("_node"), "rep").join(roots, F.col("_node") == F.col("node"), "left").select("_node", "rep", F.coalesce("root", "_node").alias("root"))
    named = stored(named, "shingle-classes")
    for table in (met, sets, links, more, searched):
        drop_stored(table)
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    owned = named.join(least, "root").select("_node", "component_id")
    return rows.join(owned, F.col("node") == F.col("_node")).select(F.col("doc_id").alias(id_col), "component_id")
