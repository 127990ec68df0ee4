"""Hard negatives: for each anchor and positive, the best rows of other labels within a window of scores, by distributed radix selection.

Rows and anchors are packed into blocks, and every block of rows meets every block of anchors in an equality join. Scores are computed where they meet and never
leave the task: what leaves are counts of digits, and at last the rows that qualify.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import drop_stored, stored

#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Positives of an anchor, negatives of each, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 5, 80, 100
#: Rows and anchors of a block, anchors whose scores are held at a time, and bits of a digit.
ROW_BLOCK, ANCHOR_BLOCK, AT_A_TIME, DIGIT_BITS = 8192, 8192, 256, 8
#: Bytes of all anchors' blocks up to which they are broadcast, and blocks of rows that one reducer meets beyond.
SENT_BYTES, ROW_BLOCKS_A_SALT = 32 << 20, 16
#: Scores beyond this count as this, so that a hundred times one is still a 64-bit number.
LARGEST = 1 << 55

_PACKED = "ids binary, labels binary, width int, kind string, vectors binary"
_NAMES = ["ids", "labels", "width", "kind", "vectors"]


def valid(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, vector) of rows that take part: none of the three is null, and all components are finite numbers."""
    own = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Integer vectors as rows of doubles; what a shorter vector lacks is 0."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _pack(rows: pa.RecordBatch | pa.Table) -> list[pa.Array]:
    """Columns of one block, its rows in order of ids."""
    table = pa.table({c: rows.column(k) for k, c in enumerate(("id", "label", "vector"))}).sort_by([("id", "ascending"), ("label", "ascending")]).combine_chunks()
    ids, labels = (table[c].to_numpy().astype(np.int64) for c in ("id", "label"))
    vectors = _matrix(table["vector"].chunk(0)) if len(table) else np.zeros((0, 0))
    kind = "i2" if np.abs(vectors).max(initial=0) < 1 << 15 else "f8"
    blob = vectors.astype(kind).tobytes()
    return [pa.array([ids.tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary()), pa.array([vectors.shape[1]], pa.int32()), pa.array([kind]), pa.array([blob], pa.binary())]


class _Block:
    def __init__(self, row: dict, end: str = "") -> None:
        self.ids, self.labels = (np.frombuffer(row[c + end], np.int64) for c in ("ids", "labels"))
        self.vectors = np.frombuffer(row["vectors" + end], row["kind" + end]).reshape(len(self.ids), row["width" + end])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of a with rows of b, exact within LARGEST."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    bound = n * float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    if bound < 1 << 53:
        kind = np.float32 if bound < 1 << 24 else np.float64  # whole numbers up to there are exact, in any order of addition
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -LARGEST, LARGEST).astype(np.int64)


def _meet(rows: DataFrame, n_rows: int, anchors: DataFrame, n_anchors: int, anchor_bytes: int) -> DataFrame:
    """Every block of rows beside every block of anchors, by an equality join over the numbers of blocks.

    Few anchors are broadcast. Else both sides are dealt: rows to the blocks of anchors, these to as many salts as there are runs of ROW_BLOCKS_A_SALT blocks of rows.
    """
    anchors = anchors.select("block", *(F.col(c).alias(f"{c}_a") for c in anchors.columns if c != "block"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))))
    if anchor_bytes <= SENT_BYTES:
        return rows.join(F.broadcast(anchors), "block")
    salts = -(-n_rows // ROW_BLOCKS_A_SALT)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    return rows.join(anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("shuffle_hash"), ["block", "salt"])


def _over(met: DataFrame, each: Callable[[_Block, _Block, dict | None], Iterator[tuple]], schema: str) -> DataFrame:
    """each(rows, anchors, windows) of every pair of blocks; it yields arrays of equal length, the columns of schema, all bigint."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                windows = None
                if "windows_a" in batch.schema.names:
                    found = row.column("windows_a").flatten()
                    windows = {f.name: found.field(f.name).to_numpy() for f in found.type}
                row = {c: row.column(c)[0].as_py() for c in batch.schema.names if c != "windows_a"}
                parts = list(each(_Block(row), _Block(row, "_a"), windows))
                if parts:
                    columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return met.mapInArrow(of, schema)


def _by_anchor(rows: _Block, anchors: _Block, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place among anchors, scores of all rows) of the anchors at places `of`."""
    for low in range(0, len(of), AT_A_TIME):
        own = of[low : low + AT_A_TIME]
        yield from zip(own.tolist(), scores(anchors.vectors[own], rows.vectors))


def _best(score: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """Of the places `among`, in order of ids, the n with the highest scores, ties by smaller id."""
    own = score[among]
    if len(own) > n:
        kth = np.partition(own, len(own) - n)[len(own) - n]
        among = among[own >= kth]
        own = own[own >= kth]
    return among[np.argsort(-own, kind="stable")][:n]


def _positives(n: int) -> Callable:
    def each(rows: _Block, anchors: _Block, _: None) -> Iterator[tuple]:
        for j, score in _by_anchor(rows, anchors, np.arange(len(anchors.ids))):
            best = _best(score, np.flatnonzero((rows.labels == anchors.labels[j]) & (rows.ids != anchors.ids[j])), n)
            yield np.full(len(best), anchors.ids[j]), rows.ids[best], score[best]

    return each


def _in_windows(rows: _Block, anchors: _Block, windows: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the window, scores, rows of other labels inside it), window by window."""
    place = np.searchsorted(anchors.ids, windows["anchor"])
    order = np.argsort(place, kind="stable")
    of, first = np.unique(place[order], return_index=True)
    own = dict(zip(of.tolist(), np.split(order, first[1:])))
    for j, score in _by_anchor(rows, anchors, of):
        wide = np.flatnonzero((rows.labels != anchors.labels[j]) & (score >= windows["low"][own[j]].min()) & (score <= windows["high"][own[j]].max()))
        for w in own[j]:
            yield w, score, wide[(score[wide] >= windows["low"][w]) & (score[wide] <= windows["high"][w])]


def _digits(rows: _Block, anchors: _Block, windows: dict) -> Iterator[tuple]:
    """Counts of the leading digit of (high - score), for each window."""
    for w, score, inside in _in_windows(rows, anchors, windows):
        if len(inside):
            found, n = np.unique((windows["high"][w] - score[inside]) >> windows["shift"][w], return_counts=True)
            yield np.full(len(n), windows["anchor"][w]), np.full(len(n), windows["place"][w]), found, n


def _qualifying(n: int) -> Callable:
    def each(rows: _Block, anchors: _Block, windows: dict) -> Iterator[tuple]:
        for w, score, inside in _in_windows(rows, anchors, windows):
            best = _best(score, inside, n)
            yield *(np.full(len(best), windows[c][w]) for c in ("anchor", "place", "positive", "positive_score")), rows.ids[best], score[best]

    return each


def _floored(value: Column, by: int) -> Column:
    """A whole number divided by another, rounded down, exactly."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def _shift(width: Column) -> Column:
    """The bits below the leading digit of numbers from 0 to width."""
    bits = F.length(F.bin(width))
    return F.greatest(F.lit(0), bits - DIGIT_BITS)


def _narrowed(state: DataFrame, counts: DataFrame) -> DataFrame:
    """state after a round: the cell of each open window that holds its k-th score, by running sums over the digits."""
    key = ["anchor", "place"]
    so_far = F.sum("n").over(Window.partitionBy(*key).orderBy("digit"))
    known = counts.groupBy(*key, "digit").agg(F.sum("n").alias("n")).join(state.select(*key, "need"), key)
    reached = known.withColumn("upto", so_far).filter(F.col("upto") >= F.col("need"))
    cell = reached.groupBy(*key).agg(F.min(F.struct("digit", "n", "upto")).alias("cell"))
    c, top = F.col, F.col("high") - F.call_function("shiftleft", F.col("cell.digit"), F.col("shift"))
    bottom = F.greatest(c("low"), top - F.call_function("shiftleft", F.lit(1).cast("bigint"), c("shift")) + 1)
    short = c("cell").isNull()  # fewer rows than needed: all of the window qualify
    return state.join(cell, key, "left").select(
        *key, "positive", "positive_score", "most",
        F.when(short, c("low")).otherwise(bottom).alias("low"), F.when(short, c("high")).otherwise(top).alias("high"),
        F.when(short, c("need")).otherwise(c("need") - (c("cell.upto") - c("cell.n"))).alias("need"),
        (short | (c("cell.upto") == c("need")) | (top == bottom)).alias("done"),
    ).withColumn("shift", _shift(c("high") - c("low")))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where is_anchor (a condition on `id`) holds and each of its positives the
    first `negatives` rows of other labels whose score is within least/100 and most/100 of the positive's.

    Components become floor(SCALE * x); a score is the integer inner product with the anchor. Higher scores come first, ties by smaller id. Positives are the first
    `positives` other rows of the anchor's label.

    Every row meets every anchor, block by block (_meet()). Positives come as the best of each block, cut to the first of each anchor before and after the shuffle. For
    the negatives, each round counts digits of the scores inside each window, sums them, and narrows the window to the cell of the k-th score: after at most
    ceil(bits / DIGIT_BITS) rounds its score is known, and only rows from it on are gathered, of each block no more than asked for, so not even a third of
    all rows with one score makes a group. The driver sees one number a round.

    Defined cases: rows with a null id, label or vector, or with a component that is null or not finite take no part; vectors of unequal length are compared over what
    both have; an anchor id that repeats is one anchor, of its smallest label and vector, and rows with its id are not its positives; other rows that repeat count
    each; scores beyond 2^55 count as that; a positive with a score below 0 has an empty window; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    own = valid(rows, id_col, label_col, vector_col)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, row_block):
                held.append(batch.slice(at, row_block))
                n += held[-1].num_rows
                if n >= row_block:
                    yield pa.RecordBatch.from_arrays(_pack(pa.Table.from_batches(held)), _NAMES)
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays(_pack(pa.Table.from_batches(held)), _NAMES)

    row_blocks = stored(own.mapInArrow(packed, _PACKED), "row-blocks")
    anchors = own.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*")
    anchors = stored(anchors, "anchors")
    size = anchors.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vector")).alias("components")).first()
    n_blocks, n_rows = max(1, -(-size["n"] // anchor_block)), row_blocks.count()
    number = lambda column: F.pmod(F.xxhash64(column), F.lit(n_blocks)).cast("int")

    def one(table: pa.Table) -> pa.Table:
        return pa.table([table["block"].slice(0, 1), *_pack(table.select(["id", "label", "vector"]))], ["block", *_NAMES])

    anchor_blocks = stored(anchors.withColumn("block", number("id")).groupBy("block").applyInArrow(one, f"block int, {_PACKED}"), "anchor-blocks")
    drop_stored(anchors)

    def meet(state: DataFrame | None) -> DataFrame:
        beside = anchor_blocks
        if state is not None:
            fields = ["anchor", "place", "positive", "positive_score", "low", "high", "shift"]
            windows = state.groupBy(number("anchor").alias("block")).agg(F.collect_list(F.struct(*(F.col(f).cast("bigint").alias(f) for f in fields))).alias("windows"))
            beside = anchor_blocks.join(windows, "block")
        return _meet(row_blocks, n_rows, beside, n_blocks, 8 * ((size["components"] or 0) + 9 * positives * size["n"]))

    best = _over(meet(None), _positives(positives), "anchor bigint, positive bigint, positive_score bigint")
    turn = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive"))
    first = best.withColumn("place", turn).filter(F.col("place") <= positives)
    score = F.col("positive_score")
    state = first.select("*", (-_floored(-score * least, 100)).alias("low"), _floored(score * most, 100).alias("high")).filter("low <= high")
    state = state.select("*", F.col("high").alias("most"), F.lit(negatives).cast("bigint").alias("need"), F.lit(False).alias("done")).withColumn("shift", _shift(F.col("high") - F.col("low")))
    state = stored(state, "windows")
    while not (open_windows := state.filter(~F.col("done"))).isEmpty():
        counts = _over(meet(open_windows), _digits, "anchor bigint, place bigint, digit bigint, n bigint")
        before, state = state, stored(state.filter("done").unionByName(_narrowed(open_windows, counts)), "windows")
        drop_stored(before)

    found = _over(meet(state.withColumn("high", F.col("most"))), _qualifying(negatives), "anchor bigint, place bigint, positive bigint, positive_score bigint, negative bigint, negative_score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative"))
    kept = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return kept.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score")
