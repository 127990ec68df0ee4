"""Document fingerprints: SimHash of 128 bits, and a search within a Hamming radius by permuted block tables."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import WORD, stored

#: Differing bits up to which fingerprints are near.
RADIUS = 3
#: The 128 bits are cut into six blocks (first bit, bits). Three differing bits leave three blocks
#: at least untouched, so one of the 20 tables, each led by three blocks, has both fingerprints in one place.
BLOCKS = ((0, 22), (22, 21), (43, 21), (64, 22), (86, 21), (107, 21))
#: Rows that an order by id deals into one block, about, and blocks at most.
ORDER_ROWS, ORDER_BLOCKS, CELLS = 1_000, 65_536, 2_048
LANES = (1 << 32) + 1


def terms(text: Column) -> Column:
    """Pairs of neighbouring lower-cased words, (word, next); the last word stands alone. Repeats count again."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.arrays_zip(words.alias("word"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("next"))


def votes(word: Column, following: Column) -> list[Column]:
    """Sums that hold the vote on every bit: two 32-bit lanes in each of 64 long integers, and the sum of weights.

    A term weighs more the longer its words are, as long words are rare.
    """
    size = F.length(F.coalesce(word, F.lit(""))) + F.length(F.coalesce(following, F.lit("")))
    weight = F.when(word.isNull(), F.lit(0)).otherwise(F.least(F.lit(8), F.lit(1) + F.floor(size / 3))).cast("bigint")
    hashes = [F.xxhash64(word, following), F.xxhash64(F.lit(7), word, following)]
    sums = [F.sum(F.shiftright(h, i).bitwiseAND(F.lit(LANES)) * weight).alias(f"v{k}_{i}") for k, h in enumerate(hashes) for i in range(32)]
    return [F.sum(weight).alias("weight"), *sums]


def bits(k: int) -> Column:
    """64 bits from the sums v{k}_0 to v{k}_31: a bit is 1 if the votes for it outweigh those against."""
    out = F.lit(0).cast("bigint")
    for i in range(32):
        low, high = F.col(f"v{k}_{i}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"v{k}_{i}", 32)
        for votes_for, bit in ((low, i), (high, i + 32)):
            out = out.bitwiseOR(F.when(2 * votes_for > F.col("weight"), F.shiftleft(F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint")))
    return out


def differing(a: str, b: str, c: str, d: str) -> Column:
    """Bits that differ between the fingerprints (a, b) and (c, d)."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(c))) + F.bit_count(F.col(b).bitwiseXOR(F.col(d)))


def likeness(distance: Column) -> Column:
    """The cosine of the term vectors that the number of differing bits tells, 0 at least."""
    return F.greatest(F.lit(0.0), F.cos(distance * F.lit(math.pi / 128)))


def hexed(a: str, b: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _order_block(rows: DataFrame) -> tuple[Column, int]:
    """A block number that grows as _id falls, from quantiles of _id; null ids come last. Blocks hold about equally many rows."""
    n = rows.agg(F.count(F.lit(1))).first()[0]
    blocks = min(ORDER_BLOCKS, max(1, math.ceil(n / ORDER_ROWS)))
    cells = min(CELLS, blocks)
    parts = math.ceil(blocks / cells)
    fractions = [k / cells for k in range(cells + 1)]
    found = rows.agg(F.percentile_approx("_id", fractions, max(10_000, 20 * cells))).first()[0] or [0]
    bounds = sorted(set(found), reverse=True)
    array = F.array(*[F.lit(b) for b in bounds])
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]

    def further(at: Column, step: Column) -> Column:  # bounds >= _id, by halving
        return F.when((at + step <= len(bounds)) & (F.get(array, at + step - 1) >= F.col("_id")), at + step).otherwise(at)

    cell = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)
    above, below = F.get(array, cell - 1), F.coalesce(F.get(array, cell), F.get(array, cell - 1))
    inside = F.when(above > below, F.least(F.lit(parts - 1), F.floor((above - F.col("_id")) / (above - below) * parts))).otherwise(0)
    block = cell * parts + F.coalesce(inside, F.lit(0))
    return F.when(F.col("_id").isNull(), F.lit((len(bounds) + 1) * parts)).otherwise(block).cast("int"), parts


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_chars, edited_sha256, own fingerprint (a, b), that of its edited text (ea, eb), and of the next row (na, nb).

    Rows are in descending order of id; after the last comes the first. The edited text is the row's own with its last half replaced by the
    beginning of the next row's. One shuffle moves each text once, to its block of the order; the first row of a block is also sent to the block before it, where
    it ends the order and is dropped afterwards. Everything else (the split into terms, the votes, the neighbours) happens in that partitioning.
    The driver holds one id a block, ORDER_BLOCKS at most; these are broadcast.

    A null text counts as empty, and its fingerprint is 0; null ids come last; rows that share an id are ordered by their texts; a lone row
    is its own next; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    block, _ = _order_block(rows.select("_id"))
    heads = rows.select("_id", block.alias("_block")).groupBy("_block").agg(F.max("_id").alias("head")).orderBy("_block").collect()
    kind = rows.schema["_id"].dataType.simpleString()
    before = [(r["head"], heads[k - 1]["_block"]) for k, r in enumerate(heads)]
    before = docs.sparkSession.createDataFrame(before, f"_head {kind}, _before int")
    placed = rows.join(F.broadcast(before), F.col("_id").eqNullSafe(F.col("_head")), "left")
    own = F.struct(block.alias("block"), F.lit(0).alias("ends"))
    # joined by id: where ids repeat, every one of them ends the block before, and the first of them counts
    ending = F.struct(F.col("_before").alias("block"), F.lit(1).alias("ends"))
    at = F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, ending)))
    dealt = placed.select("_id", "_text", at.alias("at")).select(F.col("at.block").alias("_block"), F.col("at.ends").alias("_ends"), "_id", "_text")
    order = Window.partitionBy("_block").orderBy("_ends", F.desc_nulls_last("_id"), "_text")
    half = F.expr("length(_text) div 2").cast("int")
    edited = F.concat(F.expr("substring(_text, 1, length(_text) - cast(length(_text) div 2 as int))"), F.substring(F.col("_next"), F.lit(1), half))
    texts = (
        dealt.withColumn("_row", F.row_number().over(order))
        .withColumn("_next", F.coalesce(F.lead("_text").over(order), F.lit("")))
        .withColumn("_edited", edited)
        .select(
            "_block", "_row", "_ends", "_id", F.length("_text").cast("bigint").alias("n_chars"), F.unhex(F.sha2("_edited", 256)).alias("_sha"),
            F.posexplode(F.array("_text", "_edited")).alias("_which", "_of"),
        )
    )
    key = ["_block", "_row", "_ends", "_id", "n_chars", "_sha"]
    spread = texts.select(*key, "_which", F.explode_outer(terms(F.col("_of"))).alias("t"))
    summed = spread.groupBy(*key, "_which").agg(*votes(F.col("t.word"), F.col("t.next")))
    fps = summed.select(*key, "_which", bits(0).alias("x"), bits(1).alias("y"))
    own_and_edited = fps.groupBy(*key).agg(
        *(F.max(F.when(F.col("_which") == w, F.col(c))).alias(n) for w, c, n in ((0, "x", "a"), (0, "y", "b"), (1, "x", "ea"), (1, "y", "eb")))
    )
    again = Window.partitionBy("_block").orderBy("_row")
    full = own_and_edited.withColumn("na", F.lead("a").over(again)).withColumn("nb", F.lead("b").over(again)).filter("_ends = 0")
    return full.select(F.col("_id").alias(id_col), "n_chars", F.lower(F.hex("_sha")).alias("edited_sha256"), "a", "b", "ea", "eb", "na", "nb")


def _block_value(at: tuple[int, int], a: str, b: str) -> Column:
    first, n = at
    return F.shiftrightunsigned(a if first < 64 else b, first % 64).bitwiseAND(F.lit((1 << n) - 1))


def within_radius(queries: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Pairs of distinct fingerprints RADIUS bits apart or less: (qa, qb) of queries with (a, b) of fingerprints.

    queries and fingerprints have columns a and b. Both sides are reduced to distinct fingerprints and put in the 20 tables; an equality of the three leading
    blocks gives the candidates, each verified in the join itself, in the first table that holds both, so every pair comes once and nothing else leaves the join.
    """
    triples = list(itertools.combinations(range(len(BLOCKS)), 3))

    def tables(df: DataFrame, a: str, b: str) -> DataFrame:
        led = [F.struct(F.lit(t).alias("table"), *(_block_value(BLOCKS[k], a, b).alias(f"k{n}") for n, k in enumerate(own))) for t, own in enumerate(triples)]
        return df.select(a, b, F.explode(F.array(*led)).alias("at")).select(a, b, F.col("at.table").alias("table"), *(F.col(f"at.k{n}").alias(f"k{n}") for n in range(3)))

    left = tables(queries.select(F.col("a").alias("qa"), F.col("b").alias("qb")).distinct(), "qa", "qb")
    right = tables(fingerprints.select("a", "b").distinct(), "a", "b")
    same = [(_block_value(at, "qa", "qb") == _block_value(at, "a", "b")) for at in BLOCKS]
    first = F.coalesce(*(F.when(same[i] & same[j] & same[k], F.lit(t)) for t, (i, j, k) in enumerate(triples)))
    left = left.select("qa", "qb", *(F.col(c).alias(f"q_{c}") for c in ("table", "k0", "k1", "k2")))
    match = [F.col(f"q_{c}") == F.col(c) for c in ("table", "k0", "k1", "k2")]
    near = (differing("qa", "qb", "a", "b") <= RADIUS) & (first == F.col("table"))
    return left.join(right, [*match, near]).select("qa", "qb", "a", "b")


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", search: Column | None = None) -> DataFrame:
    """One row per input row: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_rows.

    Equal texts have equal fingerprints. near_rows counts the other rows within RADIUS bits, of all rows, where `search` holds; it is null elsewhere.
    Cases are defined as in fingerprints_with_next().
    """
    fps = stored(fingerprints_with_next(docs, id_col, text_col), "simhash")
    out = fps.select(
        id_col, "n_chars", "edited_sha256", hexed("a", "b").alias("fingerprint"), hexed("ea", "eb").alias("edited_fingerprint"),
        likeness(differing("a", "b", "ea", "eb")).alias("near_edited"), likeness(differing("a", "b", "na", "nb")).alias("near_next"), "a", "b",
    )
    if search is None:
        return out.drop("a", "b")
    asked = fps.filter(search)
    sizes = fps.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    pairs = within_radius(asked, sizes)
    counted = pairs.join(sizes, ["a", "b"]).groupBy("qa", "qb").agg((F.sum("n") - 1).alias("_near"))
    matched = out.withColumn("_asked", F.coalesce(search, F.lit(False))).join(counted, (F.col("a") == F.col("qa")) & (F.col("b") == F.col("qb")) & F.col("_asked"), "left")
    return matched.select(*out.drop("a", "b").columns, F.col("_near").alias("near_rows"))
