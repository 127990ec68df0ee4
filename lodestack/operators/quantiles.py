"""Exact percentiles of groups of any size: ranks are found digit by digit, from counts alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.session import drop_written, written

#: Bits of a digit: a group has 65,536 counts a round at most, and four rounds tell a 64-bit number.
DIGIT = 16
#: States of ranks up to which they are broadcast to the values; more are joined by a shuffle.
MOST_SENT = 100_000


def finite(value: Column) -> Column:
    """value, or null if it is no finite number."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def ordered_bits(value: Column) -> Column:
    """The 64 bits of a double, so changed that unsigned order is the order of numbers; the two zeros are one."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    # numbers below zero are all turned over, the others in their sign
    return bits.bitwiseXOR(F.when(bits < 0, F.lit(-1)).otherwise(F.lit(-(1 << 63))).cast("bigint"))


def ranked_values(rows: DataFrame, by: Sequence[str], ranks: DataFrame, value: str = "value", digit: int = DIGIT) -> DataFrame:
    """(by, rank, found): the value of each rank, from 0 in ascending order, among a group's finite values. ranks: (by, rank), each within its group.

    In each round the values that share the bits known so far are counted by their next digit, in the map tasks first, and running sums tell the digit of each rank.
    A rank is found once all values that it may have are equal. Only counts are shuffled, neither values nor groups, and no task holds a group; values are read
    once a round, 64 / digit times at most. States of more than MOST_SENT ranks are joined to the values by a shuffle instead of a broadcast.
    """
    own = rows.select(*by, finite(F.col(value)).alias("_v")).filter(F.col("_v").isNotNull()).withColumn("_bits", ordered_bits(F.col("_v")))
    state = ranks.select(*by, "rank", F.lit(0).cast("bigint").alias("_prefix"), F.col("rank").alias("_need"), F.lit(None).cast("double").alias("found"))
    key = [*by, "_prefix"]
    for shift in range(64 - digit, -digit, -digit):
        shift, width = max(shift, 0), min(digit, digit + shift)
        opened = state.filter("found is null")
        if shift + width < 64:
            cells = opened.select(*key).distinct()
            cells = F.broadcast(cells) if cells.limit(MOST_SENT + 1).count() <= MOST_SENT else cells
            within = own.withColumn("_prefix", F.shiftrightunsigned("_bits", shift + width)).join(cells, key, "left_semi")
        else:
            within = own.withColumn("_prefix", F.lit(0).cast("bigint"))
        digits = within.withColumn("_digit", F.shiftrightunsigned("_bits", shift).bitwiseAND(F.lit((1 << width) - 1)))
        counts = digits.groupBy(*key, "_digit").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        counts = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*key).orderBy("_digit")))
        told = opened.drop("found").join(counts, key).filter((F.col("_upto") > F.col("_need")) & (F.col("_upto") - F.col("_n") <= F.col("_need")))
        told = told.select(
            *by, "rank", F.shiftleft("_prefix", width).bitwiseOR(F.col("_digit")).alias("_prefix"), (F.col("_need") - (F.col("_upto") - F.col("_n"))).alias("_need"),
            F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("found"),
        )
        before, state = state, written(told.unionByName(state.filter("found is not null")), "ranks")
        if shift + width < 64:
            drop_written(before)
        if shift == 0 or state.filter("found is null").isEmpty():
            break
    return state.select(*by, "rank", "found")


def exact_percentiles(rows: DataFrame, by: Sequence[str], shares: Sequence[float], value: str = "value", digit: int = DIGIT) -> DataFrame:
    """(by, n, smallest, largest, quantiles) of each group's finite values: exact percentiles with linear interpolation, an array in order of shares.

    A group without finite values has n 0 and nulls. Nulls in `by` are a group of their own.
    """
    v = finite(F.col(value))
    sizes = written(rows.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("smallest"), F.max(v).alias("largest")), "sizes")
    at = [(F.col("n") - 1) * F.lit(float(s)) for s in shares]
    wanted = F.array_distinct(F.array(*(f(a).cast("bigint") for a in at for f in (F.floor, F.ceil))))
    names = [f"_by{k}" for k in range(len(by))]  # no null among the keys, so that joins by equality do
    keyed = [F.struct(F.col(b).alias("k")).alias(n) for b, n in zip(by, names)]
    ranks = sizes.filter("n > 0").select(*keyed, F.explode(wanted).alias("rank"))
    found = ranked_values(rows.select(*keyed, F.col(value).alias("_value")), names, ranks, "_value", digit)
    lists = found.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "found"))).alias("_of"))
    joined = sizes.select("*", *keyed).join(lists, names, "left")

    def quantile(a: Column) -> Column:
        low, high = (F.try_element_at("_of", f(a).cast("bigint")) for f in (F.floor, F.ceil))
        return low + (high - low) * (a - F.floor(a))

    return joined.select(*by, "n", "smallest", "largest", F.array(*map(quantile, at)).alias("quantiles"))
