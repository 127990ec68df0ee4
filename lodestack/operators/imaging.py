"""Pixel values: robust ranges, 8-bit scaling, sizes, blends and resampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import bound
from lodestack.operators.quantiles import exact_percentiles, finite

#: Percentiles of the robust range, the least span, and the largest sides for requests and for training.
LOW, HIGH, LEAST_SPAN = 0.01, 0.99, 1e-6
REQUEST_SIDE, TRAINING_SIDE = 1280, 512
#: Opacity and threshold of an overlay.
ALPHA, THRESHOLD = 0.45, 0.5
#: Numbers that with_upsampled() makes at a time.
PIECE = 1 << 18


def robust_range(pixels: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """(by, low, high, median, smallest, largest) of finite values, exact percentiles with linear interpolation, found from counts alone (quantiles.py)."""
    q = F.col("quantiles")
    found = exact_percentiles(pixels, by, (LOW, 0.5, HIGH), value)
    return found.select(*by, q[0].alias("low"), q[1].alias("median"), q[2].alias("high"), "smallest", "largest")


def _bytes(value: Column, low: Column, span: Column) -> Column:
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / span)) * 255.0).cast("int")


def scaled_volume(pixels: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """pixels with `byte`, 0 to 255 over the robust range of their section; a section without range is 0."""
    joined = pixels.join(robust_range(pixels, by, value), list(by))
    out = F.when(F.col("high") <= F.col("low"), F.lit(0)).otherwise(_bytes(F.col(value).cast("double"), F.col("low"), F.col("high") - F.col("low")))
    return joined.withColumn("byte", out).drop("low", "median", "high", "smallest", "largest")


def scaled_image(pixels: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """pixels with `byte` and `error`: values that are not finite become the median; a narrow range becomes the full one; without finite values there is an error."""
    joined = pixels.join(robust_range(pixels, by, value), list(by))
    narrow = F.col("high") - F.col("low") < LEAST_SPAN
    low, high = F.when(narrow, F.col("smallest")).otherwise(F.col("low")), F.when(narrow, F.col("largest")).otherwise(F.col("high"))
    known = F.coalesce(finite(F.col(value)), F.col("median"))
    out = _bytes(known, low, F.greatest(high - low, F.lit(LEAST_SPAN)))
    error = F.when(F.col("median").isNull(), F.lit("no finite pixels"))
    return joined.withColumn("byte", out).withColumn("error", error).drop("low", "median", "high", "smallest", "largest")


def request_size(width: Column, height: Column, most: int = REQUEST_SIDE) -> Column:
    """struct(width, height) with the longer side `most` at most; decimals are cut, 1 at least."""
    longest = F.greatest(width, height)
    scale = F.lit(float(most)) / longest
    return F.struct(*(F.when(longest <= most, v).otherwise(F.greatest(F.lit(1), F.floor(v * scale))).cast("bigint").alias(n) for v, n in ((width, "width"), (height, "height"))))


def training_size(width: Column, height: Column, most: int | None = TRAINING_SIDE) -> Column:
    """struct(width, height) with the longer side `most` at most; halves go to the even number, 1 at least. None or 0: as they are."""
    longest = F.greatest(width, height)

    def side(v: Column) -> Column:
        return v if not most or most <= 0 else F.when(longest <= most, v).otherwise(F.greatest(F.lit(1), F.rint(v * (F.lit(float(most)) / longest))))

    return F.struct(*(side(v).cast("bigint").alias(n) for v, n in ((width, "width"), (height, "height"))))


def grey(probability: Column) -> Column:
    """A probability as a grey value 0 to 255, decimals cut."""
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), probability.cast("double"))) * 255.0).cast("int")


def overlaid(pixel: Column, probability: Column, color: Column, alpha: float = ALPHA, threshold: float = THRESHOLD) -> Column:
    """A pixel channel under an overlay: blended by the mask's grey value; from the threshold on, 0.65 of that and 0.35 of the colour."""

    def shown(mask: Column) -> Column:
        strength = mask * alpha
        blended = pixel * (F.lit(1.0) - strength) + color * strength
        stressed = F.when(mask >= threshold, blended * 0.65 + color * 0.35).otherwise(blended)
        return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), stressed))).cast("int")

    return bound(grey(probability) / F.lit(255.0), shown)


def section_bytes(values: Column) -> Column:
    """An array's finite values scaled to 0..255 over their robust range, as scaled_volume() does for pixel rows; no shuffle, as a section is one row."""

    def scaled(own: Column) -> Column:
        def quantile(p: float) -> Column:
            at = (F.size(own) - 1) * F.lit(p)
            low, high = F.get(own, F.floor(at).cast("int")), F.get(own, F.ceil(at).cast("int"))
            return low + (high - low) * (at - F.floor(at))

        span = F.struct(quantile(LOW).alias("low"), quantile(HIGH).alias("high"))
        return bound(span, lambda r: F.transform(values, lambda v: F.when(r["high"] <= r["low"], F.lit(0)).otherwise(_bytes(v.cast("double"), r["low"], r["high"] - r["low"]))))

    return bound(F.array_sort(F.filter(F.transform(values, finite), lambda v: v.isNotNull())), scaled)


def bilinear(grid: np.ndarray, size: int) -> np.ndarray:
    """A square grid (or many, along further axes) resampled to size by size; cell centres are aligned, not corners."""
    n, more = grid.shape[0], (1,) * (grid.ndim - 2)
    at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    high, part = np.minimum(low + 1, n - 1), at - low
    down, across = part.reshape(-1, 1, *more), part.reshape(1, -1, *more)
    rows = grid[low] * (1 - down) + grid[high] * down
    return rows[:, low] * (1 - across) + rows[:, high] * across


def _resampled(values: pa.Array, size: int) -> np.ndarray:
    """A row of size * size numbers for each array of scores (null: none); arrays of one length are resampled together."""
    out = np.empty((len(values), size * size))
    lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        some = np.flatnonzero(lengths == n)
        side = max(1, int(np.ceil(np.sqrt(n))))
        grid = np.zeros((len(some), side * side))
        if n:
            grid[:, :n] = values.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), n)
        out[some] = bilinear(np.moveaxis(grid.reshape(-1, side, side), 0, -1), size).reshape(size * size, -1).T
    return out


def with_upsampled(rows: DataFrame, tokens: str, into: str, size: int = 32) -> DataFrame:
    """rows with a column `into`: scores of tokens on the smallest square that holds them, the rest 0, resampled to size by size.

    In Arrow batches that are handled and given back in pieces of about PIECE numbers (or one row), so that memory depends neither on the rows of a batch nor on the input.
    """
    rows = rows.withColumn(tokens, F.col(tokens).cast("array<double>"))
    schema = rows.drop(into).withColumn(into, F.lit(None).cast("array<double>")).schema
    names, step = schema.names, max(1, PIECE // (size * size))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, step) for b in batches for k in range(0, b.num_rows, step)):
            found = _resampled(batch.column(tokens), size)
            column = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * (size * size), pa.array(found.ravel(), from_pandas=True))  # not a number: null, as from a UDF
            yield pa.RecordBatch.from_arrays([column if n == into else batch.column(n) for n in names], names)

    return rows.drop(into).mapInArrow(of, schema)


def upsampled(tokens: Column, size: int = 32) -> Column:
    """As with_upsampled(), as a column (a vectorised UDF); it holds a whole batch of results, so for many rows or large sizes take with_upsampled()."""

    @F.pandas_udf("array<double>")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series(list(_resampled(pa.array(values, pa.list_(pa.float64())), size)))

    return of(tokens)


def token_dropout(tokens: DataFrame, row: str, position: str, drop_rate: float = 0.75, seed: int = 42) -> DataFrame:
    """Tokens kept with probability 1 - drop_rate by a hash of row and position, one at least of each row: that with the smallest hash."""
    share = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), row, position)), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    keep = max(1e-4, 1.0 - drop_rate)
    least = tokens.groupBy(row).agg(F.min(F.struct(share.alias("s"), F.col(position).alias("p"))).alias("_least"))
    joined = tokens.join(least, row)
    return joined.filter((share < keep) | (F.col(position) == F.col("_least.p"))).drop("_least")
