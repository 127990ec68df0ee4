"""Which points are inside which polygons: a join by grid cells, with the exact test only where an edge may pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.operators.raster import EPSILON

#: Edges flatter than this are tested exactly all along their rows of cells; others cross a level within this share of their width beside them.
FLAT, MARGIN = 1e-3, 1e-2
#: Places of a cell that are tested together, and pairs of a place and an edge that a worker holds at once; a polygon of more edges makes more.
TOGETHER, PAIRS = 256, 1_000_000


def _edges(outline: Column) -> Column:
    """array<struct<x, y, px, py>>: each vertex and the one before it, the last before the first."""

    def edge(p: Column, k: Column) -> Column:
        q = F.get(outline, F.when(k == 0, F.size(outline)).otherwise(k) - 1)
        return F.struct(*(v.cast("double").alias(n) for v, n in ((p["x"], "x"), (p["y"], "y"), (q["x"], "px"), (q["y"], "py"))))

    return F.transform(outline, edge)


def _odd(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule, as raster.contains(): whether the ray from (x, y) to the right crosses an odd number of edges."""
    at = lambda e: (e["px"] - e["x"]) * (y - e["y"]) / (e["py"] - e["y"] + EPSILON) + e["x"]
    return F.size(F.filter(edges, lambda e: ((e["y"] > y) != (e["py"] > y)) & (x < at(e)))) % 2 == 1


def polygon_cover(polygons: DataFrame, cell: float, outline: str = "outline") -> DataFrame:
    """polygons without outline, with (cx, cy, edges): a row of each cell that a polygon meets. edges is null for a cell wholly inside, else the edges that decide there.

    Cells of the bounding box are made, so `cell` should be of about the size of a polygon, or of a part of it that holds few edges.
    """
    rest = [c for c in polygons.columns if c != outline]
    size, margin = F.lit(float(cell)), F.lit(MARGIN)
    xs, ys = (F.transform(F.col(outline)[n], lambda v: v.cast("double")) for n in ("x", "y"))
    number = lambda v: F.floor(v / size)
    rows = polygons.filter(F.size(outline) >= 3).select(*rest, _edges(F.col(outline)).alias("_edges"), number(F.array_min(xs)).alias("_x0"), number(F.array_max(xs)).alias("_x1"), F.explode(F.sequence(number(F.array_min(ys)), number(F.array_max(ys)))).alias("cy"))
    low, high = F.col("cy") * size, (F.col("cy") + 1) * size
    # an edge outside the row's levels is crossed by none of its rays
    of_row = F.filter("_edges", lambda e: (F.least(e["y"], e["py"]) <= high) & (F.greatest(e["y"], e["py"]) >= low))
    cells = rows.select(*rest, "cy", of_row.alias("_edges"), F.explode(F.sequence("_x0", "_x1")).alias("cx"))
    left, right = F.col("cx") * size, (F.col("cx") + 1) * size
    wide = lambda e: F.abs(e["x"] - e["px"]) * margin
    flat = lambda e: F.abs(e["y"] - e["py"]) < FLAT
    near = F.exists("_edges", lambda e: flat(e) | ((F.least(e["x"], e["px"]) - wide(e) <= right) & (F.greatest(e["x"], e["px"]) + wide(e) >= left)))
    beside = F.filter("_edges", lambda e: flat(e) | (F.greatest(e["x"], e["px"]) + wide(e) >= left))
    inside = _odd(F.col("_edges"), (left + right) / 2, (low + high) / 2)
    return cells.select(*rest, "cx", "cy", near.alias("_near"), F.when(near, beside).alias("edges"), inside.alias("_inside")).filter("_near or _inside").drop("_near", "_inside")


def _batches_of_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cx, cy, _x, _y), of a cell side by side, as rows (cx, cy, _xs, _ys) of at most TOGETHER places."""
    for batch in batches:
        cx, cy, xs, ys = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        n = len(cx)
        if not n:
            continue
        new = np.append(True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1]))
        starts = np.flatnonzero(new)
        since = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        starts = np.flatnonzero(since % TOGETHER == 0)
        offsets = pa.array(np.append(starts, n).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (xs, ys)]
        yield pa.RecordBatch.from_arrays([pa.array(cx[starts]), pa.array(cy[starts]), *lists], ["cx", "cy", "_xs", "_ys"])


def _odd_together(edges: tuple[np.ndarray, ...], starts: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """_odd() of each run of edges (x, y, px, py), none empty, that begins at starts, for each place: bool (runs, places). As in Spark, NaN is above all numbers."""
    x, y, px, py = (v[:, None] for v in edges)
    with np.errstate(all="ignore"):
        at = (px - x) * (ys - y) / (py - y + EPSILON) + x
        crossed = (~(y <= ys) != ~(py <= ys)) & ~(xs >= at)
    return np.bitwise_xor.reduceat(crossed.view(np.uint8), starts).view(bool)


def _polygons_of_places(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (edges, _xs, _ys, names) as rows (_x, _y, names): places that polygons contain, and lists of these polygons' columns. A place has a row for each PAIRS or less."""

    def lists(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(values.offsets.to_numpy())
        return values.offsets.to_numpy()[:-1], np.where(values.is_valid().to_numpy(zero_copy_only=False), sizes, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            edges, xs, ys = batch.column("edges"), batch.column("_xs"), batch.column("_ys")
            whole = edges.is_null().to_numpy(zero_copy_only=False)
            first, count = lists(edges)
            own = tuple(edges.values.field(n).to_numpy(zero_copy_only=False) for n in ("x", "y", "px", "py"))
            (x_from, places), (y_from, _) = lists(xs), lists(ys)
            xs, ys = (v.values.to_numpy(zero_copy_only=False) for v in (xs, ys))
            # places are distinct, so the first one tells which rows have the same places
            order = np.lexsort((ys[y_from], xs[x_from]))
            x0, y0 = xs[x_from][order], ys[y_from][order]
            ends = np.flatnonzero(np.append((x0[1:] != x0[:-1]) | (y0[1:] != y0[:-1]), True)) + 1
            weight = np.cumsum(np.maximum(count[order], 1) * places[order])
            begin = 0
            while begin < len(order):
                heavy = np.searchsorted(weight, (weight[begin - 1] if begin else 0) + PAIRS, "right")
                end = max(begin + 1, min(int(heavy), int(ends[np.searchsorted(ends, begin, "right")])))
                rows, begin = order[begin:end], end
                k, n = rows[0], int(places[rows[0]])
                px, py = xs[x_from[k] : x_from[k] + n], ys[y_from[k] : y_from[k] + n]
                inside = np.repeat(whole[rows][:, None], n, 1)
                some = np.flatnonzero(count[rows] > 0)
                if len(some):
                    c = count[rows[some]]
                    starts = np.cumsum(c) - c
                    at = np.repeat(first[rows[some]] - starts, c) + np.arange(c.sum())
                    inside[some] |= _odd_together(tuple(v[at] for v in own), starts, px, py)
                place, polygon = np.nonzero(inside.T)
                if len(place):
                    held, at = np.unique(place, return_index=True)
                    offsets, taken = pa.array(np.append(at, len(place)).astype(np.int32)), pa.array(rows[polygon])
                    found = [pa.ListArray.from_arrays(offsets, batch.column(c).take(taken)) for c in names]
                    yield pa.RecordBatch.from_arrays([pa.array(px[held]), pa.array(py[held]), *found], ["_x", "_y", *names])

    return run


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float, x: str = "x", y: str = "y", outline: str = "outline") -> DataFrame:
    """points with the columns of each polygon (outline array<struct<x, y>>, and others whose names points lack) that contains them by the even-odd rule.

    Places (distinct x, y) and polygons meet by equality of grid cells; there is no nested loop, and a place meets only the polygons of its own cell. Places of a cell are tested together, TOGETHER at most.
    Where a polygon covers a cell whole no test is made. Points get the lists of their place's polygons by equality, so points that share a place cost no tests of their own. Both joins are by shuffles:
    the planner takes a cover for no larger than its polygons, and would broadcast it by way of the driver's memory. A cell is one key, so one with many distinct places is tested by one task
    unless it is large enough for adaptive execution to split; smaller cells split it. Points without coordinates (null or NaN) and polygons of fewer than three vertices contain nothing; repeated rows of either side give repeated rows.
    """
    of = lambda c: F.floor(F.col(c) / F.lit(float(cell)))
    names = [c for c in polygons.columns if c != outline]
    if not names:
        polygons, names = polygons.withColumn("_own", F.lit(True)), ["_own"]
    places = points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x is not null and _y is not null and not isnan(_x) and not isnan(_y)").distinct()
    dealt = places.select(of("_x").alias("cx"), of("_y").alias("cy"), "_x", "_y").hint("rebalance", F.col("cx"), F.col("cy")).sortWithinPartitions("cx", "cy")
    together = dealt.mapInArrow(_batches_of_places, "cx bigint, cy bigint, _xs array<double>, _ys array<double>")
    # a table of few bytes is one task, however many cells its polygons cover
    cover = polygon_cover(polygons.repartition(polygons.sparkSession.sparkContext.defaultParallelism), cell, outline)
    met = cover.join(together.hint("merge"), ["cx", "cy"]).select("edges", "_xs", "_ys", *names)
    lists = T.StructType([T.StructField("_x", T.DoubleType()), T.StructField("_y", T.DoubleType()), *(T.StructField(c, T.ArrayType(met.schema[c].dataType)) for c in names)])
    found = met.mapInArrow(_polygons_of_places(names), lists)
    held = points.join(found.hint("merge"), (F.col(x).cast("double") == F.col("_x")) & (F.col(y).cast("double") == F.col("_y")))
    if len(names) == 1:
        return held.select(*points.columns, F.explode(names[0]).alias(names[0])).drop("_own")
    one = held.select(*points.columns, *names[1:], F.posexplode(names[0]).alias("_at", names[0]))
    return one.select(*points.columns, names[0], *(F.get(c, F.col("_at")).alias(c) for c in names[1:]))
