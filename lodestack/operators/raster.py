"""Polygons and boxes on a square grid, as array expressions or as cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import bound, fixed, rounded, strip

GRID = 32
#: Keeps the slope of a level edge finite.
EPSILON = 1e-6
#: Points of a sampled outline at most.
OUTLINE_POINTS = 16


def on_grid(value: Column, extent: Column | float, size: int = GRID) -> Column:
    """A coordinate in 0..extent as a cell 0..size-1, halves to the even cell."""
    return F.least(F.lit(size - 1), F.greatest(F.lit(0), F.rint(value / extent * F.lit(float(size - 1))).cast("int")))


def points_of_label(line: Column, size: int = GRID) -> Column:
    """Grid points of a label line `class x1 y1 x2 y2 ...`; null for fewer than three points. An odd last number is left out."""

    def points(parts: Column) -> Column:
        def point(k: Column) -> Column:
            return F.struct(*(on_grid(F.get(parts, 2 * k + at).cast("double"), 1.0, size).alias(n) for at, n in ((1, "x"), (2, "y"))))

        return F.when(F.size(parts) >= 7, F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / 2).cast("int") - 1), point))

    return bound(F.split(strip(line), r"\s+"), points)


def points_of_polygon(polygon: Column, width: Column, height: Column, size: int = GRID) -> Column:
    """Grid points of pixel coordinates [[x, y], ...]; null for fewer than three."""
    moved = F.transform(polygon, lambda p: F.struct(on_grid(p[0], width, size).alias("x"), on_grid(p[1], height, size).alias("y")))
    return F.when(F.size(polygon) >= 3, moved)


def crossings(points: Column, y: Column) -> Column:
    """Where the edges of an outline cross the level y, as an array of x."""

    def at(a: Column, k: Column) -> Column:
        b = F.get(points, F.when(k == 0, F.size(points)).otherwise(k) - 1)
        x = (b["x"] - a["x"]).cast("double") * (y - a["y"]) / ((b["y"] - a["y"]).cast("double") + EPSILON) + a["x"]
        return F.when((a["y"] > y) != (b["y"] > y), x)

    return F.array_compact(F.transform(points, at))


def contains(points: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: whether a ray from (x, y) crosses the outline an odd number of times."""
    return F.size(F.filter(crossings(points, y), lambda at: x < at)) % 2 == 1


def polygon_cells(points: Column) -> Column:
    """Cells whose centre is inside an outline, as array<struct<y, x>>; only its bounding box is searched, and edges are crossed once for each row of cells."""

    def cells(own: Column) -> Column:
        def span(axis: str) -> Column:
            values = F.transform(own, lambda p: p[axis])
            return F.sequence(F.array_min(values), F.array_max(values))

        def row(y: Column) -> Column:
            def inside(at: Column) -> Column:
                odd = F.filter(span("x"), lambda x: F.size(F.filter(at, lambda v: x + 0.5 < v)) % 2 == 1)
                return F.transform(odd, lambda x: F.struct(y.alias("y"), x.alias("x")))

            return bound(crossings(own, y + 0.5), lambda at: F.when(F.size(at) > 0, inside(at)).otherwise(F.expr("cast(array() as array<struct<y:int,x:int>>)")))

        return F.flatten(F.transform(span("y"), row))

    return bound(points, cells)


def box_cells(box: Column, width: Column, height: Column, size: int = GRID) -> Column:
    """Cells of a box [x1, y1, x2, y2] with its edges, as array<struct<y, x>>; null unless it has four numbers."""
    x1, x2 = on_grid(box[0], width, size), on_grid(box[2], width, size)
    y1, y2 = on_grid(box[1], height, size), on_grid(box[3], height, size)
    xs, ys = F.sequence(F.least(x1, x2), F.greatest(x1, x2)), F.sequence(F.least(y1, y2), F.greatest(y1, y2))
    cells = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("y"), x.alias("x")))))
    return F.when(F.size(box) == 4, cells)


def detection_cells(detections: Column, width: Column, height: Column, size: int = GRID) -> Column:
    """Distinct cells of all detections: the outline of each where it has one of three points or more, else its box."""
    empty = F.expr("cast(array() as array<struct<y:int,x:int>>)")

    def cells(d: Column) -> Column:
        outline = polygon_cells(points_of_polygon(d["polygon_xy_sample"], width, height, size))
        return F.coalesce(F.when(F.size(d["polygon_xy_sample"]) >= 3, outline).otherwise(box_cells(d["box_xyxy"], width, height, size)), empty)

    # as numbers, which are told apart by hashing; structs would all be compared with each other
    places = F.array_distinct(F.flatten(F.transform(F.coalesce(detections, F.array()), lambda d: F.transform(cells(d), lambda c: c["y"] * size + c["x"]))))
    found = F.transform(places, lambda p: F.struct(F.floor(p / size).cast("int").alias("y"), (p % size).cast("int").alias("x")))
    return F.when((width > 0) & (height > 0), found).otherwise(empty)


def mask(cells: Column, size: int = GRID) -> Column:
    """size * size numbers, 1 where a cell is set, row by row: runs of zeros between the set places, so the time is linear."""

    def zeros(n: Column) -> Column:
        return F.array_repeat(F.lit(0.0).cast("float"), n.cast("int"))

    def filled(own: Column) -> Column:
        one = F.array(F.lit(1.0).cast("float"))
        runs = F.transform(own, lambda p, i: F.concat(zeros(p - F.coalesce(F.get(own, i - 1), F.lit(-1)) - 1), one))
        return F.concat(F.flatten(runs), zeros(F.lit(size * size - 1) - F.coalesce(F.get(own, F.size(own) - 1), F.lit(-1))))

    return bound(F.array_sort(F.array_distinct(F.transform(cells, lambda c: c["y"] * size + c["x"]))), filled)


def coverage(cells: Column, size: int = GRID) -> Column:
    return rounded(F.size(cells) / F.lit(float(size * size)), 6)


def sampled_outline(polygon: Column, most: int = OUTLINE_POINTS) -> Column:
    """Every n-th point so that about `most` are left, the first `most` of them, with two decimals."""
    step = F.greatest(F.floor(F.size(polygon) / most).cast("int"), F.lit(1))
    some = F.slice(F.filter(polygon, lambda p, k: k % step == 0), 1, most)
    return F.transform(some, lambda p: F.transform(p, lambda v: rounded(v, 2)))


def normalized_label(points: Column, width: Column, height: Column) -> Column:
    """A label line of an outline in pixels: class 0 and coordinates clamped to 0..1 with six decimals."""
    def clamp(v: Column, extent: Column) -> Column:
        return fixed(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / extent)), 6)

    numbers = F.flatten(F.transform(points, lambda p: F.array(clamp(p[0], width), clamp(p[1], height))))
    return F.when(F.size(points) >= 3, F.concat(F.lit("0 "), F.array_join(numbers, " ")))


def detection_rows(boxes: Column, scores: Column, classes: Column, names: Column, coverages: Column, outlines: Column, least: float = 0.0) -> Column:
    """Detections from parallel arrays, of scores from `least` on; masks and outlines may be shorter. A class without a name is a fault."""

    def made(z: Column) -> Column:
        return F.struct(
            F.coalesce(F.try_element_at(names, z["c"]), F.lit("fault")).alias("label"), rounded(z["s"], 4).alias("confidence"),
            F.transform(z["b"], lambda v: rounded(v, 2)).alias("box_xyxy"), rounded(z["m"], 6).alias("mask_coverage"),
            F.when(F.size(z["o"]) > 0, sampled_outline(z["o"])).alias("polygon_xy_sample"),
        )

    n = F.least(F.size(boxes), F.size(scores))
    zipped = F.arrays_zip(boxes.alias("b"), scores.alias("s"), classes.alias("c"), coverages.alias("m"), outlines.alias("o"))
    return F.transform(F.filter(F.slice(zipped, F.lit(1), n), lambda z: z["s"] >= least), made)


def presence(masks: DataFrame, by: str, value: str = "v") -> DataFrame:
    return masks.groupBy(by).agg((F.max(value) > 0.5).alias("present"), F.avg(value).alias("coverage"))


def mask_summary(values: Column) -> Column:
    """struct(present, coverage) of a mask in one row, without a shuffle."""
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.struct((F.coalesce(F.array_max(values), F.lit(0.0)) > 0.5).alias("present"), (total / F.size(values)).alias("coverage"))


def confident(detections: Column, least: float) -> Column:
    """Detections from a confidence on."""
    return F.filter(detections, lambda d: d["confidence"] >= least)


def label_mask(lines: Column, size: int = GRID) -> Column:
    """The mask of a label file's lines (an array of texts); lines of fewer than three points count for nothing."""
    empty = F.expr("cast(array() as array<struct<y:int,x:int>>)")
    cells = F.transform(lines, lambda line: F.coalesce(bound(points_of_label(line, size), lambda p: F.when(p.isNotNull(), polygon_cells(p))), empty))
    return mask(F.flatten(F.coalesce(cells, F.array(empty))), size)


def target(
    label_path: Column, label_lines: Column, label_values: Column, detections: Column, width: Column, height: Column, allow_pseudo: bool = False, size: int = GRID
) -> Column:
    """struct(mask, present, valid, source): of a label file (.txt: its lines, else its mask), of detections if these may stand in, or an empty mask that does not count."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size * size)

    def made(values: Column, present: Column, valid: float, source: str) -> Column:
        return F.struct(values.alias("mask"), present.cast("double").alias("present"), F.lit(valid).alias("valid"), F.lit(source).alias("source"))

    real = F.when(F.lower(label_path).endswith(".txt"), label_mask(label_lines, size)).otherwise(F.coalesce(label_values, zeros))
    own = F.when(label_path.isNotNull(), bound(real, lambda m: made(m, F.array_max(m) > 0.5, 1.0, "real")))
    if allow_pseudo:
        pseudo = mask(detection_cells(detections, width, height, size), size)
        return own.otherwise(made(pseudo, F.coalesce(F.size(detections), F.lit(0)) > 0, 1.0, "pseudo"))
    return own.otherwise(made(zeros, F.lit(0.0), 0.0, "missing"))
