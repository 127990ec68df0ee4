"""Outlines of masks and containment by cells, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.operators import outlines as O
from lodestack.operators import raster as G
from lodestack.operators.containment import points_in_polygons


def regions(mask):
    """Pixels of each region, by flooding."""
    left, out = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask))}, []
    while left:
        todo, own = [min(left)], set()
        while todo:
            y, x = todo.pop()
            if (y, x) in left:
                left.discard((y, x))
                own.add((y, x))
                todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        out.append(own)
    return out


def outside(mask):
    """Background that is connected with the frame by sides."""
    padded, seen, todo = np.pad(mask, 1), set(), [(0, 0)]
    while todo:
        y, x = todo.pop()
        if (y, x) not in seen and 0 <= y < padded.shape[0] and 0 <= x < padded.shape[1] and not padded[y, x]:
            seen.add((y, x))
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return {(y - 1, x - 1) for y, x in seen}


def filled(points, shape):
    """Pixels on the closed line through the points, and those it encloses."""
    line = np.zeros(shape, bool)
    for (x, y), (u, v) in zip(points, np.roll(points, -1, 0)):
        n = max(abs(u - x), abs(v - y), 1)
        for k in range(n + 1):
            line[y + (v - y) * k // n if (v - y) % n == 0 else round(y + (v - y) * k / n), x + (u - x) * k // n if (u - x) % n == 0 else round(x + (u - x) * k / n)] = True
    out = outside(line)
    return np.array([[(y, x) not in out for x in range(shape[1])] for y in range(shape[0])])


def masks(n):
    draw = np.random.default_rng(4)
    for _ in range(n):
        h, w = draw.integers(1, 24, 2)
        m = draw.random((h, w)) < draw.choice([0.2, 0.5, 0.8])
        if draw.random() < 0.5 and min(h, w) > 6:  # larger shapes
            m = np.kron(draw.random((h // 3, w // 3)) < 0.5, np.ones((3, 3))).astype(bool)
        yield m


def test_regions_and_borders_like_flooding():
    for m in masks(150):
        own = regions(m)
        starts = O.first_pixels(m)
        assert starts == sorted(min(r) for r in own)
        for start, pixels in zip(starts, sorted(own, key=min)):
            one = np.zeros_like(m)
            one[tuple(np.array(sorted(pixels)).T)] = True
            out = outside(one)
            seen = {p for p in pixels if any(q in out or not (0 <= q[0] < m.shape[0] and 0 <= q[1] < m.shape[1]) for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)))}
            line = O.border(one, start)
            assert {(int(y), int(x)) for x, y in line} == seen
            assert (np.abs(line - np.roll(line, 1, 0)).max(1) <= 1).all()


def test_filling_an_outline_gives_the_mask_back():
    """Without its holes, as these have no outline."""
    for m in masks(150):
        got = np.zeros_like(m)
        for start in O.first_pixels(m):
            got |= filled(O.corners(O.border(m, start)), m.shape)
        want = np.array([[(y, x) not in outside(m) for x in range(m.shape[1])] for y in range(m.shape[0])])
        assert (got == want).all()


def test_simplified_lines_stay_near():
    draw = np.random.default_rng(2)
    for _ in range(50):
        angle = np.sort(draw.random(60)) * 2 * np.pi
        points = np.round(np.stack([np.cos(angle), np.sin(angle)], 1) * 80 + draw.normal(size=(60, 2)) * 2).astype(int)
        short = O.simplified(points, 3.0)
        assert 3 <= len(short) < len(points)
        a, b = short.astype(float), np.roll(short, -1, 0).astype(float)
        for p in points:
            t = np.clip(((p - a) * (b - a)).sum(1) / np.maximum(((b - a) ** 2).sum(1), 1e-9), 0, 1)
            assert np.hypot(*(a + t[:, None] * (b - a) - p).T).min() <= 3.0 + 1e-9


def test_labels_of_masks(spark):
    ring = np.ones((5, 6), int)
    ring[1:4, 1:5] = 0
    rows = [(1, ring.ravel().tolist(), 5, 6), (2, [0] * 12, 3, 4), (3, None, 3, 4), (4, [1] * 5, 3, 4), (5, [1] * 4, 1, 4), (6, None, None, None)]
    found = O.with_outlines(spark.createDataFrame(rows, "k int, v array<int>, h int, w int"), "v", "h", "w")
    got = {r.k: r.x for r in found.select("k", O.label_lines(F.col("outlines"), F.col("h"), F.col("w")).alias("x")).collect()}
    assert got == {1: ["0 0.000000 0.000000 0.000000 0.800000 0.833333 0.800000 0.833333 0.000000"], 2: [], 3: [], 4: [], 5: [], 6: []}


@pytest.mark.parametrize("cell", [3.0, 17.0, 400.0])
def test_points_in_polygons_like_brute_force(spark, cell):
    draw = random.Random(8)
    polygons = [(k, [(float(draw.randrange(-60, 200)), float(draw.randrange(-60, 200))) for _ in range(draw.randrange(2, 9))]) for k in range(40)] + [(50, [(0.0, 0.0), (90.0, 0.0), (90.0, 80.0), (0.0, 80.0)])]
    points = [(k, draw.uniform(-80, 220), draw.uniform(-80, 220)) for k in range(400)] + [(900, None, 1.0), (901, 30.0, 40.0), (901, 30.0, 40.0)]
    p = spark.createDataFrame(points, "point int, x double, y double")
    q = spark.createDataFrame([(k, [dict(zip("xy", v)) for v in o]) for k, o in polygons], "polygon int, outline array<struct<x: double, y: double>>")
    found = points_in_polygons(p, q, cell)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    both = p.crossJoin(q.filter("size(outline) >= 3")).filter(G.contains(F.col("outline"), F.col("x"), F.col("y")))
    want = sorted((r.point, r.polygon) for r in both.collect())
    assert sorted((r.point, r.polygon) for r in found.collect()) == want and len(want) > 100


def test_outlines_together_like_one_by_one(monkeypatch):
    draw = np.random.default_rng(5)
    some = [*masks(60), *(draw.random((int(draw.integers(1, 30)), int(draw.integers(1, 40)))) < draw.choice([0.1, 0.5, 0.9, 1.0]) for _ in range(200)), np.kron(draw.random((9, 9)) < 0.6, np.ones((20, 20), bool))]
    for together in (1, 2_000, O.TOGETHER):
        monkeypatch.setattr(O, "TOGETHER", together)
        for simplify in (True, False):
            got = O.outlines_together(some, simplify)
            with monkeypatch.context() as m:
                m.setattr(O, "SHORT", 0)  # all by arrays
                want = [O.outlines(x, simplify) for x in some]
            assert [[o.tolist() for o in own] for own in got] == [[o.tolist() for o in own] for own in want]
    assert O.outlines_together([]) == []


def test_points_of_one_place_are_tested_once(spark):
    """Points that share a place come out each, and the test stands above the distinct places."""
    points = spark.createDataFrame([(k, float(k % 5), float(k % 3)) for k in range(600)] + [(900, -0.0, 0.0), (901, None, 1.0)], "point int, x double, y double")
    q = spark.createDataFrame([(7, [dict(x=-0.5, y=-0.5), dict(x=2.5, y=-0.5), dict(x=2.5, y=1.5), dict(x=-0.5, y=1.5)])] * 2, "polygon int, outline array<struct<x: double, y: double>>")
    found = points_in_polygons(points, q, 2.0)
    assert sorted(r.point for r in found.collect()) == sorted(2 * [*(k for k in range(600) if k % 5 <= 2 and k % 3 <= 1), 900])
    assert found.columns == ["point", "x", "y", "polygon"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_x#" in plan and plan.index("lambdafunction") < plan.index("Aggregate [_x#")


def test_cover_of_polygons_is_not_broadcast(spark):
    """The planner takes the cells of a polygon for no more than the polygon, so a small table of polygons must not be sent to the driver."""
    points = spark.range(2_000).selectExpr("id AS point", "id * 37 % 1009 + 0.0D AS x", "id * 91 % 997 + 0.0D AS y")
    polygons = spark.range(20).selectExpr("id AS polygon", "array(named_struct('x', 0.0D, 'y', 0.0D), named_struct('x', 899.5D, 'y', 0.0D), named_struct('x', 0.0D, 'y', 899.5D)) AS outline")
    found = points_in_polygons(points, polygons, 64.0)
    assert found.count() == 20 * spark.createDataFrame(points.collect()).filter("x + y < 900").count()
    for plan in (found._jdf.queryExecution().executedPlan().toString(), found.groupBy("polygon").count()._jdf.queryExecution().executedPlan().toString()):
        assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def test_many_places_and_polygons_of_one_cell(spark):
    """More places than are tested together, more edges than a worker holds at once, and polygons with several columns or none."""
    draw = random.Random(9)
    near = lambda n: [(draw.uniform(0, 99), draw.uniform(0, 99)) for _ in range(n)]
    polygons = [(k, None if k % 3 else f"n{k}", [dict(zip("xy", v)) for v in near(12)]) for k in range(500)]
    points = [(k, *v) for k, v in enumerate(near(600))] + [(900, float("nan"), 1.0), (901, 1.0, None)]
    p = spark.createDataFrame(points, "point int, x double, y double")
    q = spark.createDataFrame(polygons, "polygon int, name string, outline array<struct<x: double, y: double>>")
    both = p.crossJoin(q).filter(G.contains(F.col("outline"), F.col("x"), F.col("y"))).select("point", "polygon", "name")
    want = sorted(map(tuple, both.collect()), key=repr)
    found = points_in_polygons(p, q, 1000.0)
    assert found.columns == ["point", "x", "y", "polygon", "name"]
    assert sorted(map(tuple, found.select("point", "polygon", "name").collect()), key=repr) == want and len(want) > 10_000
    bare = points_in_polygons(p, q.select("outline"), 1000.0)
    assert bare.columns == ["point", "x", "y"] and sorted(r.point for r in bare.collect()) == sorted(w[0] for w in want)
    whole = spark.createDataFrame([(7, [dict(x=-9.0, y=-9.0), dict(x=9.0, y=-9.0), dict(x=9.0, y=9.0), dict(x=-9.0, y=9.0)])], "polygon int, outline array<struct<x: double, y: double>>")
    assert sorted(r.point for r in points_in_polygons(p, whole, 0.5).collect()) == sorted(k for k, x, y in points if y is not None and x < 9 and y < 9)
