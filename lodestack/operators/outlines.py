"""Outlines of masks: border following around connected regions, and line simplification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.raster import normalized_label

#: The tolerance of simplified outlines, at least, and as a share of their length.
LEAST_TOLERANCE, TOLERANCE = 1.0, 0.001
#: Steps (y, x) in the order in which a border is searched, from the left and first down.
STEPS = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
#: Pixels of masks whose borders are followed together, or of one larger mask; borders that are fewer than FEW are followed one by one, and outlines of more than SHORT points are simplified by arrays.
TOGETHER, FEW, SHORT = 1 << 20, 8, 24


def first_pixels(mask: np.ndarray) -> list[tuple[int, int]]:
    """(y, x) of the topmost, then leftmost pixel of each region; pixels that touch at a side or corner are one region.

    Works on runs of each row: a run joins those of the row above that reach it, by union-find.
    """
    height, width = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edges == 1)
    ends = np.nonzero(edges == -1)[1]
    root = list(range(len(rows)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    first = np.searchsorted(rows, np.arange(height + 1))
    for y in range(1, height):
        above, own = first[y - 1], first[y]
        while above < first[y] and own < first[y + 1]:
            if starts[own] <= ends[above] and starts[above] <= ends[own]:
                a, b = sorted((find(above), find(own)))
                root[b] = a
            if ends[above] < ends[own]:
                above += 1
            else:
                own += 1
    return [(int(rows[k]), int(starts[k])) for k in range(len(rows)) if find(k) == k]


def border(mask: np.ndarray, start: tuple[int, int]) -> np.ndarray:
    """The outer border of the region that begins at `start` (its topmost, then leftmost pixel) as points (x, y) in order, first down; a pixel may come twice where the region is thin."""
    padded = np.pad(mask, 1)
    y, x = start[0] + 1, start[1] + 1
    points, came = [(y, x)], 0  # where the search begins: the background to the left
    begun = None
    while True:
        for k in range(8):
            turn = (came + k) % 8
            dy, dx = STEPS[turn]
            if padded[y + dy, x + dx]:
                break
        else:
            break  # a single pixel
        if (y, x) == (start[0] + 1, start[1] + 1):
            if begun is None:
                begun = turn
            elif turn == begun:
                points.pop()
                break
        y, x = y + dy, x + dx
        points.append((y, x))
        came = (turn + 6) % 8 if turn % 2 == 0 else (turn + 5) % 8  # the background that was seen last, as seen from the new pixel
    return np.array(points)[:, ::-1] - 1


def corners(points: np.ndarray) -> np.ndarray:
    """Points of a closed outline at which its direction changes."""
    if len(points) < 3:
        return points
    into, out = points - np.roll(points, 1, 0), np.roll(points, -1, 0) - points
    kept = points[(into != out).any(1)]
    return kept if len(kept) else points[:1]


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed outline of fewer points, none of the left out ones further than `tolerance` from it: cut at the point furthest from the first, each half split where it is furthest from its chord."""
    if len(points) < 4:
        return points
    if len(points) <= SHORT:
        return points[_kept_of_few(points.tolist(), tolerance)]
    p = points.astype(float)
    half = int(((p - p[0]) ** 2).sum(1).argmax())
    ring = np.concatenate([p, p[:1]])
    keep = np.zeros(len(ring), bool)
    keep[[0, half]] = True
    todo = [(0, half), (half, len(p))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, own = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        length = np.hypot(*chord)
        far = np.abs(chord[0] * own[:, 1] - chord[1] * own[:, 0]) / length if length else np.hypot(own[:, 0], own[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep[:-1]]


def _kept_of_few(p: list[list[int]], tolerance: float) -> list[int]:
    """simplified() for few points, with the same numbers but no arrays, which cost more than the sums."""
    away = [(x - p[0][0]) ** 2 + (y - p[0][1]) ** 2 for x, y in p]
    half = away.index(max(away))
    ring, keep, todo = [*p, p[0]], {0, half}, [(0, half), (half, len(p))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        (ax, ay), (bx, by) = ring[a], ring[b]
        dx, dy = bx - ax, by - ay
        length = float(np.hypot(dx, dy))
        far = [abs(dx * (y - ay) - dy * (x - ax)) / length if length else float(np.hypot(x - ax, y - ay)) for x, y in ring[a + 1 : b]]
        most = max(far)
        if most > tolerance:
            k = a + 1 + far.index(most)
            keep.add(k)
            todo += [(a, k), (k, b)]
    return sorted(k for k in keep if k < len(p))


def _corners_together(mask: np.ndarray, starts: list[tuple[int, int]]) -> list[np.ndarray]:
    """corners(border(mask, start)) of each start, all borders followed step by step at once."""
    stride = mask.shape[1] + 2
    flat = np.pad(mask, 1).ravel()
    off = np.array([dy * stride + dx for dy, dx in STEPS])
    first = np.array([(y + 1) * stride + x + 1 for y, x in starts], np.int64)
    ids, at = np.arange(len(first)), first
    came, begun = np.zeros(len(first), int), np.full(len(first), -1)
    walkers, places, back = [ids], [at], np.zeros(len(first), bool)
    while len(ids) >= FEW:
        turns = (came[:, None] + np.arange(8)) % 8
        hit = flat[at[:, None] + off[turns]]
        turn = turns[np.arange(len(ids)), hit.argmax(1)]
        home = at == first[ids]
        ended = home & (begun == turn)
        begun = np.where(home & (begun < 0), turn, begun)
        back[ids[ended]] = True  # the first point has come again
        on = hit.any(1) & ~ended
        ids, at, begun, turn = ids[on], at[on] + off[turn[on]], begun[on], turn[on]
        came = np.where(turn % 2 == 0, turn + 6, turn + 5) % 8
        walkers.append(ids)
        places.append(at)
    walker, place = np.concatenate(walkers), np.concatenate(places)
    order = np.argsort(walker, kind="stable")
    walker, place = walker[order], place[order]
    last = np.ones(len(walker), bool)
    last[:-1] = walker[1:] != walker[:-1]
    kept = ~(last & back[walker])
    walker, place = walker[kept], place[kept]
    begin = np.searchsorted(walker, np.arange(len(first) + 1))
    points = np.stack([place % stride - 1, place // stride - 1], 1)
    before, after = np.arange(-1, len(points) - 1), np.arange(1, len(points) + 1)
    before[begin[:-1]], after[begin[1:] - 1] = begin[1:] - 1, begin[:-1]
    turned = (points - points[before] != points[after] - points).any(1)
    out = [points[a:b][turned[a:b]] if b - a > 2 else points[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
    for k in ids.tolist():  # the longest few
        out[k] = corners(border(mask, starts[k]))
    return out


def outlines_together(masks: list[np.ndarray], simplify: bool = True) -> list[list[np.ndarray]]:
    """outlines() of each mask: masks stand above each other in one of about TOGETHER pixels, with an empty row between, and their borders are followed at once."""
    out: list[list[np.ndarray]] = []
    held: list[np.ndarray] = []

    def done() -> None:
        tops = np.cumsum([0, *(m.shape[0] + 1 for m in held)])
        tall = np.zeros((int(tops[-1]), max(m.shape[1] for m in held)), bool)
        for m, top in zip(held, tops):
            tall[top : top + m.shape[0], : m.shape[1]] = m
        found: list[list[np.ndarray]] = [[] for _ in held]
        starts = first_pixels(tall)
        of = np.searchsorted(tops, [y for y, _ in starts], "right") - 1
        for k, own in zip(of.tolist(), _corners_together(tall, starts) if starts else ()):
            if len(own) >= 3:
                found[k].append(_outline(own - [0, tops[k]], simplify))
        out.extend(found)
        held.clear()

    for m in masks:
        if held and (rows + m.shape[0] + 1) * max(widest, m.shape[1]) > TOGETHER:
            done()
        if not held:
            rows, widest = 0, 0
        held.append(m)
        rows, widest = rows + m.shape[0] + 1, max(widest, m.shape[1])
    if held:
        done()
    return out


def _outline(own: np.ndarray, simplify: bool) -> np.ndarray:
    """An outline of fewer points; one that has fewer than three once simplified stays as it was."""
    length = np.hypot(*(own - np.roll(own, 1, 0)).T).sum()
    short = simplified(own, max(LEAST_TOLERANCE, TOLERANCE * length)) if simplify else own
    return short if len(short) >= 3 else own


def outlines(mask: np.ndarray, simplify: bool = True) -> list[np.ndarray]:
    """Outer borders of a mask's regions, from top to bottom, of three points or more; one that has fewer once simplified stays as it was."""
    out = []
    for start in first_pixels(mask):
        own = corners(border(mask, start))
        if len(own) >= 3:
            out.append(_outline(own, simplify))
    return out


def with_outlines(rows: DataFrame, values: str = "values", height: str = "height", width: str = "width", into: str = "outlines", simplify: bool = True, keep_values: bool = True) -> DataFrame:
    """rows with a column `into`: the outlines of each mask (values row by row, set above 0), each an array of [x, y] in pixels; in Arrow batches, without a shuffle.

    A null mask, or one whose size does not fit, has none. Without keep_values the masks do not come back from Python.
    """
    schema = rows.drop(into, *(() if keep_values else (values,))).withColumn(into, F.lit(None).cast("array<array<array<int>>>")).schema
    names = schema.names

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[] for _ in range(batch.num_rows)]
            masks, places = [], []
            for k, (v, h, w) in enumerate(zip(batch.column(values), batch.column(height).to_pylist(), batch.column(width).to_pylist())):
                if v.is_valid and h and w and len(v) == h * w:
                    masks.append(v.values.to_numpy(zero_copy_only=False).reshape(h, w) > 0)
                    places.append(k)
            for k, own in zip(places, outlines_together(masks, simplify)):
                found[k] = [o.tolist() for o in own]
            column = pa.array(found, pa.list_(pa.list_(pa.list_(pa.int32()))))
            yield pa.RecordBatch.from_arrays([column if n == into else batch.column(n) for n in names], names)

    return rows.drop(into).mapInArrow(of, schema)


def label_lines(outlines: Column, height: Column, width: Column) -> Column:
    """Label lines of with_outlines(), one for each region; a mask without regions has an empty array."""
    return F.transform(outlines, lambda points: normalized_label(points, width, height))
