import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import hard_negatives as H
from lodestack.llm.hard_negatives import hard_negatives, scores

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, place string, block string, low int, windows string"


def brute(rows, positives=5, negatives=5, least=80, most=100):
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, y in rows:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = []
    for a, (y, v) in anchors.items():
        scored = [(-max(-H.LARGEST, min(H.LARGEST, sum(p * q for p, q in zip(v, u)))), i, z) for i, u, z in rows]
        for s, p, _ in sorted(x for x in scored if x[2] == y and x[1] != a)[:positives]:
            inside = sorted(x for x in scored if x[2] != y and least * -s <= 100 * -x[0] <= most * -s)[:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside)]
    return sorted(out)


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, v, y, "a", "b", "c", 1, "d") for i, v, y in rows], SCHEMA)
    got = hard_negatives(df, F.col("id") % 100 == 0, **k)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def made(n, width=12, labels=4, seed=1):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=width)
    vectors = (draw.normal(size=(n, width)) * 0.5 + centre).astype(np.float32)
    return [(7 * k % n if n % 7 else k, [float(x) for x in v], int(draw.integers(labels))) for k, v in enumerate(vectors)]


@pytest.mark.parametrize("k", [{}, {"row_block": 100, "anchor_block": 2}, {"positives": 2, "negatives": 30, "least": 10, "most": 95}])
def test_like_brute_force(spark, k):
    rows = made(900)
    args = {x: v for x, v in k.items() if "block" not in x}
    got = run(spark, rows, **k)
    assert got == brute(rows, **args) and len(got) > 20


def test_anchors_that_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(H, "SENT_BYTES", 0)
    monkeypatch.setattr(H, "ROW_BLOCKS_A_SALT", 2)
    rows = made(900)
    assert run(spark, rows, row_block=100, anchor_block=2) == brute(rows)


def test_rounds_and_ties(spark, monkeypatch):
    monkeypatch.setattr(H, "DIGIT_BITS", 2)
    rows = made(300, labels=2) + [(1000 + k, [0.5] * 12, k % 3) for k in range(300)]  # a third of all rows are one vector
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(50) + [(100, [1.0] * 12, 1), (100, [0.5] * 12, 1), (100, [0.5] * 12, 3), (None, [1.0] * 12, 1), (101, None, 1), (102, [1.0] * 12, None), (103, [nan] * 12, 1), (104, [inf] + [0.0] * 11, 2)]
    rows += [(105, [None] + [1.0] * 11, 2), (106, [], 2), (107, [2.0], 2), (108, [1.0] * 20, 1), (109, [-1.0] * 12, 1), (110, [0.9] * 12, 2), (110, [0.9] * 12, 2), (200, [-3.0] * 12, 0), (300, [], 0), (400, [1.0] * 12, 9)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_large_components(spark):
    rows = made(40) + [(100, [1e30] * 12, 1), (201, [1e30] * 12, 1), (202, [9e29] * 12, 2), (203, [3e5] * 12, 2), (300, [4e5] * 12, 2), (301, [3.9e5] * 12, 2), (302, [3.8e5] * 12, 1)]
    rows = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows]
    assert run(spark, rows) == brute(rows)


def test_scores_are_exact():
    draw = np.random.default_rng(2)
    for top in (100, 10**6, 10**12):
        a, b = (draw.integers(-top, top, (5, 9)).astype(float) for _ in range(2))
        want = [[max(-H.LARGEST, min(H.LARGEST, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
        assert scores(a, b).tolist() == want
