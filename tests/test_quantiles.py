"""Percentiles from counts, against NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.operators import imaging as I
from lodestack.operators.quantiles import exact_percentiles, ordered_bits

SHARES = (0.0, 0.01, 0.5, 0.77, 0.99, 1.0)


def groups():
    draw = random.Random(1)
    out = {
        "many": [draw.gauss(0, 1e3) for _ in range(4000)], "ties": [draw.choice([-1.5, 0.0, -0.0, 2.25]) for _ in range(500)], "one": [7.0], "two": [1.0, 2.0],
        "wide": [draw.choice([-1, 1]) * 10.0 ** draw.randrange(-300, 300) for _ in range(300)], "odd": [float("nan"), None, float("inf"), 3.0, float("-inf"), 1.0], "none": [float("nan"), None],
        None: [5.0, 6.0, 9.0],
    }
    return [(k, v) for k, vs in out.items() for v in vs]


@pytest.mark.parametrize("digit", [16, 5])
def test_like_numpy(spark, digit):
    rows = groups()
    df = spark.createDataFrame(rows, "k string, value double")
    got = {r.k: r for r in exact_percentiles(df, ["k"], SHARES, digit=digit).collect()}
    assert set(got) == {k for k, _ in rows}
    for k, r in got.items():
        own = np.array([v for g, v in rows if g == k and v is not None and np.isfinite(v)])
        assert r.n == len(own)
        if len(own):
            assert (r.smallest, r.largest) == (own.min(), own.max())
            assert r.quantiles == pytest.approx(np.quantile(own, SHARES), rel=1e-12)
        else:
            assert r.quantiles == [None] * len(SHARES)


def test_order_of_bits(spark):
    values = [float("-1e308"), -2.0, -1e-310, 0.0, 5e-324, 1.0, 1e308]
    keys = [r[0] & (1 << 64) - 1 for r in spark.createDataFrame([(v,) for v in values], "v double").select(ordered_bits(F.col("v"))).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_only_counts_are_shuffled(spark):
    """A section of far more distinct values than a digit has: no exchange carries more rows than counts of digits."""
    df = spark.range(60_000).select(F.lit("a").alias("k"), (F.rand(3) * 1e6).alias("value"))
    found = exact_percentiles(df, ["k"], (0.01, 0.99), digit=6)
    values = np.array([r.value for r in df.collect()])
    assert found.first().quantiles == pytest.approx(np.quantile(values, (0.01, 0.99)), rel=1e-12)
    plan = I.robust_range(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan


def test_empty_table_and_states_by_shuffle(spark, monkeypatch):
    from lodestack.operators import quantiles

    assert exact_percentiles(spark.createDataFrame([], "k string, value double"), ["k"], SHARES).collect() == []
    monkeypatch.setattr(quantiles, "MOST_SENT", 0)
    df = spark.createDataFrame([("a", float(v)) for v in range(101)], "k string, value double")
    assert exact_percentiles(df, ["k"], (0.5,)).first().quantiles == [50.0]
