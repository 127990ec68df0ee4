import random
import re
from fractions import Fraction

import pytest

from lodestack.llm import mixing as op

SCHEMA = "doc_id long, text string, source string, size string, target int"


def brute_seats(votes, seats, most):
    got = [0] * len(votes)
    for _ in range(seats):
        open_ = [k for k in range(len(votes)) if got[k] < most[k] and votes[k] > 0]
        if not open_:
            break
        got[max(open_, key=lambda k: (Fraction(votes[k]) / (2 * got[k] + 1), -k))] += 1
    return got


@pytest.mark.parametrize("seed", range(30))
def test_highest_quotients(seed):
    r = random.Random(seed)
    n = r.randrange(1, 9)
    votes = [r.choice((0, 1, 5, 5, 17, r.randrange(1000))) for _ in range(n)]
    most = [r.choice((0, 3, 1000)) for _ in range(n)]
    seats = r.randrange(0, 300)
    assert op.sainte_lague(votes, seats, most).tolist() == brute_seats(votes, seats, most)


def test_capped_targets():
    assert op.capped_targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    assert op.capped_targets([1, 100, 1], [1, 2, 3]) == [3, 96, 3]
    assert op.capped_targets([0, 4], [5, 1]) == [0, 4]
    assert op.capped_targets([], []) == []


def sample(seed, n=600):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        words = r.choice((0, 1, 3, 50, 400))
        text = None if r.random() < 0.02 else " ".join(["w"] * words) + r.choice(("", "\n", " \t"))
        rows.append((k, text, r.choice(("a", "a", "a", "b", "\U0001f600", "￿", None)), "x", 1))
    return rows


@pytest.mark.parametrize("shard_rows", [20_000, 40])
def test_taken_is_near_target_and_reruns_agree(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(op, "SHARD_ROWS", shard_rows)
    rows = sample(3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = op.mix(df).collect()
    assert sorted(got) == sorted(op.mix(df.repartition(7)).collect())
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    words = {r[0]: len(re.findall("[^\x20\x09-\x0d]+", r[1] or "")) for r in rows}
    names = {r[0]: r[2] for r in rows}
    order = ["a", "b", "￿", "\U0001f600", None]
    sizes = [sum(words[i] for i in words if names[i] == s) for s in order]
    targets = dict(zip(order, op.capped_targets(sizes, [1, 2, 3, 1, 2])))
    assert all(r.size == words[r.doc_id] and 0 <= r.taken <= 3 * r.size for r in got)
    for s, n in zip(order, sizes):
        own = [r for r in got if names[r.doc_id] == s]
        assert {r.source_size for r in own} == {n}
        assert all(r.target == pytest.approx(targets[s]) for r in own)
        assert sum(r.taken for r in own) == pytest.approx(targets[s], rel=0.02)


def test_small_and_empty_tables(spark):
    assert op.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    got = op.mix(spark.createDataFrame([(1, None, None, "", 0), (None, "", "a", "", 0)], SCHEMA)).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2
    rows = [(1, "a b c", "a", "", 0), (1, "a b c", "a", "", 0), (2, "a", "b", "", 0), (3, "x " * 30_000, "c", "", 0)]
    got = op.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.taken for r in got if r.doc_id == 2) == 3
    assert sum(r.taken for r in got if r.doc_id == 1) == 18


def test_rows_of_the_mix(spark):
    df = spark.createDataFrame(sample(5), SCHEMA)
    copies = {}
    out = op.mixed_rows(df)
    assert out.columns == df.columns
    for r in out.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    taken = {r.doc_id: (r.taken, r.size) for r in op.mix(df).collect()}
    assert all(abs(copies.get(i, 0) * n - t) <= n / 2 for i, (t, n) in taken.items())
    assert sum(copies.get(i, 0) * n != t for i, (t, n) in taken.items()) <= 5


def test_sources_and_shards_are_one_key_of_the_order(spark):
    df = spark.createDataFrame(sample(3), SCHEMA)
    plan = op.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_cell" in plan and "Window" in plan
    assert "hashpartitioning(_source" not in plan


def test_rows_of_the_mix_keep_columns_of_any_name(spark):
    schema = "doc_id long, text string, source string, _key string, _cell int, rounds int, last int, row int"
    rows = [(k, "w " * 5, "ab"[k % 2], "x", 1, 2, 3, k) for k in range(6)]
    got = op.mixed_rows(spark.createDataFrame(rows, schema))
    assert got.columns == [c.split(" ")[0] for c in schema.split(", ")] and {r["row"] == r["doc_id"] for r in got.collect()} == {True}


@pytest.mark.parametrize("own", [7, None])
def test_rows_of_one_id_are_dealt_to_many_shards(spark, own):
    """20,000 rows of one id, and of none: of different texts they fill shards of the usual size, and copies are one row with a count."""
    rows = [(own, f"w{k} " * (k % 7 + 1), "a") for k in range(20_000)] + [(own, "copy of one text", "a")] * 3_000 + [(own, "x y", "b")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ranked, _ = op._ranked(df, "doc_id", "source", "text", (1, 2, 3), 42)
    cells = [r["count"] for r in ranked.groupBy("_cell").count().collect()]
    assert len(cells) >= 5 and max(cells) <= 1.2 * op.SHARD_ROWS
    got = op.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    for n in {r.source_size for r in got}:
        part = [r for r in got if r.source_size == n]
        assert sum(r.taken for r in part) == pytest.approx(part[0].target, rel=0.02)
