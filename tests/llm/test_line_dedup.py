import random
from collections import defaultdict

import numpy as np
import pytest

from lodestack.llm.line_dedup import FirstOccurrences, bits_of, kept_lines, line_bitmaps

SCHEMA = "doc_id long, text string, h1 string, id string, print string, place string, task int, bitmap string"
ENDS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(ENDS))


def brute(rows, least_length, least_documents):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_length:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            own = holders.get(key(line), ())
            if len(own) < least_documents or max(own, key=lambda x: (x is not None, x)) == i:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run(spark, rows, least_length=40, least_documents=5):
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d", 1, "e") for i, t in rows], SCHEMA)
    got = kept_lines(df, line_bitmaps(df, least_length=least_length, least_documents=least_documents))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_lines_like_brute_force(spark):
    draw = random.Random(3)
    common = [f"Common line number {k} that is long enough to count" for k in range(12)]
    rows = []
    for i in range(80):
        lines = [draw.choice(common) if draw.random() < 0.6 else f"own line {i} {draw.random()} of some length beyond forty" for _ in range(draw.randrange(9))]
        lines = [draw.choice(["", " ", "\t"]) + (x.upper() if draw.random() < 0.3 else x) + draw.choice(["", "\r", " \x0b"]) for x in lines]
        rows.append((i, "\n".join(lines)))
    assert run(spark, rows) == brute(rows, 40, 5)
    assert run(spark, rows, 10, 2) == brute(rows, 10, 2)


def test_odd_rows(spark):
    long = "x" * 40
    rows = [(None, None), (1, ""), (2, "\n\n"), (3, long), (None, long), (None, f"{long}\nother"), (4, f"{long}\n{long}\n{long}"), (5, f" {long.upper()} "), (5, f" {long.upper()} "), (6, "é" * 40), (7, "x" * 39), (8, "Ä" * 40 + "\n" + long)]
    assert run(spark, rows) == brute(rows, 40, 5)
    assert run(spark, rows, 1, 1) == brute(rows, 1, 1)
    assert run(spark, []) == []


@pytest.mark.parametrize("n", [3, 13])
def test_hot_line_over_many_partitions(spark, n):
    line = "This very line is held by every document of the table"
    rows = [(k, f"{line}\nown text of {k} that nobody else has got\n{line}") for k in range(600)] + [(77, f"{line}\nagain")] * 50
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, rows) == brute(rows, 40, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_stream_in_any_batches():
    draw = random.Random(5)
    rows = sorted(((draw.choice([1, 2, 3, 7]), -draw.randrange(9), draw.randrange(3)) for _ in range(120)))
    rows = sorted(set(rows))
    for cut in (1, 2, 5, len(rows)):
        state, gone, open_rows, edges = FirstOccurrences(3), [], [], []
        for at in range(0, len(rows), cut):
            part = rows[at : at + cut]
            found = state.feed(np.array([(k, 0) for k, _, _ in part]), (np.array([-d for _, d, _ in part], object), np.zeros(len(part), int), np.array([p for *_, p in part])))
            for k, own, documents in list(found) + (list(state.ended()) if at + cut >= len(rows) else []):
                (edges if own is None else gone if k is None else open_rows).append((k, documents if own is None else list(zip(own[0].tolist(), own[2].tolist()))))
        held = {k: sorted({-d for q, d, _ in rows if q == k}, reverse=True) for k in (1, 2, 3, 7)}
        want = sorted((-d, p) for k, d, p in rows if k in (2, 3) and len(held[k]) >= 3 and -d != held[k][0])
        last = [(-d, p) for k, d, p in rows if k == 7 and -d != held[7][0]] if len(held[7]) >= 3 else []
        assert sorted(x for _, own in gone for x in own) == sorted(want + last)
        assert sorted(x for _, own in open_rows for x in own) == sorted((-d, p) for k, d, p in rows if k == 1)
        assert {k[0]: d for k, d in edges} == {1: held[1][:3], 7: held[7][:3]}


def test_bits():
    assert bits_of(None, 3).tolist() == [True] * 3 and bits_of(None, 0).tolist() == []
