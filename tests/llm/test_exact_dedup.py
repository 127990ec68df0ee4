import hashlib
import re

from lodestack.llm.exact_dedup import exact_dedup, kept_rows

SCHEMA = "doc_id long, text string, keep_id string, kept string"


def brute(rows):
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    out = []
    for i, t in norm:
        own = [j for j, u in norm if u == t]
        keep = min((j for j in own if j is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA)
    got = exact_dedup(df).drop("hash128").collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_like_brute_force(spark):
    texts = ["a b", "a  b", "a\n\tb", " a b", "a b ", None, "", " ", "\n", "ä", "ä", "a\x1cb", "A b", "long " * 50_000]
    rows = [(7 * k % 101, t) for k, t in enumerate(texts * 3)]
    assert run(spark, rows) == brute(rows)


def test_hot_group_nulls_and_repeated_rows(spark):
    rows = [(k, "copy") for k in range(500, 100, -1)] + [(None, "copy"), (None, None), (9, "own"), (9, "own")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_kept_rows(spark):
    rows = [(5, "a b"), (3, "a  b"), (3, "a  b"), (3, "other"), (None, None), (None, ""), (8, "x"), (9, "x")]
    df = spark.createDataFrame([(i, t, "k", None) for i, t in rows], SCHEMA)
    out = kept_rows(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id or -1, r.text or "") for r in out.collect())) == [(-1, ""), (3, "a  b"), (3, "other"), (8, "x")]


def test_rows_keep_columns_of_any_name(spark):
    schema = "doc_id long, text string, _h string, _turn int, _of string, _kept boolean, key string, turn int, row int"
    rows = [(1, "a  b", "h", 7, "o", True, "k", 8, 9), (2, "a b", "i", 6, "p", False, "l", 5, 4), (1, "a  b", "h", 7, "o", True, "k", 8, 9), (None, None, "z", 0, None, None, None, None, None)]
    got = kept_rows(spark.createDataFrame(rows, schema))
    assert got.columns == [c.split(" ")[0] for c in schema.split(", ")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[0], rows[3]], key=repr)


def test_copies_are_reduced_before_they_are_shuffled(spark):
    rows = [(None, "same text", "k", None)] * 20_000 + [(1, "own", "k", None)]
    out = kept_rows(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "same text"), (1, "own")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "first(row" in plan
