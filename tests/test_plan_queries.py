"""Every query gives the rows of its SQL, and plans keep what makes them scale."""

import glob
import os

import duckdb
import pytest

from lodestack.plans import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_of_the_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    places = [want.columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == sorted(repr(tuple(r[p] for p in places)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Models behind the provider interface, a stream, a vectorised resampling, and border following.
WITH_PYTHON = {"q40_stub_generate", "q41_stream_windows", "q52_detections", "q64_upsampled_tokens", "q67_labels_of_masks"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITH_PYTHON))
def test_no_product_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["q33_success_limit"](spark, DATA))
    assert "PushedFilters: [" in text and "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in text
    assert plan(QUERIES["q02_verified_rows"](spark, DATA)).count("Exchange hashpartitioning") == 1


def test_batches_are_made_of_whole_texts(spark, monkeypatch):
    from lodestack.operators import learning

    seen, rows_of = [], learning.token_rows
    monkeypatch.setattr(learning, "token_rows", lambda rows, **k: seen.append(rows) or rows_of(rows, **k))
    QUERIES["q30_batch_pad"](spark, DATA)
    whole = spark.read.parquet(f"{DATA}/conversations.parquet")
    got = {(r.conv_id, r.turn): "".join(map(chr, [*r.prompt_ids, *r.answer_ids])) for r in seen[0].collect()}
    want = {(r.conv_id, r.turn): r.text or "" for r in whole.collect()}
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()} and got == want
