"""The registered queries: columns as promised, whole tables, and the SQL where there is one."""

import glob
import hashlib
import os

import duckdb
import pytest

import __spark_entry__
from lodestack.llm.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")

COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_simhash": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_mix_sources": "doc_id size source_size target taken",
    "op5_simhash_dedup": "doc_id fingerprint component_id",
    "op8_html_text": "page_id url text n_chars",
    "op9_quality": "doc_id held_out score predicted",
    "op10_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op11_align_tokenizers": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op12_line_dedup": "doc_id n_lines n_dropped kept_sha256",
}


def test_all_operators_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    got = QUERIES[name](spark, DATA)
    promised = COLUMNS[name].split()
    assert got.columns[: len(promised)] == promised
    rows = got.collect()
    table, key = ("pages", "page_id") if name == "op8_html_text" else ("documents", "doc_id")
    ids = [r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()]
    assert sorted(r[key] for r in rows) == sorted(ids)
    for field in ("score", "near_edited", "near_next"):
        assert field not in promised or all(0 <= r[field] <= 1 for r in rows)
    if name == "op2_simhash":
        texts = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()), reverse=True)
        want = {}
        for k, (i, t) in enumerate(texts):
            half, following = len(t) // 2, texts[(k + 1) % len(texts)][1]
            want[i] = hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
        assert {r.doc_id: r.edited_sha256 for r in rows} == want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_of_the_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    order = sorted(got.columns)
    places = [want.columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == sorted(repr(tuple(r[p] for p in places)) for r in want.fetchall())
