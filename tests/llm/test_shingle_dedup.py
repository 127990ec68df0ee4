import random

import pytest

import corpus_pipeline
from lodestack.llm import shingle_dedup as op
from lodestack.llm.mixing import capped_targets
from test_pipeline import DOCS, corpus
from test_simhash_dedup import brute_components

SCHEMA = "doc_id long, text string, node string"


def brute_sets(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: brute_sets(t) for i, t in rows}
    like = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y)
    return brute_components([(a, b) for a in sets for b in sets if a < b and like(sets[a], sets[b])], sets)


def near_texts(seed):
    """Texts with copies in which words were changed here and there, to both sides of the similarity."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3_000)}"
    out = [None, "", " \t", "A b", "a  B", "one two three four"]
    for _ in range(60):
        base = [word() for _ in range(r.randrange(30, 400))]
        out.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(r.randrange(1, max(2, len(base) // 30))):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out


def test_like_brute_force(spark):
    rows = list(enumerate(near_texts(1)))
    got = {r.doc_id: r.component_id for r in op.near_copies(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)).collect()}
    want = brute(rows)
    assert len(got) == len(rows) and len(set(want.values())) < len(rows) / 2
    assert got == want


def test_a_large_group_of_near_copies(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(3_000)}" for _ in range(200)]
    rows = []
    for k in range(300):
        copy = list(base)
        copy[r.randrange(200)] = f"own{k}"
        rows.append((k, " ".join(copy), "x"))
    assert {x.component_id for x in op.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}


@pytest.mark.parametrize("held", [2_000, 7])
def test_many_texts_that_share_keys_and_are_hardly_alike(spark, monkeypatch, held):
    """Copies at both sides of the similarity, so most share keys and few are linked; blocks of any size find the same links."""
    monkeypatch.setattr(op, "HELD", held)
    r = random.Random(9)
    base = [f"w{r.randrange(3_000)}" for _ in range(300)]
    rows = []
    for k in range(70):
        copy = list(base)
        for _ in range(r.randrange(4, 9)):
            copy[r.randrange(300)] = f"own{k}x{r.randrange(9)}"
        rows.append((k, " ".join(copy), "x"))
    got = {x.doc_id: x.component_id for x in op.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute([(i, t) for i, t, _ in rows])
    assert got == want and 1 < len(set(want.values())) < 70


def test_null_ids_and_empty_table(spark):
    assert op.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d", None), (3, "a b c d", None), (3, "a b c d", None), (None, "z", None)]
    got = op.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]


def test_the_stage_keeps_one_of_near_copies(spark):
    rows = list(enumerate(near_texts(2)))
    kept = corpus_pipeline.near(spark, spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(rows).values()))


def test_all_stages_with_near_copies(spark, tmp_path):
    rows, labels = corpus(3)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out-{n}")
        docs = spark.read.parquet(f"{tmp_path}/out-{n}")
        kept[name] = docs.collect()
    near = brute([(r.doc_id, r.text) for r in kept["exact dedup"]])
    assert sorted(r.doc_id for r in kept["simhash near-dedup"]) == sorted(set(near.values()))
    sizes, taken = {}, {}
    for stage, into in (("simhash near-dedup", sizes), ("mixing sources", taken)):
        for r in kept[stage]:
            into[r.source] = into.get(r.source, 0) + len(r.text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, target in zip(order, capped_targets([sizes[s] for s in order], [1, 2, 3])):
        assert abs(taken[s] - target) <= 60
    assert sorted(r.doc_id for r in kept["sentencepiece encoding"]) == sorted(r.doc_id for r in kept["mixing sources"])
    assert all(r.round_trip for r in kept["sentencepiece encoding"])


def test_fingerprints_find_and_judge_pairs(spark, monkeypatch):
    """By the SimHash search alone texts within two bits are found; and pairs of the bands count within REACH bits only."""
    import numpy as np

    r = random.Random(6)
    base = [f"w{r.randrange(3_000)}" for _ in range(900)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"v{r.randrange(3_000)}" for _ in range(900))]
    sets = [op.shingles(t.encode()) for t in texts]
    prints = [op.simhash(s) for s in sets]
    for s, p in zip(sets, prints):
        assert p % 2**64 == sum((2 * sum(int(h) >> k & 1 for h in s) > len(s)) << k for k in range(64))
    assert (prints[0] ^ prints[1]).bit_count() <= 2 and op.simhash(np.zeros(0, np.uint64)) == 0
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA)
    found = lambda: {x.doc_id: x.component_id for x in op.near_copies(docs).collect()}
    with monkeypatch.context() as m:
        m.setattr(op, "shared_keys", lambda bands: bands.selectExpr("node", "0L as key", "node as lead").limit(0))
        assert found() == {0: 0, 1: 0, 2: 2}
    monkeypatch.setattr(op, "searched_pairs", lambda p: p.selectExpr("node as a", "node as b").limit(0))
    assert found() == {0: 0, 1: 0, 2: 2}
    monkeypatch.setattr(op, "REACH", -1)
    assert found() == {0: 0, 1: 1, 2: 2}
