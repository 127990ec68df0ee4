import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lodestack.llm import simhash_dedup as op
from lodestack.llm.components import components

SCHEMA = "doc_id long, text string, fp string"


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute_dedup(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    pairs = [(a, b) for a, x in fps for b, y in fps if (x ^ y).bit_count() <= 2]
    roots = brute_components(pairs, [i for i, _ in fps])
    return {(i, f"{x:016x}", roots[i]) for i, x in fps}


def sample_texts(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    texts = [None, "", " \t\n", "A", "a", "Ä b", "ä b", "one two", "\x1cx y z", "x" * 9000, "a " * 5000]
    for _ in range(15):
        base = [r.choice(words) for _ in range(r.randrange(3, 400))]
        texts.append(" ".join(base))
        for _ in range(3):
            base = list(base)
            base[r.randrange(len(base))] = r.choice(words)
            texts.append(" ".join(base))
    return texts


def test_like_brute_force(spark):
    rows = list(enumerate(sample_texts(1)))
    random.Random(2).shuffle(rows)
    got = op.near_dedup(spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)).collect()
    assert {tuple(r) for r in got} == brute_dedup(rows)
    assert len(got) == len(rows)


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert op.near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d", None), (3, "a b c d", None), (3, "a b c d", None), (None, "z", None)]
    got = op.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]


def ball(n, seed):
    """Fingerprints near one another: chains of few flipped bits."""
    r = random.Random(seed)
    out = {r.getrandbits(64)}
    while len(out) < n:
        x = r.choice(list(out)) if r.random() < 0.9 else r.getrandbits(64)
        for _ in range(r.choice((1, 2, 2, 3))):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("held,compared", [(65_536, 2_048), (65_536, 4), (5, 2)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, held, compared):
    fps = ball(300, 5)
    want = brute_components([(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 2], fps)
    monkeypatch.setattr(op, "COMPARED", compared)
    rows = sorted((k, fp) for fp in fps for k in keys_of(fp))
    step = 997 if held > 5 else 3
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in part], pa.int64()), pa.array(np.array([f for _, f in part], np.uint64).view(np.int64))],
            ["key", "fp"],
        )
        for part in (rows[i : i + step] for i in range(0, len(rows), step))
    ]
    monkeypatch.setattr(op, "HELD", held)
    found = [x for b in op._links_of_signatures(iter(batches)) for x in b.to_pylist()]
    flood = sorted({x["a"] for x in found if x["b"] is None})
    links = [(x["a"], x["b"]) for x in found if x["b"] is not None]
    if held == 5:
        assert flood
        df = spark.createDataFrame([(f,) for f in flood], "fp bigint")
        links += [(r.a, r.b) for r in op._masked_pairs(df).collect()]
    links = [(a % 2**64, b % 2**64) for a, b in links]
    assert brute_components(links, fps) == want


def keys_of(fp):
    for i in range(64):
        seg = fp & 0xFFFFFFFF if i < 32 else fp >> 32
        yield i << 32 | seg & ~(1 << i % 32)


def test_signatures_are_those_keys(spark):
    fps = ball(20, 9)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    got = {(r.key, r.fp % 2**64) for r in op.signatures(df).collect()}
    assert got == {(k, f) for f in fps for k in keys_of(f)}


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 200)] + [(500, 700), (700, 600)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 600: 500, 700: 500}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
