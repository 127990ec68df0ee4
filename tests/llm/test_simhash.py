import hashlib
import random

from pyspark.sql import functions as F

from lodestack.llm import simhash as op

SCHEMA = "doc_id long, text string, a string, _id int, n_chars string"


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    return op.document_fingerprints(df, **how).collect()


def texts(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeü") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    return [r.choice(("", " ")) + " ".join(r.choice(words) for _ in range(r.choice((0, 1, 2, 30, 200)))) for _ in range(n)]


def edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + following[:half], following


def brute_fingerprint(spark, text):
    """From the terms one by one, with weights as documented."""
    words = text.lower().replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    pairs = list(zip(words, [*words[1:], None]))
    if not pairs:
        return "0" * 32
    df = spark.createDataFrame(pairs, "w string, n string").select("w", "n", F.xxhash64("w", "n").alias("x"), F.xxhash64(F.lit(7), "w", "n").alias("y"))
    got = [(1 + (len(r.w) + len(r.n or "")) // 3, r.x, r.y) for r in df.collect()]
    total, out = sum(min(8, w) for w, _, _ in got), []
    for k in (1, 2):
        bits = sum(1 << b for b in range(64) if 2 * sum(min(8, g[0]) for g in got if g[k] >> b & 1) > total)
        out.append(f"{bits:016x}")
    return "".join(out)


def test_edited_texts_and_neighbours(spark, monkeypatch):
    monkeypatch.setattr(op, "ORDER_ROWS", 10)
    rows = [(3 * k + 1000 * (k > 60), t) for k, t in enumerate(texts(1, 120))] + [(None, "no id"), (None, None), (30, "twice the id"), (1, None)]
    random.Random(3).shuffle(rows)
    got = run(spark, rows)
    want = list(edits(rows))
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == sorted((i or -1, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want)
    by_id = {r.doc_id: r for r in got}
    for i, t, e, following in [w for w in want if w[0] not in (None, 30)][:12]:
        r = by_id[i]
        assert r.fingerprint == brute_fingerprint(spark, t) and r.edited_fingerprint == brute_fingerprint(spark, e)
        apart = (int(r.fingerprint, 16) ^ int(brute_fingerprint(spark, following), 16)).bit_count()
        assert abs(r.near_next - max(0.0, __import__("math").cos(apart * 3.141592653589793 / 128))) < 1e-9
    long = [r for r in got if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)


def test_search_like_brute_force(spark):
    r = random.Random(8)
    base = texts(5, 30)
    rows = list(enumerate(base + [t.replace("a", "b", 1) for t in base] + base[:5] + [None, ""]))
    got = run(spark, rows, search=F.expr("doc_id % 2 = 0"))
    fps = {r.doc_id: int(r.fingerprint, 16) for r in got}
    for row in got:
        near = sum((fps[row.doc_id] ^ x).bit_count() <= op.RADIUS for x in fps.values()) - 1
        assert row.near_rows == (near if row.doc_id % 2 == 0 else None)
    a = [(r.getrandbits(63) - 2**62, r.getrandbits(63)) for _ in range(40)]
    for x, y in list(a):
        for _ in range(3):
            for _ in range(r.randrange(1, 5)):
                bit = r.randrange(126)
                x, y = (x ^ 1 << bit, y) if bit < 63 else (x, y ^ 1 << bit - 63)
            a.append((x, y))
    df = spark.createDataFrame(a, "a long, b long")
    found = {tuple(p) for p in op.within_radius(df, df).collect()}
    m = 2**64 - 1
    want = {(*p, *q) for p in a for q in a if ((p[0] ^ q[0]) & m).bit_count() + ((p[1] ^ q[1]) & m).bit_count() <= 3}
    assert found == want
    assert op.within_radius(df, df).count() == len(want)


def test_small_tables(spark):
    assert run(spark, []) == []
    (r,) = run(spark, [(5, "abcd")])
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1
    got = run(spark, [(1, None), (2, "w " * 40_000), (3, "")])
    assert {r.fingerprint for r in got if r.doc_id != 2} == {"0" * 32}
