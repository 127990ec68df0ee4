import random

import numpy as np
import pytest

from lodestack.llm import toxicity as op

SCHEMA = "doc_id long, text string, _id string, score int, toxic string"


def brute_kernel(s, t):
    def features(word):
        codes = [op.START, *op.classes(word).tolist(), op.END]
        out = {}
        for i in range(len(codes)):
            for j in range(i + 1, len(codes)):
                for k in range(j + 1, len(codes)):
                    if k - i < op.SPAN:
                        u = codes[i], codes[j], codes[k]
                        out[u] = out.get(u, 0.0) + op.DECAY ** (k - i + 1)
        return out

    a, b = features(s), features(t)
    norm = sum(v * v for v in a.values()) ** 0.5 * sum(v * v for v in b.values()) ** 0.5
    return sum(v * b.get(u, 0.0) for u, v in a.items()) / norm


WORDS = ["a", "ab", "aaaa", "abab", "idiot", "i.d.i.o.t", "idi0t", "überübel", "zzz", "x" * 20, "日本語日本"]


def test_kernel_like_brute_force():
    got = op.kernel(WORDS, WORDS)
    want = np.array([[brute_kernel(s, t) for t in WORDS] for s in WORDS])
    assert np.allclose(got, want, atol=1e-5)


def test_folded_machine_is_the_kernel_machine():
    toxic = np.array([0, 0, 0, 0, 1, 1, 1, 0, 0, 0, 0])
    marks, beta, bias = op.fit_machine(WORDS, toxic, np.ones(len(WORDS)), landmarks=8)
    margins = op.ToxicityModel(op.folded(marks, beta), bias, (0.0, 0.0, 0.0, 0.0)).margins(WORDS)
    assert (margins[toxic == 1] > margins[toxic == 0].max()).all()
    assert {toxic[WORDS.index(m)] for m in marks} == {0, 1}
    summed = [sum(b * brute_kernel(w, m) for b, m in zip(beta, marks)) + bias for w in WORDS]
    assert np.allclose(margins, np.clip(summed, -op.MARGIN, op.MARGIN), atol=1e-3)


def test_first_rows_keeps_to_its_bound(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3_000).select(F.col("id").alias("word"), (F.col("id") % 3).cast("int").alias("toxic"))
    for most in (0, 10, 900, 1_500, 5_000):
        got = op.first_rows(rows, most, F.col("word"), F.col("toxic")).collect()
        assert len(got) == len(set(got)) <= most and len(got) >= min(3_000, 0.9 * most - 3)
        ranks = sorted((r.toxic for r in got), reverse=True)
        assert ranks == sorted([2] * 1_000 + [1] * 1_000 + [0] * 1_000, reverse=True)[: len(got)]
        assert sorted(got) == sorted(op.first_rows(rows.repartition(5), most, F.col("word"), F.col("toxic")).collect())


def sample(seed, n):
    r = random.Random(seed)
    syllables = ["ta", "ri", "mo", "len", "sa", "vor", "ne", "ki", "dul"]
    for k in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(5, 60))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(r.randrange(2, 6)):
                bad = r.choice(("wretch", "bufgoop", "grumbzok")) + r.choice(("", "ta", "ri", "len"))
                bad = op.varied(bad, r) if r.random() < 0.3 else bad
                words.insert(r.randrange(len(words)), bad)
        yield k, ". ".join((" ".join(words[:7]), " ".join(words[7:]))), int(toxic)


def test_held_out_documents(spark):
    rows = list(sample(1, 1500))
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = op.fit_toxicity(docs, labels)
    got = {r.doc_id: r.score for r in op.score_toxicity(docs, model).collect()}
    held = [(y, got[i] >= 0.7) for i, _, y in rows if i % 3 == 0]
    assert sum(y and p for y, p in held) >= 0.93 * sum(y for y, _ in held)
    assert sum(p and not y for y, p in held) <= 4
    assert model.margins(["g-rumbzok", "wre_tch"]).min() > model.margins(["tarimo", "lensavor", "ne"]).max()
    again = op.fit_toxicity(docs.repartition(5), labels.repartition(2))
    assert np.allclose(again.table, model.table, atol=1e-4)


def test_nulls_empty_and_long_texts(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    rows = [(1, None, "", 0, ""), (None, "", "", 0, ""), (2, " \n", "", 0, ""), (2, "w " * 90_000 + "x" * 9_000, "", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = op.fit_toxicity(docs, labels)
    got = op.score_toxicity(docs, model).collect()
    assert [r.score for r in got] == pytest.approx([0.5] * 4)
    assert op.score_toxicity(spark.createDataFrame([], SCHEMA), model).collect() == []
    table = np.zeros(op.CLASSES**3, np.float32)
    real = op.ToxicityModel(table, 1.0, (-1.0, 1.0, 0.0, 0.0))
    assert [r.score for r in op.score_toxicity(docs, real).collect()][:3] == pytest.approx([1 / (1 + np.exp(4))] * 3)


def test_runs_of_single_characters_and_windows():
    assert op.tokens("You i d i o t A")[-1] == "idiota"
    assert op.sentences("A b. C\n\nD!") == ["A b.", "C", "D!"]
    table = np.zeros(op.CLASSES**3, np.float32)
    c = op.classes("bad")
    table[(c[0] * 64 + c[1]) * 64 + c[2]] = 100
    found = op.ToxicityModel(table, 0.0, ()).margins(["x" * 500 + "bad" + "y" * 500, "x" * 1000])
    assert found[0] > 1 and found[1] == 0


def brute_score(model, text):
    """Subsequence by subsequence, word by word."""
    def margin(word):
        best = -op.MARGIN
        parts = [word] if len(word) <= op.WINDOW else [word[at : at + op.WINDOW] for at in range(0, len(word) - op.WINDOW // 2, op.WINDOW // 2)]
        for part in parts:
            codes, held = [op.START, *op.classes(part).tolist(), op.END], {}
            for i in range(len(codes)):
                for k in range(i + 2, min(len(codes), i + op.SPAN)):
                    for j in range(i + 1, k):
                        u = (codes[i] * op.CLASSES + codes[j]) * op.CLASSES + codes[k]
                        held[u] = held.get(u, 0.0) + op.DECAY ** (k - i + 1)
            if held:
                norm = sum(v * v for v in held.values()) ** 0.5
                best = max(best, min(op.MARGIN, max(-op.MARGIN, sum(float(model.table[u]) * v for u, v in held.items()) / norm + model.bias)))
        return best

    margins = sorted((margin(w.strip(op.EDGES) or w) for w in op.tokens(text or "")), reverse=True)
    two = [max(-1, min(1, m)) for m in margins[:2]] + [-op.MARGIN] * (2 - len(margins[:2]))
    features = [two[0], two[1], np.log1p(sum(m >= op.SURE for m in margins))]
    return 1 / (1 + np.exp(-(model.document[0] + sum(w * f for w, f in zip(model.document[1:], features)))))


def test_scores_like_brute_force(spark):
    rows = list(sample(2, 300)) + [(900, None, 0), (901, "", 0), (902, "x" * 700 + " wretchta", 1), (903, "i d i o t wretch", 1)]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t, _ in rows], SCHEMA)
    model = op.fit_toxicity(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert np.abs(model.table).max() > 0
    got = {r.doc_id: r.score for r in op.score_toxicity(docs, model).collect()}
    assert [got[i] for i, t, _ in rows] == pytest.approx([brute_score(model, t) for _, t, _ in rows], abs=1e-3)


def test_long_words_are_learned_whole_and_bounds_are_parameters(spark):
    """An insult behind a hundred characters of a longer word is learned, and no sentence is long."""
    r = random.Random(3)
    rows = []
    for k in range(300):
        words = ["".join(r.choice(("ta", "ri", "mo", "len")) for _ in range(3)) for _ in range(12)]
        if k % 3 == 0:
            words.insert(4, "z" * 60 + "grumbzok" + "z" * 60)
        rows.append((k, " ".join(words), int(k % 3 == 0)))
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in op.score_toxicity(docs, op.fit_toxicity(docs, labels)).collect()}
    assert all((got[i] >= 0.7) == y for i, _, y in rows)
    assert op.windows("a" * 24) == ["a" * 24] and "".join(w[:12] for w in op.windows("abcdef" * 20)) + op.windows("abcdef" * 20)[-1][12:] == "abcdef" * 20
    bags = op._sentences(spark.createDataFrame([("w" * 50_000, 0)], "_text string, _y int"), frozenset()).collect()
    assert max(sum(map(len, b.words)) for b in bags) <= op.SENTENCE_WORDS * op.WINDOW
    few = op.fit_toxicity(docs, labels, toxic_rows=20, clean_rows=30, toxic_sentences=10, clean_sentences=10, hard_words=5, pointers=5, landmarks=8, seen_in=2)
    assert few.table.shape == (op.CLASSES**3,)
