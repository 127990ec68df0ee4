import random

import numpy as np
import pytest

from lodestack.llm import quality_rules as op

SCHEMA = "doc_id long, text string, score string, _id int, word_length string"


def texts(seed, n):
    r = random.Random(seed)
    for k in range(n):
        words = [r.choice(("alpha", "beta", "gamma", "delta", "of", "the")) + r.choice("abcdefgh") for _ in range(r.randrange(5, 90))]
        bad = r.random() < 0.3
        if bad:
            words = r.choice(([w + "###" for w in words], [w.upper() + "!!" for w in words], [words[0]] * len(words)))
        yield k, " ".join(words), int(not bad)


def test_learns_what_statistics_show(spark):
    rows = list(texts(1, 900))
    docs = spark.createDataFrame([(i, t, "s", 1, "w") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = op.fit_quality(docs, labels)
    assert 0 < len(model.rules) < 60
    assert model == op.fit_quality(docs.repartition(5), labels.repartition(3))
    got = {r.doc_id: r.score for r in op.score_quality(docs, model).collect()}
    wrong = [i for i, _, y in rows if i % 2 == 0 and (got[i] >= 0.5) != y]
    assert len(wrong) <= 5
    assert all(0 <= s <= 1 for s in got.values())


def test_expressions_agree_with_the_rules(spark):
    model = op.RuleModel(-1.0, (op.Rule((op.Condition("digits", True, 0.1), op.Condition("log_words", False, 2.0)), 2.5),))
    df = spark.createDataFrame([(1, "a1", None, None, None), (2, "abc", None, None, None), (3, "1 " * 40, None, None, None)], SCHEMA)
    got = [r.score for r in op.score_quality(df, model).orderBy("doc_id").collect()]
    assert got == pytest.approx([1 / (1 + np.exp(-1.5)), 1 / (1 + np.exp(1)), 1 / (1 + np.exp(1))])


def test_nulls_empty_and_long_texts(spark):
    rows = [(1, None, None, None, None), (None, "", None, None, None), (3, " \n", None, None, None), (4, "word " * 60_000, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    known = op.with_statistics(df, "text", "s").select("s.*")
    assert known.columns == list(op.NAMES)
    got = known.collect()
    assert all(v is not None for r in got for v in r)
    assert got[0] == got[1]
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = op.fit_quality(df, none)
    assert [r.score for r in op.score_quality(df, model).collect()] == pytest.approx([0.5] * 4)
    assert op.score_quality(spark.createDataFrame([], SCHEMA), model).collect() == []
    one = spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    assert op.fit_quality(df, one).rules == ()


def test_lasso_drops_useless_columns():
    rng = np.random.default_rng(0)
    z = (rng.random((2000, 20)) < 0.5).astype(float)
    w, b = op._lasso(z, z[:, 3], 5e-3)
    assert w[3] > 2 and (np.abs(np.delete(w, 3)) < 0.1).all()


def test_the_sample_is_bounded_and_has_one_row_an_id(spark):
    rows = list(texts(2, 300))
    docs = spark.createDataFrame([(i, t, "s", 1, "w") for i, t, _ in rows] + [(7, f"copy {k} of a text", "s", 1, "w") for k in range(5_000)], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    seen = []
    fit = op.fit_rules
    try:
        op.fit_rules = lambda x, y, names: seen.append(len(y)) or fit(x, y, names)
        model = op.fit_quality(docs, labels)
        assert model == op.fit_quality(docs.repartition(7), labels.repartition(2))
        op.fit_quality(docs, labels, sample_rows=50)
    finally:
        op.fit_rules = fit
    assert seen[:2] == [300, 300] and 0 < seen[2] <= 50
    plan = op.first_rows(labels.groupBy("doc_id").agg({"quality": "max"}), 50, op.F.col("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan


def brute_score(model, stats):
    """Rules one by one."""
    total = model.bias
    for rule in model.rules:
        if all((stats[c.feature] > c.cut) == c.above for c in rule.conditions):
            total += rule.weight
    return 1 / (1 + np.exp(-total))


def test_scores_like_the_rules_one_by_one(spark):
    rows = list(texts(3, 400)) + [(900, "", 0), (901, None, 0), (902, "a " * 30_000, 1)]
    docs = spark.createDataFrame([(i, t, "s", 1, "w") for i, t, _ in rows], SCHEMA)
    model = op.fit_quality(docs, spark.createDataFrame([(i, y) for i, _, y in rows[:400]], "doc_id long, quality int"))
    stats = {r.doc_id: r.s for r in op.with_statistics(docs, "text", "s").select("doc_id", "s").collect()}
    got = {r.doc_id: r.score for r in op.score_quality(docs, model).collect()}
    assert model.rules and all(got[i] == pytest.approx(brute_score(model, stats[i])) for i in got)


def test_lasso_is_at_its_least():
    rng = np.random.default_rng(4)
    z = (rng.random((300, 5)) < 0.5).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * z[:, 0] - 1.5 * z[:, 1])))).astype(float)
    penalty = 0.01
    w, b = op._lasso(z, y, penalty)

    def loss(w, b):
        m = z @ w + b
        return np.mean(np.logaddexp(0, m) - y * m) + penalty * np.abs(w).sum()

    best = loss(w, b)
    for k in range(6):  # no step along any weight makes it better
        for step in (-0.05, 0.05):
            moved, c = w.copy(), b
            if k < 5:
                moved[k] += step
            else:
                c += step
            assert loss(moved, c) >= best - 1e-6
