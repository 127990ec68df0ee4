import random

from lodestack.llm import licenses as op

SCHEMA = "doc_id long, text string, line string, matches int"


def brute(text):
    text = text or ""
    lines = text.split("\n")
    spans = [*enumerate(lines, 1)] + ([(0, text)] if len(lines) > 1 else [])
    out = []
    for k, line in spans:
        own = set(op._plain(line))
        for name, forms in op.TEMPLATES.items():
            for form in forms:
                other = set(op._plain(form))
                dice = 2 * len(own & other) / (len(own) + len(other)) if own else 0
                if dice >= op.THRESHOLD:
                    out.append((k, name, dice))
    return sorted(out)


def run(spark, texts):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in op.scan_licenses(df).collect()}


def test_like_brute_force(spark):
    r = random.Random(1)
    forms = [f for own in op.TEMPLATES.values() for f in own]
    words = "licensed under the apache license version 2 0 mit released work this is general public".split()
    texts = [None, "", "\n", "the", "of " * 5000, "Licensed under the Apache License, Version 2.0. " * 50]
    for _ in range(150):
        lines = []
        for _ in range(r.randrange(1, 6)):
            line = r.choice(forms) if r.random() < 0.4 else " ".join(r.choice(words) for _ in range(r.randrange(1, 40)))
            line = line.split(" ")
            for _ in range(r.choice((0, 0, 1, 2))):
                line.insert(r.randrange(len(line) + 1), r.choice(words))
            lines.append(r.choice(("", "  ", "# ")) + " ".join(line))
        texts.append("\n".join(lines))
    got = run(spark, texts)
    for k, t in enumerate(texts):
        want = brute(t)
        assert [tuple(m) for m in got[k].matches] == want, t
        assert got[k].licenses == sorted({n for _, n, _ in want})
        assert got[k].n_matches == len(want) and got[k].best_dice == max((d for *_, d in want), default=0)


def test_every_template_finds_itself(spark):
    pairs = [(name, form) for name, own in op.TEMPLATES.items() for form in own]
    got = run(spark, [f for _, f in pairs])
    for k, (name, _) in enumerate(pairs):
        assert name in got[k].licenses and got[k].best_dice == 1


def test_empty_table(spark):
    assert run(spark, []) == {}
