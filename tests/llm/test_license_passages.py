import random
import textwrap

import pytest

from lodestack.llm import licenses as op

SCHEMA = "doc_id long, text string, licenses string, _pairs int, _id int"
SMALL = {"A": ("one two three four five six",), "B": ("one two three four five seven", "red red red green red blue"), "C": ("x y",)}


def words_of(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def brute(text, templates, t=op.THRESHOLD):
    """Every run of words against every template, then the best that are free."""
    words, runs = words_of(text), []
    pairs = [" ".join(words[k : k + 2]) for k in range(len(words) - 1)]
    for name, forms in templates.items():
        for form in forms:
            own = set(op._plain(form))
            low, high = len(own) * t / (2 - t), (len(words_of(form)) - 1) * (2 - t) / t
            for p in range(len(pairs)):
                best = None
                for q in range(p, len(pairs)):
                    if pairs[p] in own and pairs[q] in own and low - 1e-9 <= q - p + 1 <= high + 1e-9:
                        part = set(pairs[p : q + 1])
                        dice = 2 * len(part & own) / (len(part) + len(own))
                        if best is None or dice > best[0]:
                            best = (dice, q)
                if best and best[0] >= t:
                    runs.append((-best[0], p - best[1], p + 1, name, best[1] + 2))
    taken = []
    for m in sorted(runs):
        if all(m[4] < o[2] or o[4] < m[2] for o in taken):
            taken.append(m)
    return sorted((m[2], m[4], m[3], -m[0]) for m in taken)


def run(spark, texts, **more):
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in op.scan_passages(df, **more).collect()}


@pytest.mark.parametrize("templates", [SMALL, {n: f[:1] for n, f in op.TEMPLATES.items()}])
def test_like_brute_force(spark, templates):
    r = random.Random(7)
    forms = [f for own in templates.values() for f in own]
    vocabulary = sorted({w for f in forms for w in words_of(f)}) + ["other", "and"]
    texts = [None, "", "\n", "one", "x y", "x y " * 200, "red red red green red blue " * 20]
    for _ in range(120):
        out = []
        for _ in range(r.randrange(1, 5)):
            part = r.choice(forms).split(" ") if r.random() < 0.7 else [r.choice(vocabulary) for _ in range(r.randrange(1, 25))]
            for _ in range(r.choice((0, 0, 1, 2))):
                part.insert(r.randrange(len(part) + 1), r.choice(vocabulary))
            out.append(r.choice((" ", "\n", ", ")).join(part))
        texts.append(r.choice(("\n", " ")).join(out))
    got = run(spark, texts, templates=templates)
    for k, text in enumerate(texts):
        want = brute(text, templates)
        assert [tuple(m) for m in got[k].passages] == want, text
        assert got[k].licenses == sorted({m[2] for m in want}) and got[k].n_passages == len(want)
        assert got[k].best_dice == max((m[3] for m in want), default=0)


def test_wrapped_texts_inside_longer_documents(spark):
    r = random.Random(2)
    prose = lambda n: " ".join(r.choice("some words about the use of a thing and the people who made it".split()) for _ in range(n))
    wanted, texts = [], []
    for name, (form,) in op.WHOLE_TEXTS.items():
        for width in (40, 78, 100_000):
            lines = textwrap.wrap(form, width, break_long_words=False)
            for sign in ("", "# "):
                wanted.append([name])
                texts.append(f"{prose(80)}\n" + "\n".join(sign + line for line in lines) + f"\n\n{prose(200)}")
    wanted.append(["MIT"])
    texts.append("The code is released under the MIT License and the text is free to copy.")
    wanted.append(["ISC", "MIT"])
    texts.append(" ".join(op.WHOLE_TEXTS[n][0] for n in ("MIT", "ISC", "MIT")))
    wanted.append([])
    texts.append(prose(20_000))
    got = run(spark, texts)
    assert [got[k].licenses for k in range(len(texts))] == wanted
    assert all(got[k].n_passages == 1 for k in range(len(texts) - 2)) and got[len(texts) - 2].n_passages == 3


def test_every_template_is_its_own_license_alone(spark):
    pairs = [(name, form) for name, forms in op.PASSAGES.items() for form in forms]
    got = run(spark, [f for _, f in pairs])
    assert [got[k].licenses for k in range(len(pairs))] == [[name] for name, _ in pairs]


def test_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([(1, "x y", "x", 1, 2)], SCHEMA)
    plan = op.scan_passages(df, templates=SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_odd_tables(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(None, "x y", None, None, None), (3, "x y", None, None, None), (3, "x y", None, None, None)], SCHEMA)
    assert sorted((r.doc_id or -1, r.n_passages) for r in op.scan_passages(df, templates=SMALL).collect()) == [(-1, 1), (3, 1), (3, 1)]
    with pytest.raises(ValueError):
        op.scan_passages(df, templates={"A": ("one",)})


def test_the_query_finds_wrapped_and_embedded_texts(spark, tmp_path):
    """The registered query and its SQL over texts that the given tables lack."""
    import duckdb

    from lodestack.llm.queries import ORACLE_SQL, QUERIES

    r = random.Random(5)
    texts = [None, "", "This work is licensed under the GNU General Public License, version 3."]
    for name, forms in op.PASSAGES.items():
        texts += [f"Some words before.\n{textwrap.fill(form, 60)}\nand behind it" for form in forms]
        texts += [f"A paragraph with {form} and then more." for form in forms if len(form) < 300]
    sure = len(texts)
    for forms in op.TEMPLATES.values():
        for form in forms:
            words = form.split(" ")
            for _ in range(3):
                words.insert(r.randrange(len(words) + 1), "foreign")
            texts += [" ".join(words), f"{form} {form}\n{forms[0]}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op6_licenses"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["op6_licenses"])
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall())
    assert rows[2][1] == "GPL-3.0" and all(x[1] for x in rows[2:sure])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
