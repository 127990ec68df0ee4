import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as T


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'double' if isinstance(values[n], float) else 'string'}" for n in names))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,steps,answer",
    [
        ('{"reasoning":"r","final_answer":"a"}', ["r"], "a"),
        ('{"reasoning":[" x ",""],"answer":"b"}', ["x"], "b"),
        ('note {"final_answer":"z"} end', [], "z"),
        ('Steps:\n- one\n"two"\nFinal answer: "x"', ["Steps:", "one", "two"], "x"),
        ('["a","b","c"]', ["a", "b"], "c"),
        ('{"reasoning":["r"]}', [], '{"reasoning":["r"]}'),
        ('{"final_answer": "x"', [], '{"final_answer": "x"'),
        (None, [], ""),
        ('{"reasoning":[true,null,1],"answer":5}', ["True", "None", "1"], "5"),
        ("  plain \n", [], "plain"),
        ('["s1", "s2"] final_answer: done', ["s1", "s2"], "done"),
    ],
)
def test_split_reasoning(spark, text, steps, answer):
    got = one(spark, T.split_reasoning(F.col("t")), t=text)
    assert (got.reasoning, got.answer) == (steps, answer)


def test_joined_reasoning(spark):
    df = spark.createDataFrame([(["A. ", "B..", ""], "C"), ([], "C"), (None, "C"), (["..", "x"], "C")], "r array<string>, a string")
    assert [r.x for r in df.select(T.joined_reasoning(F.col("r"), F.col("a")).alias("x")).collect()] == ["A. B. C", "C", "C", ". x. C"]


def test_normalized_claim(spark):
    texts = [" a \t b c ", "x" * 600, "y" * 700, "word " * 140, None, "a\x1cb　c"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.x for r in df.orderBy("k").select(T.normalized_claim(F.col("t")).alias("x")).collect()]
    for t, x in zip(texts, got):
        t = " ".join((t or "").split())
        assert x == (t if len(t) <= 600 else t[:597].rsplit(" ", 1)[0] + "...")


def test_rounding_as_python_does(spark):
    r = random.Random(1)
    values = [k / 10000 for k in range(0, 10001)] + [r.random() * 10 ** r.randrange(-3, 6) for _ in range(2000)] + [0.0, 0.5, 2.5, 1e-9, 123456.0005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    v = F.col("v")
    got = df.select("v", *(T.fixed(v, d).alias(f"f{d}") for d in (1, 3)), *(T.rounded(v, d).alias(f"r{d}") for d in (2, 4, 6)), T.rounded(-v, 2).alias("n2")).collect()
    for row in got:
        assert (row.f1, row.f3) == (f"{row.v:.1f}", f"{row.v:.3f}")
        assert (row.r2, row.r4, row.r6, row.n2) == (round(row.v, 2), round(row.v, 4), round(row.v, 6), round(-row.v, 2))


def test_vocabularies(spark):
    df = spark.createDataFrame([("Faults are visible.",), ("A FAULT.",), ("éno",), ("not  visible",), ("not visible",)], "t string")
    rows = df.select(T.mentions(F.col("t"), T.FAULT_TERMS), T.mentions(F.col("t"), T.ABSENCE_TERMS)).collect()
    assert [tuple(r) for r in rows] == [(False, False), (True, False), (False, False), (False, False), (False, True)]


def test_human_bytes(spark):
    df = spark.createDataFrame([(1023,), (1536,), (0,), (5 * 1024**3,), (2**60,)], "n bigint")
    assert [r.x for r in df.select(T.human_bytes(F.col("n")).alias("x")).collect()] == ["1023.0 B", "1.5 KB", "0.0 B", "5.0 GB", "1048576.0 TB"]


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.tar.gz",), ("x",), ("a/.hidden",), ("/r/n.PNG",)], "p string")
    got = df.select(T.file_name(F.col("p")), T.suffix(F.col("p")), T.stem(F.col("p")), T.parent(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("c.tar.gz", ".gz", "c.tar", "a/b"), ("x", "", "x", ""), (".hidden", "", ".hidden", "a"), ("n.PNG", ".PNG", "n", "/r")]
    paths = ["a/b.png", "a/b-x/c.png", "a/b/c.png"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.p for r in df.orderBy(T.path_order(F.col("p"))).collect()] == ["a/b/c.png", "a/b-x/c.png", "a/b.png"]


def test_replies(spark):
    def reply(t, **how):
        return tuple(one(spark, T.reply_text(F.col("t"), **how), t=t))

    assert reply('{"choices":[{"message":{"content":" hi "}}]}') == ("hi", None)
    assert reply('{"choices":[{"message":{"content":[{"text":"a"},{"text":" "},3,{"text":"b"}]}}]}') == ("a\nb", None)
    assert reply('{"choices":[{"message":{"text":"t"}}]}') == ("t", None)
    assert reply('{"choices":[]}')[1].startswith("response has no choices")
    only = '{"choices":[{"message":{"content":"","reasoning":" why "}}]}'
    assert reply(only)[0] is None and reply(only, reasoning_as_content=True) == ("why", None)
    both = '{"choices":[{"message":{"content":"yes","reasoning":"why"}}]}'
    assert reply(both, include_reasoning=True) == ('{"reasoning":["why"],"final_answer":"yes"}', None)
    own = r'{"choices":[{"message":{"content":"{\"final_answer\":\"x\"}","reasoning":"why"}}]}'
    assert reply(own, include_reasoning=True) == ('{"final_answer":"x","reasoning":["why"]}', None)


def test_templates_urls_and_decodings(spark):
    assert one(spark, T.rendered("a {q} {{b}} {q}", q=F.col("t")), t="X") == "a X {b} X"
    assert one(spark, T.data_url(F.col("t").cast("binary")), t="x" * 100).count("\n") == 0
    df = spark.createDataFrame([(["", "<unk>", "<unk> so Answer: yes "],), ([],)], "c array<string>")
    assert [r.x for r in df.select(T.chosen_decoding(F.col("c")).alias("x")).collect()] == ["yes", ""]


def test_why_a_reply_has_no_text(spark):
    def why(t):
        return one(spark, T.reply_text(F.col("t")), t=t).error

    only = '{"choices":[{"message":{"content":"","reasoning":"it\'s\\nso"},"finish_reason":"length"}]}'
    assert why(only) == 'response has reasoning and no content (finish_reason=length): "it\'s\\nso"'
    assert why('{"choices":[{"message":{"content":""}}]}').startswith("response has an empty message (finish_reason=None): {")
    assert why('{"choices":[{"message":{"content":""},"finish_reason":"stop"}]}').startswith("response has an empty message (finish_reason=stop): {")


def test_quoted_texts(spark):
    texts = ["", "a", "it's", 'say "x"', "it's \"x\"", "back \\ stroke", "line\nend\r\ttab", "bell \x07 del \x7f soft \xad", "é 漢 🙂"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r.x for r in df.orderBy("k").select(T.quoted(F.col("t")).alias("x")).collect()] == [repr(t) for t in texts]
    note = df.filter("k = 6").select(T.chosen_decoding(F.array(F.lit(""), F.lit("<unk>")), F.array(F.lit(1), F.lit(2))).alias("x")).first().x
    assert note == "[empty decoded output] raw='<unk>' token_ids=[1, 2]"


def test_strip_and_steps_read_a_text_once(spark):
    """Stripping gives what the expression and str.strip() give, and needs no expression; joined steps stand once in their paragraph."""
    odd = ["", " ", "\t\x1c a b 　\n", "\x85x .", "​x​", "₩  ", " 'a' \\s ", "a\n\n", "- x -"]
    df = spark.createDataFrame([(t,) for t in [*odd, None]], "t string")
    old = F.regexp_replace("t", f"^[{T.WS}]+|[{T.WS}]+$", "")
    rows = df.select("t", T.strip(F.col("t")).alias("new"), old.alias("old")).collect()
    assert all(r.new == r.old and (r.t is None or r.new == r.t.strip()) for r in rows)
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan(T.strip(F.col("t")))
    assert plan(T.joined_reasoning(F.array("t"), F.lit("A"))).count("array_join") == 1
