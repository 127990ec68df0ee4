import random
import re

import pytest

from lodestack.llm import quote_linking as op

SCHEMA = "conv_id long, turn long, role string, text string, parent int, _conv string"


def parse(text):
    text = re.sub(op.ANNOUNCED, r"\1", text or "")
    for line in text.split("\n"):
        marks = re.match("((?:[ \t]*>)+)", line)
        rest = line[marks.end() :] if marks else line
        yield (marks[1].count(">") if marks else 0), line, re.sub("[\x20\x09-\x0d]+", " ", rest).strip(" ").lower()


def units(text):
    """(level, text, lines, whole) of passages and their lines: runs of lines of one level, up to a blank line."""
    run, out = [], []
    for level, _, norm in [*parse(text), (-1, "", "")]:
        if run and (not norm or level != run[0][0]):
            out += [(lv, n, 1, 0) for lv, n in run]
            if len(run) > 1:
                out.append((run[0][0], "\n".join(n for _, n in run), 0, len(run)))
            run = []
        if norm:
            run.append((level, norm))
    return out


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2], r[3] or ""))
        turns = sorted({r[1] for r in own})
        parent, linked = {}, {}
        for k, t in enumerate(turns):
            votes = {}
            for r in own:
                if r[1] != t:
                    continue
                for level, norm, n, whole in units(r[3]):
                    earlier = [q[1] for q in own if q[1] < t and any(lv == 0 and u == norm for lv, u, _, _ in units(q[3]))] if level else []
                    if earlier:
                        w, m = votes.get((-level, max(earlier)), (0, 0))
                        votes[-level, max(earlier)] = (w + whole, m + n)
            best = max(((lv, w, n, p) for (lv, p), (w, n) in votes.items()), default=None)
            parent[t] = best[3] if best else turns[k - 1] if k else None
            linked[t] = max(best[1], best[2]) if best else 0
        order, depth = [], {}
        todo = [(turns[0], 0)]
        while todo:  # depth first, earlier replies first
            t, d = todo.pop()
            order.append(t)
            depth[t] = d
            todo += [(u, d + 1) for u in reversed(turns) if parent[u] == t]
        place = {t: k for k, t in enumerate(order)}
        own.sort(key=lambda r: (place[r[1]], r[2], r[3] or ""))
        for k, r in enumerate(own, 1):
            text = "\n".join(line for level, line, _ in parse(r[3]) if level == 0).strip(" \t\n\x0b\x0c\r")
            out.append((*r[:3], text, parent[r[1]], linked[r[1]] > 0, linked[r[1]], turns[0], depth[r[1]], k))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in op.reply_order(df).collect()), key=repr)


def sample(seed):
    r = random.Random(seed)
    words = "alpha beta gamma delta Epsilon".split()
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(r.randrange(1, 9)):
            lines = [" ".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 4))]
            if texts and r.random() < 0.7:
                quoted = r.choice(texts).split("\n")
                lines = [r.choice(("On Monday she wrote:", "see"))] + [r.choice(("> ", ">", " > ")) + q.upper() for q in quoted] + lines
            texts.append("\n".join(lines))
            rows.append((conv, turn * 2, r.choice(("user", "assistant")), texts[-1]))
    return rows


def test_like_brute_force(spark):
    rows = sample(1)
    assert run(spark, rows) == brute(rows)


def test_branches_differ_from_the_order_of_turns(spark):
    rows = [(1, k, "user", t) for k, t in enumerate(["a", "b", "c", "> a\nd", "> b\ne", "f", "> a\ng", "> d\nh", "> f\ni"])]
    got = run(spark, rows)
    assert got == brute(rows)
    assert [r[1] for r in sorted(got, key=lambda r: r[-1])] == [0, 1, 2, 4, 5, 8, 3, 7, 6]


def test_whole_passages_come_before_lines(spark):
    rows = [(1, 0, "user", "one\ntwo\nthree"), (1, 1, "user", "one\n\ntwo\n\nthree\n\nfour"), (1, 2, "user", "x"), (1, 3, "user", "> one\n> two\n> three\n> four\ny"), (1, 4, "user", "> ONE\n>  two\n> three\nz")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert [r[4] for r in sorted(got, key=lambda r: r[1])] == [None, 0, 1, 1, 0]


@pytest.mark.parametrize("parts", [1, 13])
def test_parts_of_one_conversation(spark, parts):
    """Ranks and places do not depend on how many parts a conversation is dealt into."""
    r = random.Random(5)
    rows = []
    for k in range(150):
        text = f"line {k}"
        if k and r.random() < 0.4:
            text = f"> line {r.randrange(k)}\n{text}"
        rows += [(7, k, r.choice("ab"), text)] * r.choice((1, 1, 2))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nested_levels_and_a_long_chain(spark):
    rows = [(1, 0, "user", "first"), (1, 1, "user", "second"), (1, 2, "user", "third"), (1, 3, "assistant", "> > first\n> second\nanswer")]
    rows += [(2, k, "user", f"m{k}") for k in range(70)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert (1, 3, "assistant", "answer", 1, True, 1, 0, 2, 4) in got


def test_nulls_repeats_and_empty_table(spark):
    assert run(spark, []) == []
    rows = [(None, None, None, None), (None, 3, "user", ""), (5, 1, "user", "a"), (5, 1, "user", "a"), (5, 2, None, "> a\n>" + ">" * 900 + " deep")]
    got = run(spark, rows)
    assert len(got) == 5
    assert (None, None, None, "", None, False, 0, None, 0, 1) in got
    assert (5, 2, None, "", 1, True, 1, 1, 1, 3) in got
