import random

import numpy as np
import pytest

from lodestack.llm import html_main_text as op

SCHEMA = "page_id long, url string, html string, text string, _host int, main string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return op.main_text(df).collect()


def test_suffix_array():
    r = random.Random(1)
    for n in (0, 1, 2, 50, 200):
        t = [r.randrange(3) for _ in range(n)]
        assert op.suffix_array(np.array(t, np.int64)).tolist() == sorted(range(n), key=lambda i: t[i:])
    assert op.suffix_array(np.zeros(300, np.int64)).tolist() == list(range(299, -1, -1))


def brute_repeated(pages, least):
    flat = [[(w, k) for k, b in enumerate(own) for w in b.split()] for own in pages]
    out = []
    for p, own in enumerate(flat):
        hit = [False] * len(own)
        for i in range(len(own) - least + 1):
            run_ = [w for w, _ in own[i : i + least]]
            if any([w for w, _ in o[j : j + least]] == run_ for q, o in enumerate(flat) if q != p for j in range(len(o) - least + 1)):
                hit[i : i + least] = [True] * least
        shares = []
        for k, b in enumerate(pages[p]):
            own_hits = [h for h, (_, at) in zip(hit, own) if at == k]
            shares.append(sum(own_hits) / len(own_hits) if own_hits else 0.0)
        out.append(shares)
    return out


def test_repeated_like_brute_force():
    r = random.Random(2)
    for _ in range(30):
        common = [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))) for _ in range(3)]
        pages = [
            [r.choice(common) if r.random() < 0.5 else " ".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 9))) for _ in range(r.randrange(0, 5))]
            for _ in range(r.randrange(1, 6))
        ]
        assert np.allclose(sum(op.repeated(pages, 4), []), sum(brute_repeated(pages, 4), []))


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a>b">One</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<article class="post"><h1>Head &amp; &lt;b&gt; &am</h1><p><b>First&nbsp;line &eacute;<br>goes
 on<p>Sec<i>ond</i> <a href='x'>link</a> 1 &lt; 2 < 3<div class="post-content">In div</div>
<div id="comments"><p>Reader</p></div><aside>Side</aside><form><p>Form</p></form><table><tr><td>a<td>b</tr></table></article>
<footer>&copy; x</footer></body></html>"""
TEXT = "Head & <b> &am\nFirst line é goes on\nSecond link 1 < 2 < 3\nIn div\na b"


def test_blocks_of_an_article(spark):
    got = run(spark, [(1, "https://a.example/x", PAGE), (2, "https://a.example/y", PAGE)])
    assert [(r.text, r.n_chars) for r in got] == [(TEXT, len(TEXT))] * 2


def test_boilerplate_of_pages_without_article(spark):
    menu = "home about us contact imprint terms of use"
    own = [f"this is the text of page number {k} and of no other {k}" for k in range(4)]
    rows = [(k, f"http://b.example:80/{k}", f"<div>{menu}</div><div>{own[k]}</div>tail {k}") for k in range(3)]
    rows.append((3, "http://c.example/3", f"<div>{menu}</div><div>{own[3]}</div>tail 3"))
    got = {r.page_id: r.text for r in run(spark, rows)}
    assert got == {**{k: f"{own[k]}\ntail {k}" for k in range(3)}, 3: f"{menu}\n{own[3]}\ntail 3"}


@pytest.mark.parametrize("broadcast", [100, 0])
def test_shards_of_a_large_host(spark, monkeypatch, broadcast):
    monkeypatch.setattr(op, "SHARD_CHARS", 2_000)
    monkeypatch.setattr(op, "MOST_BROADCAST", broadcast)
    menu = "home about us contact imprint terms of use"
    rows = [(k, f"http://b.example/{k}", f"<div>{menu}</div><p>own {' '.join(str(k * 100 + j) for j in range(20))}</p>") for k in range(60)]
    assert all(r.text.startswith("own") and "home" not in r.text for r in run(spark, rows))


def test_odd_pages(spark):
    odd = [None, "", "<", "<p", "a < b", "<script>x", "<p>a</div></p></b>", "<nav>" * 500 + "x", "<article></article>", "<div 'unclosed>t</div>", "<p>" + "long " * 200_000]
    rows = [(k, None if k % 2 else "no url", h) for k, h in enumerate(odd)] + [(None, None, "<p>z</p>")] * 2
    got = run(spark, rows)
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert [texts[k] for k in range(10)] == ["", "", "<", "", "a < b", "", "a", "", "", "t"]
    assert texts[10] == ("long " * 200_000).strip() and texts[None] == "z"
    assert run(spark, []) == []


def words_of(k, n):
    return " ".join(f"w{k}x{j}" for j in range(n))


@pytest.mark.parametrize("shard_chars", [8_000_000, 300])
def test_repeated_pages_without_article(spark, monkeypatch, shard_chars):
    monkeypatch.setattr(op, "SHARD_CHARS", shard_chars)
    menu = "home about us contact imprint terms of use"
    long = words_of(1, 80)
    rows = [(k, "http://d.example/same", f"<div>{menu}</div><p>{long}</p>") for k in range(3)]
    rows += [(3, "http://d.example/near", f"<div>{menu}</div><p>{long} and</p>"), (4, None, f"<p>{long}</p>"), (5, None, f"<p>{long}</p>")]
    rows += [(6, "http://d.example/other", f"<div>{menu}</div><p>{words_of(2, 80)}</p>")]
    got = {r.page_id: r.text for r in run(spark, rows)}
    assert got == {**{k: long for k in (0, 1, 2, 4, 5)}, 3: f"{long} and", 6: words_of(2, 80)}


def test_rare_runs_are_found_over_all_shards(spark, monkeypatch):
    note = "this note stands on just two pages here"
    rows = [(k, f"http://e.example/{k}", f"<div>{note if k < 2 else words_of(k + 500, 8)}</div><p>{words_of(k, 60)}</p>") for k in range(40)]
    small = {r.page_id: r.text for r in run(spark, rows)}
    monkeypatch.setattr(op, "SHARD_CHARS", 500)
    assert {r.page_id: r.text for r in run(spark, rows)} == small
    assert small[0] == words_of(0, 60) and small[1] == words_of(1, 60) and small[2].startswith("w502x0")


def test_names_of_furniture_and_of_the_text():
    furniture = ["ad", "ad-slot", "banner-728x90", "cookie-consent", "site-footer", "comment-list", "widget_newsletter", "social-share-buttons", "left-sidebar", "header"]
    text = ["market-share-analysis", "notice-period", "has-sidebar", "comment-on-the-vote", "additive", "menus-of-the-world", "post-content", "article-header", "728x90"]
    assert [n for n in furniture if not op.names_chrome(n, False)] == [] and [n for n in text if op.names_chrome(n, False)] == []
    assert not op.names_chrome("header", True)
    page = "<article><p class='market-share-analysis'>a</p><p>x <math><mi>y</mi></math> z</p><noscript>n</noscript><select><option>o</select><button>b</button></article>"
    assert [b.text for b in op.blocks(page) if b.inside and not b.chrome] == ["a", "x y z", "n"]


@pytest.mark.parametrize("unit", ["<b>x</i>", "<b><div>x</div>", "<li>x<b>", "<ul><li>x", "<select>x", "<td>x<dd>", "<!--x", "<a 'x>", "<p><span>x</p>", "<head>x"])
def test_parsing_takes_linear_time(unit):
    import time

    def seconds(n):
        began = time.perf_counter()
        op.blocks(unit * n)
        return time.perf_counter() - began

    seconds(500)
    assert min(seconds(16_000) for _ in range(2)) < 0.2 + 12 * min(seconds(4_000) for _ in range(3))


def brute_pages(pages):
    """Texts of unmarked pages of one host: a block goes if 0.8 of its tokens lie in runs of six that a page outside its family has; families by Jaccard 0.8 over runs of six."""
    runs = [{tuple(w[i : i + 6]) for w in [" ".join(own).split()] for i in range(max(1, len(w) - 5))} for own in pages]
    family = list(range(len(pages)))
    for a in range(len(pages)):
        for b in range(a):
            if pages[a] == pages[b] or len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]):
                old, new = family[a], family[b]
                family = [new if f == old else f for f in family]
    out = []
    for p, own in enumerate(pages):
        others = [pages[q] for q in range(len(pages)) if family[q] != family[p]]
        shares = brute_repeated([own, *others], 6)[0]
        out.append("\n".join(b for b, share in zip(own, shares) if share < 0.8))
    return out


@pytest.mark.parametrize("shard_chars,marked", [(8_000_000, True), (1_500, False)])
def test_whole_pages_like_brute_force(spark, monkeypatch, shard_chars, marked):
    monkeypatch.setattr(op, "SHARD_CHARS", shard_chars)
    r = random.Random(7)
    common = [words_of(900 + k, r.randrange(5, 14)) for k in range(6)]
    pages = []
    for k in range(40):
        if pages and r.random() < 0.25:
            own = list(r.choice(pages))
            own[-1] += r.choice(("", " and", " " + words_of(k, 40)))
        else:
            own = [c for c in common if r.random() < 0.4] + [words_of(k * 10 + j, r.randrange(3, 40)) for j in range(r.randrange(1, 4))]
        pages.append(own)
    rows = [(k, "http://f.example/x", ("<article>{}</article>" if marked else "{}").format("".join(f"<p>{b}</p>" for b in own)), "x", 1, "y") for k, own in enumerate(pages)]
    got = op.main_text(spark.createDataFrame(rows, SCHEMA), trust_articles=not marked)
    assert [r.text for r in sorted(got.collect())] == brute_pages(pages)


def test_hidden_text_of_an_article_is_its_text(spark):
    page = "<article><p>shown here</p><p hidden>one</p><div style='display:none'>two</div><p aria-hidden='true'>three</p><div class='cookie-notice' hidden>four</div></article>"
    assert run(spark, [(1, "http://h/1", page)])[0].text == "shown here\none\ntwo\nthree"


def test_a_mark_that_holds_a_teaser_only_is_not_trusted(spark):
    own = " ".join(f"word{k}" for k in range(60))
    page = f"<body><nav>menu of the site</nav><main><p>teaser of the day</p></main><div><h1>Title</h1><p>{own}</p></div><footer>made by us</footer></body>"
    other = page.replace(own, " ".join(f"other{k}" for k in range(60))).replace("Title", "Heading")
    got = {r.page_id: r.text for r in run(spark, [(1, "http://h/1", page), (2, "http://h/2", other)])}
    assert got[1].split("\n")[-2:] == ["Title", own] and "menu" not in got[1] and "made by" not in got[1]
    assert got[2].split("\n")[-2] == "Heading"
    equal = "<main><p>aaaa</p></main><p>bbbb</p>"
    assert [r.text for r in run(spark, [(1, "http://h/1", equal)])] == ["aaaa"]


def test_common_runs_like_brute_force():
    r = random.Random(3)
    for _ in range(100):
        pages = [[r.choice("abc") for _ in range(r.randrange(12))] for _ in range(r.randrange(1, 7))]
        for holders in (1, 2, 3):
            runs = {h for own in pages for h in op.windows(own, 3)}
            assert op.common_runs(pages, holders, 3) == sorted(h for h in runs if sum(h in op.windows(own, 3) for own in pages) >= holders)


def test_template_within_marked_articles(spark):
    follow, shared = "follow us on the usual channels and miss no story", "a line that some articles of a host have in common"

    def page(k, *more):
        return f"<nav>menu</nav><article><p>{words_of(k, 40)}</p>{''.join(f'<p>{m}</p>' for m in more)}</article><footer>made by us</footer>"

    rows = [(k, f"http://a.example/{k}", page(k, follow, *[shared] * (k < 4))) for k in range(8)]
    # too few pages for a template, near copies of one page, and a main element that holds the template alone
    rows += [(10 + k, f"http://b.example/{k}", page(10 + k, follow)) for k in range(4)]
    rows += [(20 + k, f"http://c.example/{k}", page(20, follow, f"number {k}")) for k in range(8)]
    rows += [(30 + k, f"http://d.example/{k}", f"<main><p>{words_of(99, 30)}</p></main><div><p>{words_of(30 + k, 20)}</p></div>") for k in range(8)]
    got = {r.page_id: r.text for r in run(spark, rows)}
    assert got == {
        **{k: "\n".join([words_of(k, 40), *[shared] * (k < 4)]) for k in range(8)},
        **{10 + k: f"{words_of(10 + k, 40)}\n{follow}" for k in range(4)},
        **{20 + k: f"{words_of(20, 40)}\n{follow}\nnumber {k}" for k in range(8)},
        **{30 + k: words_of(30 + k, 20) for k in range(8)},
    }


def brute_articles(pages):
    """Texts of marked pages of one host: a block goes if 0.8 of its tokens lie in runs of six that three quarters of the pages and of the families hold, five families at least."""
    flat = [tuple(" ".join(own).split()) for own in pages]
    runs = {w: {w[i : i + 6] for i in range(max(1, len(w) - 5))} for w in flat}
    distinct = list(runs)
    family = {w: k for k, w in enumerate(distinct)}
    for a in distinct:
        for b in distinct:
            if len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]):
                family = {w: family[a] if f == family[b] else f for w, f in family.items()}
    held = {}
    for w in distinct:
        for x in runs[w]:
            held.setdefault(x, []).append(family[w])
    template = {x for x, f in held.items() if len(f) >= 0.75 * len(distinct) and len(set(f)) >= max(5, 0.75 * len(set(family.values())))}
    out = []
    for own, w in zip(pages, flat):
        hit = [any(w[j : j + 6] in template for j in range(max(0, i - 5), i + 1)) for i in range(len(w))]
        kept, at = [], 0
        for b in own:
            n = len(b.split())
            kept += [b] if sum(hit[at : at + n]) < 0.8 * n else []
            at += n
        out.append("\n".join(kept))
    return out


@pytest.mark.parametrize("chars,least", [(1_000_000, 10), (1_500, 2)])
def test_marked_pages_like_brute_force(spark, monkeypatch, chars, least):
    monkeypatch.setattr(op, "TEMPLATE_CHARS", chars)
    monkeypatch.setattr(op, "TEMPLATE_PAGES", least)
    r = random.Random(11)
    rows, want = [], []
    for host in range(5):
        common = [(words_of(900 + 10 * host + k, r.randrange(6, 12)), share) for k, share in enumerate((0.97, 0.85, 0.75, 0.7, 0.3))]
        pages = []
        for k in range((4, 9, 20, 30, 40)[host]):
            if pages and r.random() < 0.2:
                own = list(r.choice(pages))
                own[-1] += r.choice(("", " and"))
            else:
                own = [c for c, share in common if r.random() < share] + [words_of(10_000 * host + k * 10 + j, r.randrange(3, 40)) for j in range(r.randrange(1, 4))]
                r.shuffle(own)
            pages.append(own)
        rows += [(100 * host + k, f"http://h{host}.example/{k}", f"<article>{''.join(f'<p>{b}</p>' for b in own)}</article>") for k, own in enumerate(pages)]
        want += brute_articles(pages)
    got = [r.text for r in sorted(run(spark, rows))]
    assert sum("\n".join(op.divided(op.blocks(h))[0]) != w for (_, _, h), w in zip(rows, want)) > 20
    assert got == want
