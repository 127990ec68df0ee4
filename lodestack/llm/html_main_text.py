"""Main text of web pages: parsed blocks, and a suffix array over each host's pages for boilerplate."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import drop_stored, sent, stored
from lodestack.llm.shingle_dedup import BATCH, near_copies

#: Tokens of the shortest run that counts as repeated, and the share of a block that such runs must cover.
RUN_TOKENS = 6
COVERED = 0.8
#: Characters of HTML of one host that share a suffix array, about. Larger hosts are dealt into shards by hash of the page.
SHARD_CHARS = 8_000_000
#: Hosts with several shards that are broadcast at most; more of them are joined by a shuffle.
MOST_BROADCAST = 100_000
#: A run of words is of a host's template if this share of the host's pages holds it, this share of their families of near copies, and so many families at least.
TEMPLATE_SHARE, TEMPLATE_FAMILIES = 0.75, 5
#: Characters of HTML of one host that share a suffix array where templates are sought, about, and pages at least.
TEMPLATE_CHARS, TEMPLATE_PAGES = 1_000_000, 10

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE_TAGS = frozenset("br td th".split())
#: Scripts, styles, what is no part of the text, and the controls of forms.
DROPPED_TAGS = frozenset("script style template textarea iframe select button head title".split())
CHROME_TAGS = frozenset("nav aside form footer menu dialog search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status".split())
#: Parts of class names and ids that name menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo sponsor sponsored cookie cookies consent gdpr notice notices notification notifications alert popup modal "
    "newsletter subscribe signup login share sharing social sidebar aside comment comments disqus respond breadcrumb breadcrumbs menu menubar nav navbar navigation "
    "pagination pager toolbar masthead topbar header footer form search".split()
)
#: Parts that may stand beside those and say only where or what kind of box it is. A name with any other part is a name of the text's own: market-share-analysis.
NEUTRAL_NAMES = frozenset(
    "site global main primary secondary top bottom left right upper lower inner outer sticky fixed mobile desktop js widget widgets box bar block item items list links link wrap "
    "wrapper container area section panel slot unit group message text policy button buttons icon icons media overlay form field skip to inline large small id".split()
)
#: A start tag of the first closes an open element of the second.
LISTS = ("ul", "ol", "dl", "table", "menu")
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass
class Block:
    text: str
    #: within article or main
    inside: bool
    #: within a menu, footer, advert, form and the like
    chrome: bool


def is_chrome(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is furniture of the page by its tag, role, class or id. Whether it is shown does not matter: hidden text of an article is its text."""
    if tag in CHROME_TAGS or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "role" and value in CHROME_ROLES:
            return True
        if name in ("class", "id") and any(names_chrome(one, inside) for one in value.split()):
            return True
    return False


def names_chrome(name: str, inside: bool) -> bool:
    """Whether a class name or id says furniture: one part of it does, and all others are neutral or numbers. An article's own header is its text."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name) if p and not p[0].isdigit()]
    named = {p for p in parts if p in CHROME_NAMES}
    if inside and named == {"header"}:
        return False
    return bool(named) and all(p in CHROME_NAMES or p in NEUTRAL_NAMES for p in parts)


class _Open:
    """The open elements of a page, with what the parser asks of them kept up to date, so that no question walks through them all."""

    def __init__(self) -> None:
        self.tags, self.flags = [""], [(False, False)]
        self.count: dict[str, int] = {}
        #: places of block elements, and of those that a list item, cell or the like may close
        self.blocks: list[int] = []
        self.closable: list[int] = []

    def push(self, tag: str, inside: bool, chrome: bool) -> None:
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.tags))
        if tag in CLOSES or tag in LISTS:
            self.closable.append(len(self.tags))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.tags.append(tag)
        self.flags.append((inside, chrome))

    def place(self, tag: str) -> int:
        """The innermost open element of this tag, or 0; what lies above it is about to be closed, so the walk is paid for."""
        if not self.count.get(tag):
            return 0
        k = len(self.tags) - 1
        while self.tags[k] != tag:
            k -= 1
        return k

    def paragraph(self) -> int:
        """The innermost block element, if it is a paragraph."""
        return self.blocks[-1] if self.blocks and self.tags[self.blocks[-1]] == "p" else 0

    def closed_by(self, tag: str) -> int:
        for k in reversed(self.closable):
            if self.tags[k] in CLOSES[tag]:
                return k
            if self.tags[k] in LISTS:
                return 0
        return 0

    def cut(self, k: int) -> bool:
        """Closes element k and all within it; whether a block ends by that."""
        ends = self.flags[-1] != self.flags[k - 1] or any(f != self.flags[k - 1] for f in self.flags[k:])
        for tag in self.tags[k:]:
            self.count[tag] -= 1
            ends = ends or tag in BLOCK_TAGS
        del self.tags[k:], self.flags[k:]
        for places in (self.blocks, self.closable):
            while places and places[-1] >= k:
                places.pop()
        return ends


def blocks(page: str) -> list[Block]:
    """The visible blocks of a page in order, in time linear in its length. Never fails: what is not a tag is text, unclosed elements end with the page."""
    out: list[Block] = []
    held: list[str] = []
    stack = _Open()
    endless: set[str] = set()  # tags without a further end, so it is not sought again

    def flush(flags: tuple[bool, bool] | None = None) -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append(Block(text, *(flags or stack.flags[-1])))

    def close(k: int) -> None:
        flags = stack.flags[-1]
        if k and stack.cut(k):
            flush(flags)

    def behind(tag: str, at: int) -> int:
        """Where the text behind a dropped element goes on."""
        if tag in endless:
            return at
        end = re.compile(r"</head\b|<body\b" if tag == "head" else rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
        if end:
            return end.start() if tag == "head" else end.end()
        endless.add(tag)
        return len(page) if tag in ("script", "style", "textarea", "title") else at

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        begin = m.start() if m else len(page)
        if begin > at:
            held.append(html.unescape(page[at:begin]))
        if not m:
            break
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, attributes = tag.lower(), m["attrs"] or ""
        if m["end"] or m["end2"]:
            if tag in ("p", "br") or tag in BLOCK_TAGS:
                flush()
            close(stack.place(tag))
            continue
        if tag in DROPPED_TAGS:
            if tag == "head" or not attributes.endswith("/"):
                at = behind(tag, at)
            continue
        if tag in BLOCK_TAGS:
            flush()
            close(stack.paragraph())  # an open paragraph ends where a block begins
        if tag in CLOSES:
            close(stack.closed_by(tag))
        if tag in SPACE_TAGS:
            held.append(" ")
        if tag in VOID_TAGS or attributes.endswith("/"):
            continue
        inside, chrome = stack.flags[-1]
        own = chrome or is_chrome(tag, attributes, inside)
        if own != chrome:
            flush()
        stack.push(tag, inside or tag in ("article", "main"), own)
    flush()
    return out


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Start of each suffix in order, by doubling the length that ranks compare."""
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order[1:]] = np.cumsum(tokens[order[1:]] != tokens[order[:-1]])
    step = 1
    while n and rank[order[-1]] < n - 1:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if step < n else rank[:0]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        step *= 2
    return order


def run_groups(tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and where in it each group of suffixes begins that agree in `least` tokens."""
    order = suffix_array(tokens)
    padded = np.concatenate((tokens, np.full(least, np.iinfo(np.int64).min)))
    same = np.ones(len(order) - 1, bool)  # neighbours that agree in `least` tokens
    for k in range(least):
        same &= padded[order[1:] + k] == padded[order[:-1] + k]
    return order, np.concatenate(([0], np.flatnonzero(~same) + 1))


def windows(words: Sequence[str], least: int = RUN_TOKENS) -> list[int]:
    """A signed 64-bit hash of each run of `least` words, in order."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(" ".join(words[k : k + least])) for k in range(len(words) - least + 1)], np.uint64).view(np.int64).tolist()


def repeated(pages: Sequence[Sequence[str]], least: int = RUN_TOKENS, families: Sequence[int] | None = None, known: Sequence[frozenset[int]] = ()) -> list[list[float]]:
    """For each block of each page, the share of its tokens in runs of `least` tokens or more that another page has too.

    families: a number a page; pages of one family do not count as others. known: for each page, hashes of windows() that are repeated elsewhere.
    """
    words = [[b.split() for b in own] for own in pages]
    ids: dict[str, int] = {}
    stream, of_page = [], []
    for p, own in enumerate(words):
        for b in own:
            stream += [ids.setdefault(w, len(ids)) for w in b]
            of_page += [families[p] if families is not None else p] * len(b)
        stream.append(-1 - p)  # unlike all else, so no run goes on into the next page
        of_page.append(families[p] if families is not None else p)
    tokens, page = np.array(stream, np.int64), np.array(of_page, np.int64)
    covered = np.zeros(len(tokens) + 1, np.int64)
    if len(tokens) > least:
        order, cuts = run_groups(tokens, least)
        first, last = np.minimum.reduceat(page[order], cuts), np.maximum.reduceat(page[order], cuts)
        starts = order[np.repeat(first != last, np.diff(cuts, append=len(order)))]
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + least, -1)
    begin = 0
    for own, hits in zip(words, known):
        if hits:
            for k, h in enumerate(windows([w for b in own for w in b], least)):
                if h in hits:
                    covered[begin + k] += 1
                    covered[begin + k + least] -= 1
        begin += sum(map(len, own)) + 1
    inside = np.cumsum(covered[:-1]) > 0
    out, at = [], 0
    for own in words:
        shares = []
        for b in own:
            shares.append(float(inside[at : at + len(b)].mean()) if b else 0.0)
            at += len(b)
        out.append(shares)
        at += 1
    return out


def common_runs(pages: Sequence[Sequence[str]], holders: int, length: int = RUN_TOKENS) -> list[int]:
    """Hashes, as windows() gives them, of the runs of `length` words that `holders` pages or more have, found by a suffix array over the words of all."""
    words = [w for own in pages for w in (*own, None)]
    ids, _ = pd.factorize(np.array(words, object))  # none: -1
    page = np.repeat(np.arange(len(pages)), [len(own) + 1 for own in pages])
    tokens = np.where(ids < 0, -1 - page, ids)  # what ends a page is unlike all else, so no run goes on into the next
    if len(tokens) <= length:
        return []
    order, cuts = run_groups(tokens, length)
    size = np.diff(cuts, append=len(order))
    some = np.repeat(size >= holders, size)
    held = np.unique(np.repeat(np.arange(len(cuts)), size)[some] * len(pages) + page[order[some]]) // len(pages)
    starts = order[cuts[np.bincount(held, minlength=len(cuts)) >= holders]]
    runs = (words[k : k + length] for k in starts.tolist())
    return sorted(h for own in runs if len(own) == length and None not in own for h in windows(own, length))


def of_template(own: Sequence[str], hits: frozenset[int], least: int = RUN_TOKENS) -> list[bool]:
    """Whether each block of a page is covered by runs whose hashes are in `hits`. Runs go on from block to block."""
    words = [b.split() for b in own]
    if not hits:
        return [False] * len(words)
    covered = np.zeros(sum(map(len, words)), bool)
    for k, h in enumerate(windows([w for b in words for w in b], least)):
        if h in hits:
            covered[k : k + least] = True
    ends = np.cumsum([0, *map(len, words)])
    return [bool(covered[i:j].mean() >= COVERED) if j > i else False for i, j in zip(ends, ends[1:])]


def divided(found: Sequence[Block], hits: frozenset[int] = frozenset(), trust_articles: bool = True) -> tuple[list[str], list[str], list[str]]:
    """main, loose, rest: the blocks of a marked article, if the mark is to be trusted; else those that are not furniture by their markup; all others.

    hits: the runs of the host's template. What they cover is no text of an article and counts for nothing when a mark is weighed: it is trusted if what it holds besides is at
    least half of the page's text that is no furniture; one that holds a teaser or a part of the template is not.
    """
    text = [b for b in found if not b.chrome]
    common = of_template([b.text for b in text], hits)
    own, other = (sum(len(b.text) for b, t in zip(text, common) if b.inside == inside and not t) for inside in (True, False))
    chrome = [b.text for b in found if b.chrome]
    if trust_articles and own > 0 and own >= other:
        kept = [b.inside and not t for b, t in zip(text, common)]
        return [b.text for b, k in zip(text, kept) if k], [], [*chrome, *(b.text for b, k in zip(text, kept) if not k)]
    return [], [b.text for b in text], chrome


def _parsed(rows: DataFrame) -> DataFrame:
    """rows without _html, but with `blocks`, and `inside` and `chrome` of each."""
    names = [c for c in rows.columns if c != "_html"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(x.as_py() or "") for x in batch.column("_html")]
            texts = pa.array([[b.text for b in own] for own in found], pa.list_(pa.string()))
            flags = [pa.array([[getattr(b, n) for b in own] for own in found], pa.list_(pa.bool_())) for n in ("inside", "chrome")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), texts, *flags], [*names, "blocks", "inside", "chrome"])

    return rows.mapInArrow(of, f"{_kinds(rows, names)}, blocks array<string>, inside array<boolean>, chrome array<boolean>")


def _kinds(rows: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)


def _divided(parsed: DataFrame, trust_articles: bool) -> DataFrame:
    """divided() for each row: main, loose and rest instead of blocks, inside, chrome and _template, the runs of the host's template."""
    names = [c for c in parsed.columns if c not in ("blocks", "inside", "chrome", "_template")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("blocks", "inside", "chrome", "_template")]
            found = [divided([Block(*b) for b in zip(*own)], frozenset(hits or ()), trust_articles) for *own, hits in zip(*columns)]
            lists = [pa.array([f[k] for f in found], pa.list_(pa.string())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *lists], [*names, "main", "loose", "rest"])

    return parsed.mapInArrow(of, f"{_kinds(parsed, names)}, main array<string>, loose array<string>, rest array<string>")


def _articles(rows: DataFrame) -> DataFrame:
    """_id, _url, text of pages of hosts without a template that all mark their articles."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(divided(blocks(x.as_py() or ""))[0]) for x in batch.column("_html")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string())], ["_id", "_url", "text"])

    return rows.select("_id", "_url", "_html").mapInArrow(of, f"{_kinds(rows, ['_id', '_url'])}, text string")


def _sought(rows: DataFrame) -> DataFrame:
    """(_host, _loose, _runs): for each shard of a host whether one of its pages has text and no mark to trust, and the runs that TEMPLATE_SHARE of its different pages hold.

    A suffix array over a shard's text that is no furniture by its markup finds the runs. What so many pages of a host hold, so many of one shard hold, whichever way they are dealt, so the
    shards' runs hold all of the host's. Pages of equal text are dealt to one shard, and each task sends one of them.
    """
    share, least = TEMPLATE_SHARE, TEMPLATE_FAMILIES
    most = F.least(F.ceil(F.sum(F.length("_html")) / TEMPLATE_CHARS), F.ceil(F.count(F.lit(1)) / TEMPLATE_PAGES))
    large = stored(rows.groupBy(F.col("_host").alias("_of")).agg(most.cast("int").alias("_shards")).filter("_shards > 1"), "template-hosts")
    dealt = rows.join(sent(large, most=MOST_BROADCAST), F.col("_host") == F.col("_of"), "left").select("_host", F.coalesce("_shards", F.lit(1)).alias("_shards"), "_html")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int, bool]] = set()
        for batch in batches:
            out = []
            for host, n, page in zip(*(batch.column(k) for k in range(3))):
                host, found = host.as_py(), blocks(page.as_py() or "")
                text = " ".join(b.text for b in found if not b.chrome)
                row = (host, xxhash.xxh64_intdigest(text) >> 1, bool(divided(found)[1]))
                if row not in seen:
                    seen.add(row)
                    out.append((host, n.as_py(), *row[1:], text))
            columns = list(zip(*out)) or [()] * 5
            types = (pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["_host", "_shards", "_text_hash", "_loose", "_text"])

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        once = pdf.drop_duplicates("_text_hash")
        holders = max(int(np.ceil(share * len(once) - 1e-9)), least if once["_shards"].iloc[0] == 1 else 1)
        found = common_runs([t.split() for t in once["_text"]], holders) if len(once) >= holders else []
        return pd.DataFrame({"_host": [pdf["_host"].iloc[0]], "_loose": [bool(pdf["_loose"].any())], "_runs": [found]})

    texts = dealt.mapInArrow(of, "_host string, _shards int, _text_hash bigint, _loose boolean, _text string")
    # one key for host and shard, as in main_text()
    texts = texts.withColumn("_shard", F.concat_ws(" ", F.pmod("_text_hash", F.col("_shards")), "_host"))
    return stored(texts.groupBy("_shard").applyInPandas(runs, "_host string, _loose boolean, _runs array<bigint>"), "template-runs")


def _templates(parsed: DataFrame, sought: DataFrame) -> DataFrame:
    """(_templated, _template): hosts and the runs of their templates, of those that were found in one shard or more: pages and families that hold them are counted over the whole host.

    parsed: pages of these hosts, with `blocks` and `chrome`.
    """
    asked = sought.filter(F.size("_runs") > 0).select("_host", F.explode("_runs").alias("run")).groupBy("_host").agg(F.collect_set("run").alias("_runs"))
    asked = stored(asked.select(F.col("_host").alias("_asked"), "_runs"), "template-asked")
    kept = F.transform(F.filter(F.arrays_zip("blocks", "chrome"), lambda b: ~b["chrome"]), lambda b: b["blocks"])
    texts = parsed.select("_host", F.array_join(kept, " ").alias("text")).withColumn("page", F.xxhash64("_host", "text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, BATCH) for b in batches for k in range(0, b.num_rows, BATCH)):
            out = []
            for host, page, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(host, page, h) for h in set(windows(text.split())) & set(runs)]
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["host", "page", "run"])

    asking = texts.join(sent(asked, most=MOST_BROADCAST), F.col("_host") == F.col("_asked")).select("_host", "page", "text", "_runs")
    held = stored(asking.mapInArrow(of, "host string, page bigint, run bigint").distinct(), "template-holders")
    pages = texts.select("_host", "page").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("of_all"))
    enough = F.col("n") >= F.greatest(F.lit(TEMPLATE_FAMILIES), TEMPLATE_SHARE * F.col("of_all") - 1e-9)
    found = held.groupBy("host", "run").agg(F.count(F.lit(1)).alias("n")).join(pages, F.col("host") == F.col("_host")).filter(enough)
    found = stored(found.select(F.col("host").alias("_of"), F.col("run").alias("_run")), "template-of-pages")
    if found.isEmpty():
        return found.select(F.col("_of").alias("_templated"), F.array("_run").alias("_template"))
    # families are sought where pages alone make a template
    texts = texts.join(sent(stored(found.select("_of").distinct(), "template-seekers"), most=MOST_BROADCAST), F.col("_host") == F.col("_of"), "left_semi")
    family = near_copies(texts.select(F.col("page").alias("doc_id"), "text"), size=RUN_TOKENS).select(F.col("doc_id").alias("_page"), F.col("component_id").alias("family")).distinct()
    family = stored(family, "template-families")
    held = held.join(found, (F.col("host") == F.col("_of")) & (F.col("run") == F.col("_run")), "left_semi").join(family, F.col("page") == F.col("_page"))
    of_host = texts.select("_host", "page").distinct().join(family, F.col("page") == F.col("_page")).select("_host", "family").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("of_all"))
    found = held.select("host", "run", "family").distinct().groupBy("host", "run").agg(F.count(F.lit(1)).alias("n")).join(of_host, F.col("host") == F.col("_host")).filter(enough)
    return stored(found.groupBy(F.col("host").alias("_templated")).agg(F.collect_set("run").alias("_template")), "templates")


def _families(unmarked: DataFrame) -> DataFrame:
    """(_of_page, _family): one family for near copies among pages, by their visible words."""
    texts = unmarked.select(F.col("_page").alias("doc_id"), F.array_join(F.concat("loose", "rest"), " ").alias("text"))
    found = near_copies(texts, size=RUN_TOKENS).distinct()
    return stored(found.select(F.col("doc_id").alias("_of_page"), F.col("component_id").alias("_family")), "page-families")


def _known(rows: DataFrame) -> DataFrame:
    """(_known_page, _known): for each page, the hashes of its runs of RUN_TOKENS words that another family of its host has, over all shards.

    A short row for each run of a page; those of one hash are combined on the map side, so no task holds a host.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, BATCH) for b in batches for k in range(0, b.num_rows, BATCH)):
            host, page, family, loose, rest = (c.to_pylist() for c in batch.columns)
            runs = [sorted(set(windows(" ".join([*x, *y]).split()))) for x, y in zip(loose, rest)]
            n = np.array(list(map(len, runs)), np.int64)
            columns = [pa.array(np.repeat(np.array(v, object), n).tolist(), t) for v, t in ((host, pa.string()), (page, pa.int64()), (family, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r for own in runs for r in own], pa.int64())], ["host", "page", "family", "run"])

    found = rows.select("_host", "_page", "_family", "loose", "rest").mapInArrow(of, "host string, page bigint, family bigint, run bigint")
    found = stored(found.distinct(), "page-runs")
    shared = found.groupBy("host", "run").agg(F.min("family").alias("low"), F.max("family").alias("high")).filter("low != high")
    return found.join(shared, ["host", "run"], "left_semi").groupBy(F.col("page").alias("_known_page")).agg(F.collect_set("run").alias("_known"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trust_articles: bool = True) -> DataFrame:
    """One row per input row: id_col, url_col, text, n_chars. Without trust_articles the suffix array decides about every block that is no furniture, in articles too, by the rule for pages without a mark.

    The text of all pages that is no furniture by its markup goes through suffix arrays by host, which find the host's template: runs of RUN_TOKENS tokens or more on TEMPLATE_SHARE
    of its pages and of their families. An article or main element is trusted if it has at least half of the page's text that is neither furniture nor template; blocks in it
    that the template covers are dropped, and other text that articles share is theirs. On pages without such an element runs that two pages of a host share are
    boilerplate, and blocks covered by them are removed; the menus and margins of marked pages count there, too. Rows of a host with the same blocks are one page, and near copies
    (shingle_dedup.near_copies() over runs of RUN_TOKENS words) are one family: what only they share is no boilerplate. A large host is dealt into several arrays by hash of the page,
    and what its shards find is joined by hashes, so a host's size changes no result. Pages of hosts that have no template and mark all their articles are parsed where they are read, and move no further.

    A null page counts as empty, and its text is empty, as is that of a page without main text; a null or odd url is a host of its own; repeated
    rows are told apart and given back each; broken markup never fails; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("_host"), F.col(html_col).cast("string").alias("_html"))
    marked, untouched, once = F.array_join("main", "\n"), None, None
    picked = rows.withColumn("_size", F.length("_html"))
    no_template = F.array().cast("array<bigint>").alias("_template")
    if not trust_articles:
        whole = _parsed(picked).select("*", no_template)
    else:
        sought = _sought(rows)
        touched = stored(sought.groupBy(F.col("_host").alias("_touched")).agg(F.max(F.col("_loose") | (F.size("_runs") > 0)).alias("_any")).filter("_any").select("_touched"), "touched-hosts")
        n_touched = touched.count()
        if not n_touched:
            return _named(_articles(rows), id_col, url_col)
        one_of = (sent(touched, n_touched, MOST_BROADCAST), F.col("_host") == F.col("_touched"))
        untouched = _articles(rows.join(*one_of, "left_anti"))
        whole = once = stored(_parsed(picked.join(*one_of, "left_semi")), "whole-pages")
        if sought.filter(F.size("_runs") > 0).isEmpty():
            whole = whole.select("*", no_template)
        else:
            templates = _templates(whole, sought)
            whole = whole.join(sent(templates, most=MOST_BROADCAST), F.col("_host") == F.col("_templated"), "left").drop("_templated")
    parsed = stored(_divided(whole, trust_articles), "parsed-pages")
    if once is not None:
        drop_stored(once)

    def named(found: DataFrame) -> DataFrame:
        return _named(found if untouched is None else found.unionByName(untouched), id_col, url_col)

    has_loose = F.size("loose") > 0
    hosts = parsed.groupBy("_host").agg(F.greatest(F.lit(1), F.ceil(F.sum("_size") / SHARD_CHARS)).cast("int").alias("_shards"), F.max(has_loose).alias("_any"))
    hosts = stored(hosts.filter("_any").select(F.col("_host").alias("_of"), "_shards"), "hosts")
    n_hosts = hosts.count()
    if not n_hosts:
        return named(parsed.select("_id", "_url", marked.alias("text")))
    hosts_of = F.broadcast(hosts) if n_hosts <= MOST_BROADCAST else hosts
    joined = parsed.join(hosts_of, F.col("_host") == F.col("_of"), "left")
    alone = joined.filter("_of is null").select("_id", "_url", marked.alias("text"))
    page = F.xxhash64("_host", F.size("main"), "main", F.size("loose"), "loose", F.size("rest"), "rest")
    dealt = joined.filter("_of is not null").withColumn("_page", page)
    dealt = dealt.join(_families(dealt.filter(has_loose)), F.col("_page") == F.col("_of_page"), "left").withColumn("_family", F.coalesce("_family", "_page"))
    if hosts.filter("_shards > 1").isEmpty():
        dealt = dealt.withColumn("_known", F.array().cast("array<bigint>"))
    else:
        known = stored(_known(dealt.filter("_shards > 1")), "known-runs")
        dealt = dealt.join(known, F.col("_page") == F.col("_known_page"), "left")
    salt = F.pmod(F.xxhash64("_id", "_url", "_page"), F.col("_shards")).cast("int")
    # one key for host and shard, as a join by host alone would otherwise keep a host's shards together in one task
    dealt = dealt.withColumn("_shard", F.concat_ws(" ", salt, "_host"))
    kept = ["_id", "_url", "_shard", "_page", "_family", "_known", "main", "loose", "rest"]
    schema = dealt.select(*kept[:2]).schema

    def without_boilerplate(pdf: pd.DataFrame) -> pd.DataFrame:
        once = pdf.drop_duplicates("_page")
        streams = [[*loose, *rest] for loose, rest in zip(once["loose"], once["rest"])]
        known = [frozenset(() if v is None else v) for v in once["_known"]]
        text_of = {}
        for page, main, loose, shares in zip(once["_page"], once["main"], once["loose"], repeated(streams, families=once["_family"].tolist(), known=known)):
            text_of[page] = "\n".join([*main, *(b for b, share in zip(loose, shares) if share < COVERED)])
        return pdf[["_id", "_url"]].assign(text=pdf["_page"].map(text_of))

    of_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    found = dealt.select(*kept).groupBy("_shard").applyInPandas(without_boilerplate, f"{of_type}, text string")
    return named(found.unionByName(alone))


def _named(out: DataFrame, id_col: str, url_col: str) -> DataFrame:
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))
