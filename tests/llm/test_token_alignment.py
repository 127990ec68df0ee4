import hashlib
from collections import Counter

import pyarrow.compute as pc
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lodestack.llm.token_alignment import BYTE_PATH, PIECE_PATH, align_tokenizers, byte_alphabet, cut_text

SCHEMA = "doc_id long, text string, id string, block string, pair string, used string"
ODD = [
    None, "", " ", "  ", "\n", "a", "word word  word", " lead", "trail ", "trail \n ", "tab\t tab \t x", "ümläut 漢字かな交じり 🙂🙃 x", "<|endoftext|> <s></s> <unk> <0x41>", "mark ▁ in text",
    "don't we'll it's 'tis", "x" * 3000, "ab " * 2000, "line\nline\n\n  indented\r\n  more", "a b  c　 d", "\x00 null \x1c sep", "1234567 12,345.67", "word word  word", "nul\x00", "é ﬁ Ａ", "  x", "a \u0085 b",
]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(BYTE_PATH)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PIECE_PATH)


def brute(rows, a, b):
    """Whole texts by the libraries themselves, groups by sets of ends, links pair by pair."""
    letters = byte_alphabet()
    out, links = [], []
    for i, text in rows:
        groups = []
        if text:
            ids_a = a.encode(" " + text, add_special_tokens=False).ids
            ids_b = b.encode(text)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(x)) for x in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = []
                for parts in (bytes_a, bytes_b):
                    at = 0
                    ends.append([at := at + len(p) for p in parts])
                cuts = sorted(set(ends[0]) & set(ends[1]))
                left = [list(zip(own, ids))[::-1] for own, ids in zip(ends, (ids_a, ids_b))]
                for cut in cuts:
                    group = ([], [])
                    for part, rest in zip(group, left):
                        while rest and rest[-1][0] <= cut:
                            part.append(rest.pop()[1])
                    groups.append(group)
        out.append((i, groups))
        links.append(Counter((x, y) for ga, gb in groups for x in ga for y in gb))
    count = Counter(p for own in links for p in own)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(n, best.get(x, 0))
    return sorted(
        (
            (
                i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(own.values()), sum(n for p, n in own.items() if count[p] == best[p[0]]),
                sum(n * count[p] for p, n in own.items()), hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else "",
            )
            for (i, groups), own in zip(out, links)
        ),
        key=repr,
    )


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, t, "x", "y", "z", None) for i, t in rows], SCHEMA)
    got = align_tokenizers(df, **k)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_pieces_are_the_text():
    for t in ODD:
        if t:
            assert "".join(cut_text(t)) == " " + t
            assert all(p[0] == " " for p in cut_text(t))


@pytest.mark.parametrize("k", [{}, {"slab": 40, "block": 100}])
def test_odd_texts_like_brute_force(spark, both, k):
    rows = list(enumerate(ODD)) + [(3, "again"), (3, "again"), (None, "no id"), (None, "no id"), (None, None)]
    got = run(spark, rows, **k)
    assert got == brute(rows, *both)
    assert next(r for r in got if r[0] == ODD.index("mark ▁ in text"))[1:] == (0, 0, 0, 0, 0, 0, "")


def test_given_documents_like_brute_force(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in align_tokenizers(docs, slab=1 << 16, block=1 << 18).collect()), key=repr)
    assert got == brute(rows, *both)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_very_long_texts(both):
    """Without spaces, and with long runs of them."""
    from lodestack.llm.token_alignment import Aligner

    own = Aligner(BYTE_PATH, PIECE_PATH)
    texts = ["a" * 50_000, "x" + " " * 300_000 + "y z", "\n" * 12_000, "ab1!" * 5_000, "\t\t\tz" * 5_000, " " * 12_000]
    sizes, hashes, _ = own.align(texts)
    for k, t in enumerate(texts):
        want = brute([(0, t)], *both)[0]
        assert (tuple(sizes[k]), hashes[k]) == (want[1:5], want[7])


def test_worker_that_forgets():
    from lodestack.llm.token_alignment import Aligner

    texts = ["one two three", "two ▁", "one two two four", None, "five six  seven\n"] * 2
    own, short = Aligner(BYTE_PATH, PIECE_PATH), Aligner(BYTE_PATH, PIECE_PATH, remembered=4)
    whole = own.align(texts)
    for k, text in enumerate(texts):  # pieces go after each text; pairs keep their places
        sizes, hashes, links = short.align([text])
        assert (sizes[0] == whole[0][k]).all() and hashes[0] == whole[1][k]
        pairs = [{n: p for p, n in x.pairs.items()} for x in (own, short)]
        want = whole[2].filter(pc.equal(whole[2]["doc"], k)).to_pydict()
        got = links.to_pydict()
        assert {pairs[1][p]: n for p, n in zip(got["place"], got["times"])} == {pairs[0][p]: n for p, n in zip(want["place"], want["times"])}
        assert len(short.known) <= 4 + 6
