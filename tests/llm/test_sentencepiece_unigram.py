import hashlib
import random
import struct

import numpy as np
import pytest
import sentencepiece

from lodestack.llm import sentencepiece_unigram as op

SCHEMA = "doc_id long, text string, token_ids string, decoded int"


@pytest.fixture(scope="module")
def vocabulary():
    return op.load_vocabulary()


def varint(data, at):
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def packed(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def fields(data):
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        if key & 7 == 0:
            value, at = varint(data, at)
        elif key & 7 == 5:
            value, at = data[at : at + 4], at + 4
        else:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        yield key, value


def as_unigram(path, scores):
    """The model file with other scores and the unigram model type."""
    out, k = b"", 0
    for key, value in fields(open(path, "rb").read()):
        if key == 1 << 3 | 2:
            piece = b"".join(
                packed(x) + (packed(len(v)) + v if x & 7 == 2 else v if x & 7 == 5 else packed(v)) for x, v in fields(value) if x != 2 << 3 | 5
            )
            value = piece + packed(2 << 3 | 5) + struct.pack("<f", scores[k])
            k += 1
        elif key == 2 << 3 | 2:
            own = [(x, v) for x, v in fields(value) if x != 3 << 3]
            value = b"".join(packed(x) + (packed(len(v)) + v if x & 7 == 2 else v if x & 7 == 5 else packed(v)) for x, v in own)
            value += packed(3 << 3) + packed(1)
        out += packed(key) + (packed(len(value)) + value if key & 7 == 2 else value if key & 7 == 5 else packed(value))
    return out


TEXTS = [
    "a", " a", "a  b", "Hello, world!", "über die Straße\n\nnächste  Zeile\t", "   ", "\n", "日本語とemoji 👩‍👩‍👧 \x00\x7f", "x" * 300,
    "Éien éonierç le ch trement", "1234567890 " * 3, "word " * 200, "á ﻿   z", "\U0010ffff" * 30,
]


def test_like_the_library_with_the_same_scores(vocabulary):
    sp = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(op.MODEL_PATH, vocabulary.scores))
    got = op.Encoder(vocabulary).encode(TEXTS)
    for text, ids in zip(TEXTS, got):
        assert ids.tolist() == sp.encode(text), text


def test_arrays_like_one_unit_at_a_time(vocabulary):
    r = random.Random(4)
    encoder = op.Encoder(vocabulary)
    letters = "aeirstnl▁▁éüß日👩.,'0\t"
    units = ["".join(r.choice(letters) for _ in range(r.randrange(1, 16))).encode() for _ in range(3000)]
    got = encoder.encode_units(units)
    assert all(np.frombuffer(g, np.int32).tolist() == encoder.encode_unit(u) for g, u in zip(got, units))


def brute_best(vocabulary, unit):
    score = {p: s for p, s in zip(vocabulary.pieces, vocabulary.scores) if p}
    worst = min(score.values()) - op.UNKNOWN_PENALTY
    text = unit.decode()
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for at in range(end):
            s = score.get(text[at:end].encode(), worst if end - at == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[at] + s)
    return best[-1]


def test_best_score_like_brute_force(vocabulary):
    r = random.Random(5)
    encoder = op.Encoder(vocabulary)
    score = np.array(vocabulary.scores)
    for _ in range(200):
        unit = "".join(r.choice("theandioréß") for _ in range(r.randrange(1, 14))).encode()
        got = sum(score[k] for k in encoder.encode_unit(unit))
        assert got == pytest.approx(brute_best(vocabulary, unit))


def test_exact_round_trip(spark, vocabulary):
    texts = [*TEXTS, "marker ▁ inside ▁▁", "▁", None, "", "x y " * 20_000, "nospace" * 5_000]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, "a", None, None)] * 2, SCHEMA)
    coded = op.encode_documents(df, vocabulary)
    assert coded.columns == ["doc_id", "text", "decoded", "token_ids"]
    got = op.decode_documents(coded, vocabulary).collect()
    assert len(got) == len(texts) + 2
    assert all(r.decoded == (r.text or "") for r in got)
    assert all((len(r.token_ids) == 0) == (not r.text) for r in got)
    checked = op.encode_documents(df, vocabulary, check=True).collect()
    assert all(r.round_trip and r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in checked)
    assert sorted(r.token_ids for r in checked) == sorted(r.token_ids for r in got)


def test_empty_table_and_pieces_with_inner_markers(spark, vocabulary):
    assert op.encode_documents(spark.createDataFrame([], SCHEMA), vocabulary).collect() == []
    inner = op.Vocabulary((*vocabulary.pieces, "e▁t".encode()), (*vocabulary.scores, 0.0), vocabulary.byte_ids)
    encoder = op.Encoder(inner)
    ids = encoder.encode(["see the tree"])[0]
    assert len(vocabulary.pieces) in ids.tolist()
    assert encoder.decode(ids) == "see the tree"
