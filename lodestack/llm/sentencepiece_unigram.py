"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import pieces as runs_of_texts

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A character without a piece scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Longer units go through the walk of one unit at a time; the others through arrays, all at once.
LONG_UNIT = 64
#: Encoded units that a Python worker remembers.
REMEMBERED = 150_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes (marker included) with log scores, and the id of each byte."""

    pieces: tuple[bytes | None, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]


def zipf_scores(count: int) -> np.ndarray:
    """Log probabilities of pieces that are known by rank alone: probability falls as 1 / (rank + 1)."""
    ranks = np.arange(1, count + 1)
    return -np.log(ranks) - math.log(float((1.0 / ranks).sum()))


def load_vocabulary(path: str = MODEL_PATH) -> Vocabulary:
    """Reads a model file with byte fallback on the driver.

    Scores of a byte-pair model are merge ranks, not logs (the first is 0 and each next is one less); zipf_scores() takes
    their place. Other models' scores are taken as they are.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    normal = [k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
    scores = {k: sp.get_score(k) for k in normal}
    by_rank = sorted(normal, key=lambda k: -scores[k])
    if scores and all(scores[k] == -float(r) for r, k in enumerate(by_rank)):
        scores = dict(zip(by_rank, zipf_scores(len(by_rank)).tolist()))
    byte_ids = [-1] * 256
    for k in range(n):
        if sp.is_byte(k):
            byte_ids[int(sp.id_to_piece(k)[3:5], 16)] = k
    if min(byte_ids) < 0:
        raise ValueError("the model has no byte fallback")
    own = set(normal)
    return Vocabulary(
        tuple(sp.id_to_piece(k).encode() if k in own else None for k in range(n)), tuple(scores.get(k, 0.0) for k in range(n)), tuple(byte_ids)
    )


@dataclass
class DoubleArray:
    """A trie in two arrays: byte c leads from state s to base[s] + c if check[base[s] + c] is s. value: piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: Sequence[tuple[bytes, int]]) -> DoubleArray:
        keys = sorted(keys)
        size = 1 << 16
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = np.zeros(size, bool)
        taken[0] = True
        begin = 1  # below, few slots are free
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, low, high, depth = todo.pop()
            if low < high and len(keys[low][0]) == depth:
                value[state] = keys[low][1]
                low += 1
            if low == high:
                continue
            groups, at = [], low
            while at < high:
                c, end = keys[at][0][depth], at
                while end < high and keys[end][0][depth] == c:
                    end += 1
                groups.append((c, at, end))
                at = end
            codes = np.array([g[0] for g in groups])
            b, seek = 0, max(begin, int(codes[0]) + 1)
            while not b:
                if seek + 8192 > size:
                    base, check, value = (np.concatenate((a, np.full(size, fill, np.int32))) for a, fill in ((base, 0), (check, -1), (value, -1)))
                    taken = np.concatenate((taken, np.zeros(size, bool)))
                    size *= 2
                free = seek + np.flatnonzero(~taken[seek : seek + 4096]) - codes[0]
                fits = free[~taken[free[:, None] + codes].any(axis=1)]
                b, seek = (int(fits[0]) if len(fits) else 0), seek + 4096
            if taken[begin : begin + 4096].mean() > 0.97:
                begin += 4096
            base[state] = b
            taken[b + codes], check[b + codes] = True, state
            todo += [(b + c, s, e, depth + 1) for c, s, e in groups]
        return cls(base, check, value)


@dataclass
class Encoder:
    """Encodes and decodes texts; units once encoded are remembered, REMEMBERED at most."""

    vocabulary: Vocabulary
    known: dict[str, bytes] = field(default_factory=dict)

    @cached_property
    def trie(self) -> DoubleArray:
        return DoubleArray.build([(p, k) for k, p in enumerate(self.vocabulary.pieces) if p])

    @cached_property
    def scores(self) -> np.ndarray:
        return np.array(self.vocabulary.scores)

    @cached_property
    def unknown(self) -> float:
        return min((s for s, p in zip(self.vocabulary.scores, self.vocabulary.pieces) if p), default=0.0) - UNKNOWN_PENALTY

    @cached_property
    def longest(self) -> int:
        return max((len(p) for p in self.vocabulary.pieces if p), default=1)

    @cached_property
    def byte_ids(self) -> np.ndarray:
        return np.array(self.vocabulary.byte_ids, np.int32)

    @cached_property
    def lists(self) -> tuple[list, list, list, list]:
        t = self.trie
        return t.base.tolist(), t.check.tolist(), t.value.tolist(), self.scores.tolist()

    @cached_property
    def units(self) -> re.Pattern[str]:
        """Parts of a text that no piece crosses: a run of spaces with the word behind it; line ends; markers in the text itself."""
        texts = [p.decode() for p in self.vocabulary.pieces if p]
        if any(MARK in t.lstrip(MARK) for t in texts):
            return re.compile(f"{MARK}|[^{MARK}]+")
        apart = "\n" if not any("\n" in t and len(t) > 1 for t in texts) else MARK
        return re.compile(f"{MARK}|{apart}+| *[^ {MARK}{apart}]+| +")

    @cached_property
    def spelled(self) -> list[bytes]:
        out = [(p or b"").replace(MARK.encode(), b" ") for p in self.vocabulary.pieces]
        for byte, k in enumerate(self.vocabulary.byte_ids):
            out[k] = bytes([byte])
        return out

    def encode_unit(self, unit: bytes) -> list[int]:
        """The best-scoring pieces of one unit; of equally good ones, those that sentence-piece models take."""
        base, check, value, scores = self.lists
        n = len(unit)
        best, back, by = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            if best[at] == -math.inf:
                continue
            width = 1 if unit[at] < 0x80 else 2 if unit[at] < 0xE0 else 3 if unit[at] < 0xF0 else 4
            state, single = 0, False
            for end in range(at, n):
                to = base[state] + unit[end]
                if check[to] != state:
                    break
                state = to
                k = value[state]
                if k >= 0:
                    single |= end + 1 - at == width
                    if best[at] + scores[k] > best[end + 1]:
                        best[end + 1], back[end + 1], by[end + 1] = best[at] + scores[k], at, k
            if not single and best[at] + self.unknown > best[at + width]:
                best[at + width], back[at + width], by[at + width] = best[at] + self.unknown, at, -1
        out: list[int] = []
        while n:
            out += [by[n]] if by[n] >= 0 else [self.vocabulary.byte_ids[c] for c in reversed(unit[back[n] : n])]
            n = back[n]
        return out[::-1]

    def encode_units(self, units: Sequence[bytes]) -> list[bytes]:
        """encode_unit() of many units of up to LONG_UNIT bytes side by side; ids as bytes of int32."""
        n, t = np.fromiter(map(len, units), np.int32, len(units)), self.trie
        most = int(n.max())
        text = np.zeros((len(units), most + 1), np.uint8)
        text[np.arange(most + 1)[None, :] < n[:, None]] = np.frombuffer(b"".join(units), np.uint8)
        best = np.full((len(units), most + 1), -np.inf)
        back, by = np.zeros(best.shape, np.int32), np.full(best.shape, -1, np.int32)
        best[:, 0] = 0.0
        for at in range(most):
            begun = np.flatnonzero((best[:, at] > -np.inf) & (n > at))
            if not len(begun):
                continue
            lead = text[begun, at]
            width = 1 + (lead >= 0xC0).astype(np.int32) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(units), bool)
            wide = np.zeros(len(units), np.int32)
            wide[begun] = width
            rows, state = begun, np.zeros(len(begun), np.int32)
            for end in range(at, most):
                to = t.base[state] + text[rows, end]
                on = (t.check[to] == state) & (end < n[rows])
                rows, state = rows[on], to[on]
                if not len(rows):
                    break
                k = t.value[state]
                is_piece = k >= 0
                own, k = rows[is_piece], k[is_piece]
                single[own[wide[own] == end + 1 - at]] = True
                score = best[own, at] + self.scores[k]
                better = score > best[own, end + 1]
                own = own[better]
                best[own, end + 1], back[own, end + 1], by[own, end + 1] = score[better], at, k[better]
            own = begun[~single[begun]]
            to = at + wide[own]
            score = best[own, at] + self.unknown
            better = score > best[own, to]
            own, to = own[better], to[better]
            best[own, to], back[own, to], by[own, to] = score[better], at, -1
        ids, place, unknown = np.zeros((len(units), most), np.int32), np.full(len(units), most), np.zeros(len(units), bool)
        at, rows = n.copy(), np.flatnonzero(n > 0)
        while len(rows):
            k = by[rows, at[rows]]
            unknown[rows[k < 0]] = True
            place[rows] -= 1
            ids[rows, place[rows]] = k
            at[rows] = back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        out = [row[p:].tobytes() for row, p in zip(ids, place.tolist())]
        for r in np.flatnonzero(unknown).tolist():
            out[r] = np.array(self.encode_unit(units[r]), np.int32).tobytes()
        return out

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text: a marker stands for each space and for the start; an empty text has none."""
        cut = [self.units.findall(" " + t) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list(set().union(*cut))
        # a marker in the text itself is spelled in bytes, so that decoding gives it back
        as_bytes = {u: u.replace(" ", MARK).encode() for u in new if u != MARK}
        if MARK in new:
            self.known[MARK] = self.byte_ids[list(MARK.encode())].tobytes()
        short = sorted((u for u, b in as_bytes.items() if len(b) <= LONG_UNIT), key=lambda u: len(as_bytes[u]))
        for at in range(0, len(short), 8192):
            own = short[at : at + 8192]
            self.known.update(zip(own, self.encode_units([as_bytes[u] for u in own])))
        for u, b in as_bytes.items():
            if len(b) > LONG_UNIT:
                self.known[u] = np.array(self.encode_unit(b), np.int32).tobytes()
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), np.int32) for c in cut]

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        """The text of ids: markers become spaces, byte pieces join to characters, the first space goes."""
        text = b"".join(map(self.spelled.__getitem__, np.asarray(ids).tolist()))
        return text.removeprefix(b" ").decode("utf-8", "replace")


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", into: str = "token_ids", check: bool = False) -> DataFrame:
    """docs with a column `into`: the ids of each whole text; with check also `round_trip`, whether the decoded ids are the text, and `decoded_sha256`. No shuffle.

    Checking happens where the ids are made, so neither they nor the decoded texts travel for it.

    Null and empty texts have no ids; repeated rows are encoded alike; texts of any length are encoded whole; an empty
    table stays empty. A column of these names that docs have is replaced; other columns pass through.
    """
    added = [into, *(["round_trip", "decoded_sha256"] if check else [])]
    rest = docs.drop(*added)
    schema = rest.withColumn(into, F.array(F.lit(0))).schema
    if check:
        schema = schema.add("round_trip", "boolean").add("decoded_sha256", "string")
    names, place = rest.columns, rest.columns.index(text_col)
    encoder = Encoder(vocabulary)
    _ = encoder.trie  # built here once and sent along: about 2 MB, however long the table

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in runs_of_texts(batch.column(place).to_pylist()):
                ids = encoder.encode(part)
                ends = np.cumsum([0, *map(len, ids)])
                columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))]
                if check:
                    decoded = [encoder.decode(x) for x in ids]
                    columns.append(pa.array([d == t for d, t in zip(decoded, part)]))
                    columns.append(pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]))
                own = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], [*names, *added])

    return rest.mapInArrow(of, schema)


def decode_documents(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "token_ids", into: str = "decoded") -> DataFrame:
    """rows with a column `into`: the text of ids_col. Null ids decode to an empty text."""
    rest = rows.drop(into)
    schema = rest.withColumn(into, F.lit("")).schema
    names, place = rest.columns, rest.columns.index(ids_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = [encoder.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else []) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, into])

    return rest.mapInArrow(of, schema)
