"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and how often their ids meet.

A text is cut before each space that follows no white space. Neither tokenizer joins bytes across such a place (checked when they are
loaded), so a piece has the same tokens wherever it stands, and each distinct piece is aligned once: in DuckDB, over tables of token
intervals. A document's links are those of its pieces.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lodestack.llm.common import pieces, stored

FOLDER = "/opt/tokenizers"
BYTE_PATH, PIECE_PATH = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: How byte-level tokenizers of this kind cut texts before merging, and the mark that stands for a space in pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"
#: Characters of text that are aligned at a time, characters of a block, whose pairs are told together, and pieces that a worker remembers.
SLAB, BLOCK, REMEMBERED = 2 << 20, 16 << 20, 250_000
#: Pairs of ids that a worker numbers before it begins anew.
NUMBERED = 4 << 20

_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
#: White space so long that tiktoken's pattern runs out of stack on it; such a piece is encoded by the tokenizers library itself.
_LONG = re.compile(r"\s{10000}")

#: Of a slab's tokens `a` and `b` (i, id, start, stop over the same bytes): each with the number g of its group. A group ends where tokens of both end; a
#: running sum over these ends numbers the groups. A's tokens fall into them by an ASOF join; so do B's: by equality where one is a whole group, else by a range join.
_GROUPS = """
CREATE OR REPLACE TEMP TABLE cut AS
    SELECT sum(ends) OVER (ORDER BY stop)::BIGINT AS g, lag(stop, 1, 0) OVER (ORDER BY stop) AS start, stop
    FROM (SELECT a.stop, 1 AS ends FROM a SEMI JOIN b ON a.stop = b.stop);
CREATE OR REPLACE TEMP TABLE ga AS SELECT a.i, a.id, g FROM a ASOF JOIN cut ON a.start >= cut.start;
CREATE OR REPLACE TEMP TABLE gb AS
    SELECT b.i, b.id, g FROM b JOIN cut USING (start, stop)
    UNION ALL SELECT s.i, s.id, w.g
    FROM (SELECT * FROM b ANTI JOIN cut USING (start, stop)) s JOIN (SELECT * FROM cut ANTI JOIN b USING (start, stop)) w ON s.start >= w.start AND s.stop <= w.stop;
"""
_SIDE = "SELECT id, g FROM {} ORDER BY i"
_LINKS = "SELECT g, (ga.id::BIGINT << 32) + gb.id AS pair, count(*) AS times FROM ga JOIN gb USING (g) GROUP BY ALL ORDER BY g"
#: How often each document (place in the slab) has each pair, by its pieces.
_OWN = """
SELECT doc, place, sum(n * times)::BIGINT AS times
FROM (SELECT doc, k, count(*) AS n FROM words GROUP BY ALL) JOIN links USING (k) GROUP BY ALL ORDER BY doc, place
"""


def cut_text(text: str) -> list[str]:
    """The pieces of a space and the text, each beginning with a space that follows no white space."""
    if _AFTER_SPACE.search(text) or text[:1] == " ":
        return _CUT.split(" " + text)
    return [" " + w for w in text.split(" ")]


def byte_alphabet() -> dict[str, int]:
    """The character of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others for 256 and up in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_bytewise(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoding of a byte-level JSON file, special tokens left out, and the bytes of each id. Its merges must be in order of ids, as ranks are."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    special = {t["content"] for t in data.get("added_tokens", [])}
    alphabet, vocabulary = byte_alphabet(), data["model"]["vocab"]
    spelled = {k: bytes(map(alphabet.__getitem__, t)) for t, k in vocabulary.items() if t not in special}
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in data["model"]["merges"]]
    if made != sorted(made) or data.get("normalizer") or len(made) + 256 != len(spelled):
        raise ValueError(f"{path}: merges are not in order of ids, or texts are changed before they are cut")
    encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks={b: k for k, b in spelled.items()}, special_tokens={})
    return encoding, [spelled.get(k, b"") for k in range(max(spelled) + 1)]


def load_pieces(path: str) -> tuple[SentencePieceProcessor, list[bytes]]:
    """The processor of a piece model and the bytes of each id. No piece may hold the space mark after anything but marks."""
    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(k) for k in range(model.vocab_size())]
    if any(re.search(f"[^{MARK}]{MARK}", n) for n in names):
        raise ValueError(f"{path} has pieces that join words")
    return model, [bytes([int(n[3:5], 16)]) if model.is_byte(k) else n.replace(MARK, " ").encode() for k, n in enumerate(names)]


class Aligner:
    """Aligns pieces of text and remembers those that are used most. The pairs of ids seen have places, from 0; forget() begins anew."""

    def __init__(self, byte_path: str, piece_path: str, remembered: int = REMEMBERED) -> None:
        self.byte_path = byte_path
        self.a, self.bytes_a = load_bytewise(byte_path)
        self.b, self.bytes_b = load_pieces(piece_path)
        self.long_a, self.long_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1; SET memory_limit = '250MB'")
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.pairs: dict[int, int] = {}
        self.known: dict[str, int] = {}
        self.groups: list[str] = []  # of each piece: its groups, each with its end
        self.right = np.zeros(0, bool)  # whether its tokens spell it
        self.uses = np.zeros(0, np.int64)
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A and of B, groups, links
        self.ends = np.zeros(0, np.int64)  # of its links, each a place of a pair and how often
        self.links = np.zeros((0, 2), np.int32)

    def _trim(self) -> None:
        """Keeps the half of the pieces that is used most."""
        if len(self.known) <= self.remembered:
            return
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.remembered // 2])
        names = list(self.known)
        n = np.diff(self.ends, prepend=0)
        self.links = self.links[np.repeat(np.isin(np.arange(len(n)), keep), n)]
        self.known = {names[k]: j for j, k in enumerate(keep.tolist())}
        self.groups = [self.groups[k] for k in keep.tolist()]
        self.right, self.uses, self.sizes, self.ends = self.right[keep], self.uses[keep] // 2, self.sizes[keep], np.cumsum(n[keep])

    def learn(self, new: Iterable[str]) -> None:
        """Aligns pieces that are not known yet."""
        alone = {p for p in new if p[-1].isspace() or len(p) > 10_000 and _LONG.search(p)}  # the former would be read with what follows
        for own in [*pieces([p for p in new if p not in alone]), *([p] for p in alone)]:
            self._align(own)

    def _bytewise(self, text: str) -> list[int]:
        if len(text) > 10_000 and _LONG.search(text):
            whole = Tokenizer.from_file(self.byte_path)
            whole.encode_special_tokens = True
            return whole.encode(text, add_special_tokens=False).ids
        return self.a.encode_ordinary(text)

    def _align(self, own: list[str]) -> None:
        data = [p.encode() for p in own]
        coded = self.b.encode([p[1:] for p in own], num_threads=1)  # it puts a space before all but an empty text
        coded = [ids if len(p) > 1 else [self.b.piece_to_id(MARK)] for p, ids in zip(own, coded)]
        b = np.fromiter(chain.from_iterable(coded), np.int64)
        if b"".join(map(self.bytes_b.__getitem__, b.tolist())) != b"".join(data):
            right = [b"".join(map(self.bytes_b.__getitem__, ids)) == d for ids, d in zip(coded, data)]
            wrong = [p for p, good in zip(own, right) if not good]
            if wrong:
                self._keep(wrong, False, np.zeros((len(wrong), 4), np.int64), [""] * len(wrong), np.zeros(len(wrong), np.int64), np.zeros((0, 2), np.int32))
                own = [p for p, good in zip(own, right) if good]
                if own:
                    self._align(own)
                return
        a, ends = np.array(self._bytewise("".join(own)), np.int64), np.cumsum(list(map(len, data)))
        for name, ids, long in (("a", a, self.long_a), ("b", b, self.long_b)):
            stop = np.cumsum(long[ids])
            self.con.register(name, pa.table({"i": np.arange(len(ids)), "id": ids, "start": stop - long[ids], "stop": stop}))
            if not np.isin(ends, stop).all() or stop[-1] != ends[-1]:
                raise ValueError("tokens do not end where pieces of text do")
        self.con.execute(_GROUPS)
        links = self.con.sql(_LINKS).to_arrow_table()
        # of each group, by its number from 1, the piece it is in
        piece_of = np.r_[0, np.searchsorted(ends, self.con.sql("SELECT stop FROM cut ORDER BY g").to_arrow_table()["stop"].to_numpy())]
        sides = [self.con.sql(_SIDE.format(x)).to_arrow_table() for x in ("ga", "gb")]
        numbers = [x["g"].to_numpy() for x in sides]
        key = np.concatenate([numbers[0] * 2, numbers[1] * 2 + 1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        # what stands behind a token: a comma within its side of a group, then the bar, then the end of the group
        marks = pa.array([",", "|", ";"]).take(pa.array(np.where(np.r_[key[1:] == key[:-1], False], 0, 1 + key % 2)))
        ids = pa.array(np.concatenate([x["id"].to_numpy() for x in sides])[order]).cast(pa.string())
        at = np.searchsorted(piece_of[key // 2], np.arange(len(own) + 1)).astype(np.int32)
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), pc.binary_join_element_wise(ids, marks, "")), "").to_pylist()
        pair, inverse = np.unique(links["pair"].to_numpy(), return_inverse=True)
        places = np.array([self.pairs.setdefault(x, len(self.pairs)) for x in pair.tolist()], np.int64)
        held, times = piece_of[links["g"].to_numpy()], links["times"].to_numpy()
        n = [*(np.bincount(piece_of[x], minlength=len(own)) for x in numbers), np.bincount(piece_of[1:], minlength=len(own)), np.bincount(held, times, len(own)).astype(np.int64)]
        self._keep(own, True, np.stack(n, 1), groups, np.bincount(held, minlength=len(own)), np.stack([places[inverse], times], 1))

    def _keep(self, own: list[str], right: bool, sizes: np.ndarray, groups: list[str], n_links: np.ndarray, links: np.ndarray) -> None:
        first = len(self.groups)
        self.known.update(zip(own, range(first, first + len(own))))
        self.groups += groups
        self.right, self.uses = np.r_[self.right, np.full(len(own), right)], np.r_[self.uses, np.zeros(len(own), np.int64)]
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ends = np.r_[self.ends, np.cumsum(n_links) + len(self.links)]
        self.links = np.concatenate([self.links, links.astype(np.int32)])

    def align(self, texts: Sequence[str]) -> tuple[np.ndarray, list[str], pa.Table]:
        """Of each text the sizes (tokens of A, of B, groups, links) and the hash of its groups; and (doc, place, times): how often each text links each pair."""
        self._trim()
        cut = [cut_text(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(cut)).difference(self.known))
        hashes, numbers, wrong = [], [], set(np.flatnonzero(~self.right).tolist())
        for c in cut:
            own = list(map(self.known.__getitem__, c))
            if wrong and not wrong.isdisjoint(own):
                own = []
            numbers.append(own)
            hashes.append(hashlib.sha256("".join(map(self.groups.__getitem__, own))[:-1].encode()).hexdigest() if own else "")
        n = list(map(len, numbers))
        doc, words = np.repeat(np.arange(len(texts)), n), np.fromiter(chain.from_iterable(numbers), np.int64, sum(n))
        self.uses += np.bincount(words, minlength=len(self.uses))
        sizes = np.stack([np.bincount(doc, self.sizes[words, j], len(texts)).astype(np.int64) for j in range(4)], 1)
        used, long = np.zeros(len(self.uses), bool), np.diff(self.ends, prepend=0)
        used[words] = True
        links = self.links[np.repeat(used, long)]
        self.con.register("words", pa.table({"doc": doc, "k": words}))
        self.con.register("links", pa.table({"k": np.repeat(np.flatnonzero(used), long[used]), "place": links[:, 0], "times": links[:, 1]}))
        return sizes, hashes, self.con.sql(_OWN).to_arrow_table()


@functools.lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One for each worker, so that tasks share what is known."""
    return Aligner(byte_path, piece_path)


def _packed(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs."""
    most = int(values.max(initial=0))
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // n]) if n else np.zeros(0, np.uint8)


_PARTS = "block bigint, id {}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_pairs int, places binary, times binary, used array<struct<place: int, pair: bigint, docs: bigint>>"


def _parts(docs: DataFrame, id_col: str, text_col: str, byte_path: str, piece_path: str, slab: int, block: int) -> DataFrame:
    """A row of each document and one of each block: which pairs its documents hold, by place, and in how many of them."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ddl = _PARTS.format(rows.schema["id"].dataType.simpleString())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_path, piece_path)
        task, number, chars, held = TaskContext.get().partitionId(), 0, 0, np.zeros(0, np.int64)
        kinds = None

        def summary() -> pa.RecordBatch:
            places = np.flatnonzero(held)
            pairs = np.fromiter(own.pairs, np.int64, len(own.pairs))
            used = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(pairs[places]), pa.array(held[places])], ["place", "pair", "docs"])
            lists = pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), used)
            empty = [pa.nulls(1, t) for t in kinds]
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number]), *empty, lists], names)

        names = [c.split(" ")[0] for c in ddl.split(", ")[:10]] + ["used"]
        for batch in batches:
            kinds = [batch.column(0).type, *[pa.int64()] * 4, pa.string(), pa.int32(), pa.binary(), pa.binary()]
            texts, at = batch.column(1).to_pylist(), 0
            for part in pieces(texts, slab):
                if chars > block or len(own.pairs) > NUMBERED:
                    if chars:
                        yield summary()
                    number, chars, held = number + 1, 0, np.zeros(0, np.int64)
                    if len(own.pairs) > NUMBERED:
                        own.forget()
                sizes, hashes, links = own.align(part)
                doc, place, times = (links[c].to_numpy() for c in ("doc", "place", "times"))
                held = np.pad(held, (0, len(own.pairs) - len(held))) + np.bincount(place, minlength=len(own.pairs))
                ends = np.searchsorted(doc, np.arange(len(part) + 1))
                spans = list(zip(ends[:-1], ends[1:]))
                columns = [pa.array(np.full(len(part), (task << 32) + number)), batch.column(0).slice(at, len(part)), *(pa.array(sizes[:, j]) for j in range(4)), pa.array(hashes)]
                columns += [pa.array(np.diff(ends), pa.int32()), *(pa.array([_packed(v[x:y]) for x, y in spans], pa.binary()) for v in (place, times))]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(part), pa.list_(pa.struct([("place", pa.int32()), ("pair", pa.int64()), ("docs", pa.int64())])))], names)
                chars += sum(map(len, part)) + len(part)
                at += len(part)
        if chars:
            yield summary()

    return rows.mapInArrow(of, ddl)


def align_tokenizers(
    docs: DataFrame, byte_path: str = BYTE_PATH, piece_path: str = PIECE_PATH, id_col: str = "doc_id", text_col: str = "text", slab: int = SLAB, block: int = BLOCK
) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row: how a byte-level tokenizer A and a piece tokenizer B split a space and its text.

    Places where tokens of both end cut the tokens into groups; each token of A in a group is linked with each of B there. A pair's count is the number of rows that
    link it. n_best are the links whose pair has the highest count of all pairs of its A id, count_sum is the sum of the counts over all links.

    Texts are read once. A task sends on, for each block of about `block` characters, the pairs it has and in how many rows: partial counts, which are summed by pair,
    compared within an A id (at most as many pairs as B has ids) and sent back to the block; a block's rows are kept as the places of their pairs. So what is shuffled
    are the pairs of blocks and short numbers for rows, neither texts nor tokens, and no group is larger than a block or a vocabulary.

    Defined cases: texts that are null, empty, or not spelled by the tokens of both (as with U+2581 in them) have zeros and an empty hash; texts are read whole,
    whatever their length; rows that repeat id and text, or have no id, are rows of their own and each counts; an empty table gives no rows; other columns are
    ignored, whatever their names. The strings of special tokens are plain text.
    """
    parts = stored(_parts(docs, id_col, text_col, byte_path, piece_path, slab, block), "aligned")
    used = parts.filter(F.col("used").isNotNull()).select("block", F.inline("used"))
    counts = used.groupBy("pair").agg(F.sum("docs").alias("count"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(of_a))
    answers = used.join(counts, "pair").select(F.col("block").alias("of_block"), "place", "count", "best")
    kept = ["id", "n_a", "n_b", "n_groups", "n_links"]

    def of(rows: pa.Table, found: pa.Table) -> pa.Table:
        place = found["place"].to_numpy()
        count, best = (np.zeros(int(place.max(initial=-1)) + 1, np.int64) for _ in range(2))
        count[place], best[place] = found["count"].to_numpy(), found["best"].to_numpy(zero_copy_only=False)
        sums = [[], []]
        for n, places, times in zip(*(rows[c].to_pylist() for c in ("n_pairs", "places", "times"))):
            places, times = _unpacked(places, n), _unpacked(times, n).astype(np.int64)
            for out, of_pair in zip(sums, (best, count)):
                out.append(int(of_pair[places] @ times))
        columns = [*(rows[c] for c in kept), *(pa.array(s, pa.int64()) for s in sums), rows["groups_sha256"]]
        return pa.table(columns, [*kept, "n_best", "count_sum", "groups_sha256"])

    rows = parts.filter(F.col("used").isNull()).drop("used")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return rows.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(of, schema).withColumnRenamed("id", id_col)
