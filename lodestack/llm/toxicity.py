"""Toxicity: a subsequence string-kernel support vector machine with Nystrom landmarks."""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import drop_stored, pieces, stored

#: The kernel counts common subsequences of three characters that span six at most, each occurrence
#: weighing DECAY ** span, so gaps and inserted characters weaken a match and do not end it.
SPAN = 6
DECAY = 0.7
#: Characters fall in 64 classes: a-z, 0-9, 26 for all others by their code, a start and an end of word.
CLASSES, START, END = 64, 62, 63
#: Longer words are seen through overlapping windows of so many characters.
WINDOW = 24
#: Labelled documents to learn from at most, by label; the first in an order by hash.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 8_000
#: Sentences of them that the machine is trained on at most, by label; a longer sentence is cut into several of so many words.
TOXIC_SENTENCES, CLEAN_SENTENCES, SENTENCE_WORDS = 6_000, 2_000, 40
#: Clean words that look most toxic to a first machine, for the second, at most; words that first point at toxic sentences, at most; landmarks.
HARD_WORDS, POINTERS, LANDMARKS = 3_000, 3_000, 256
#: Different toxic documents that a word must stand in to point at a sentence; one of fewer may be there by chance.
SEEN_IN = 3
#: Parts of an order by hash of which one is cut, so that a bound is met exactly enough without sorting.
PARTS = 4_096
#: Scored words a Python worker remembers.
REMEMBERED = 300_000
MARGIN = 3.0
#: Margin from which a word counts as toxic in a document's score.
SURE = 1 / 3
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¡¿"


def sentences(text: str) -> list[str]:
    """A text cut behind . ! ? and at line ends."""
    for end in ".!?":
        text = text.replace(end + " ", end + "\n")
    return [s for s in text.split("\n") if s.strip()]


def tokens(text: str) -> list[str]:
    """Lower-case words of a text; runs of three or more single characters also count joined."""
    words = text.lower().split()
    if sum(len(w) == 1 for w in words) >= 3:
        run: list[str] = []
        for w in [*words, "  "]:
            if len(w) == 1:
                run.append(w)
                continue
            if len(run) >= 3:
                words.append("".join(run))
            run = []
    return words


def windows(word: str) -> list[str]:
    """The word itself, or of a longer one its overlapping windows, which cover it whole."""
    if len(word) <= WINDOW:
        return [word]
    return [word[at : at + WINDOW] for at in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def classes(word: str) -> np.ndarray:
    cp = np.frombuffer(word.encode("utf-32-le", "replace"), np.uint32)
    out = 36 + (cp * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(26)
    out = np.where((cp >= 97) & (cp <= 122), cp - 97, out)
    return np.where((cp >= 48) & (cp <= 57), cp - 48 + 26, out).astype(np.int32)


_ways: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def ways(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions i < j < k of n within SPAN, and the weight of each."""
    if n not in _ways:
        found = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]
        i, j, k = np.array(found, np.int32).reshape(-1, 3).T
        _ways[n] = i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)
    return _ways[n]


def subsequences(words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For words of equal length: their places in words, subsequence codes, weights, and norms."""
    by: dict[int, list[int]] = {}
    for place, w in enumerate(words):
        by.setdefault(len(w), []).append(place)
    for n, places in by.items():
        i, j, k, weight = ways(n + 2)
        step = max(1, 400_000 // max(1, len(i)))
        for at in range(0, len(places), step):
            own = places[at : at + step]
            c = np.empty((len(own), n + 2), np.int32)
            c[:, 0], c[:, -1] = START, END
            c[:, 1:-1] = classes("".join(words[p] for p in own)).reshape(len(own), n)
            code = (c[:, i] * CLASSES + c[:, j]) * CLASSES + c[:, k]
            order = np.argsort(code, axis=1, kind="stable")
            ranked, w = np.take_along_axis(code, order, 1), weight[order]
            square = (w * w).sum(axis=1)
            for d in range(1, code.shape[1]):
                same = ranked[:, d:] == ranked[:, :-d]
                if not same.any():
                    break
                square += 2 * (w[:, d:] * w[:, :-d] * same).sum(axis=1)
            yield np.array(own), code, weight, np.sqrt(np.maximum(square, 1e-12))


def kernel(words: Sequence[str], others: Sequence[str]) -> np.ndarray:
    """Normalised subsequence kernel of each word with each of the others."""
    seen, rows = [np.zeros(0, np.int32)], []
    for own, code, weight, norm in subsequences(others):
        seen.append(np.unique(code))
        rows.append((own, code, weight, norm))
    codes = np.unique(np.concatenate(seen))
    table = np.zeros((len(codes) + 1, len(others)), np.float32)
    for own, code, weight, norm in rows:
        at = np.searchsorted(codes, code)
        for p in range(code.shape[1]):
            np.add.at(table, (at[:, p], own), weight[p] / norm)
    out = np.zeros((len(words), len(others)), np.float32)
    for own, code, weight, norm in subsequences(words):
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1) if len(codes) else np.zeros(code.shape, int)
        at = np.where(codes[at] == code, at, len(codes)) if len(codes) else at
        for p in range(code.shape[1]):
            out[own] += table[at[:, p]] * (weight[p] / norm)[:, None]
    return out


@dataclass(frozen=True)
class ToxicityModel:
    """The machine, folded: the sum over landmarks of weight times kernel is a sum over the word's subsequences
    of one weight each, as every landmark is known beforehand. table: by subsequence code."""

    table: np.ndarray
    bias: float
    document: tuple[float, ...]

    def margins(self, words: Sequence[str]) -> np.ndarray:
        """The machine's decision for each word; of a long word, the largest of its windows."""
        shown, of = [], []
        for place, w in enumerate(words):
            own = windows(w)
            shown += own
            of += [place] * len(own)
        found = np.full(len(shown), -MARGIN, np.float32)
        for own, code, weight, norm in subsequences(shown):
            if code.shape[1]:
                found[own] = (self.table[code] * weight).sum(axis=1) / norm + self.bias
        out = np.full(len(words), -MARGIN, np.float32)
        np.maximum.at(out, np.array(of, int), np.clip(found, -MARGIN, MARGIN))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        a = np.asarray(self.document)
        return 1 / (1 + np.exp(-(a[0] + features @ a[1:])))


def fit_machine(words: Sequence[str], toxic: np.ndarray, weight: np.ndarray, landmarks: int = LANDMARKS, cost: float = 4.0) -> tuple[list[str], np.ndarray, float]:
    """Landmarks, their weights and the bias of a squared-hinge machine on Nystrom features K_nm K_mm^(-1/2). Landmarks are the weightiest words of both classes, half of each."""
    order = np.argsort(-weight, kind="stable")
    chosen = [*order[toxic[order] == 1][: landmarks // 2], *order[toxic[order] == 0][: landmarks // 2]]
    marks = [words[p] for p in chosen]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-3))
    z = np.concatenate((kernel(words, marks) @ root, np.ones((len(words), 1))), axis=1)
    y = np.where(toxic == 1, 1.0, -1.0)
    c = cost * weight * np.where(toxic == 1, 0.5 / weight[toxic == 1].sum(), 0.5 / weight[toxic == 0].sum()) * len(words)
    w, ridge = np.zeros(z.shape[1]), np.r_[np.ones(len(marks)), 1e-6]
    for _ in range(30):
        short = y * (z @ w) < 1
        zs = z[short] * c[short, None]
        new = np.linalg.solve(np.diag(ridge) + zs.T @ z[short], zs.T @ y[short])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return marks, root @ w[:-1], float(w[-1])


def folded(marks: Sequence[str], beta: np.ndarray) -> np.ndarray:
    """The sum over landmarks of weight times kernel as one weight for each subsequence, by its code."""
    table = np.zeros(CLASSES**3, np.float64)
    for own, code, each, norm in subsequences(marks):
        np.add.at(table, code, each[None, :] * (beta[own] / norm)[:, None])
    return table.astype(np.float32)


def varied(word: str, r: random.Random) -> str:
    """word with one or two characters put between its own."""
    for _ in range(r.choice((1, 1, 2))):
        at = r.randrange(1, len(word)) if len(word) > 1 else len(word)
        word = word[:at] + r.choice(".-_*'x1") + word[at:]
    return word


def document_features(margins: np.ndarray) -> list[float]:
    """Largest and second largest margin of a document's words, repeats counted, within the machine's own margin of 1 (of a missing word -MARGIN), and how many are SURE or more."""
    top = np.sort(np.partition(margins, -2)[-2:]) if len(margins) > 2 else np.sort(margins)
    top = np.concatenate((np.full(2 - len(top), -MARGIN), np.clip(top, -1, 1)))
    return [float(top[1]), float(top[0]), float(np.log1p((margins >= SURE).sum()))]


class Features:
    """document_features() of texts; words once scored are remembered, REMEMBERED at most."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.known = model, {}

    def of(self, texts: Sequence[str]) -> list[list[float]]:
        docs = [tokens(t) for t in texts]
        new = list(set().union(*docs).difference(self.known)) if docs else []
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list(set().union(*docs))
        self.known.update(zip(new, self.model.margins([w.strip(EDGES) or w for w in new]).tolist()))
        get = self.known.__getitem__
        return [document_features(np.fromiter(map(get, d), np.float32, len(d))) for d in docs]


def _features(rows: DataFrame, model: ToxicityModel, scored: bool) -> DataFrame:
    """rows (_id, _y, _text) with features of the text, or its score."""
    names = ["score"] if scored else ["f1", "f2", "f3"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model)
        for batch in batches:
            got = [f for part in pieces(batch.column("_text").to_pylist()) for f in features.of(part)]
            x = np.array(got, float).reshape(-1, 3)
            columns = [model.score(x)] if scored else list(x.T)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *map(pa.array, columns)], [*rest, *names])

    rest = [c for c in rows.columns if c != "_text"]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest), *(f"{n} double" for n in names)])
    return rows.mapInArrow(of, schema)


def _margins(words: DataFrame, model: ToxicityModel) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.margins(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(float))], ["word", "margin"])

    return words.mapInArrow(of, "word string, margin double")


def _seen_words(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many different documents of each label a word, or a window of a longer one, stands.

    Copies count once: documents whose smallest word hash is the same are one. Words are taken
    sentence by sentence, and each sentence has its document's label.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column("_text"), batch.column("_y").to_pylist()):
                own = {w.strip(EDGES) for s in sentences(text.as_py() or "") for w in tokens(s)}
                words = list({part for w in own if w for part in windows(w)})
                if words:
                    sign = min(xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in words) >> 1
                    n = len(words)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(words), pa.array([y] * n, pa.int32()), pa.array([sign] * n, pa.int64())], ["word", "y", "sign"]
                    )

    seen = rows.select("_text", "_y").mapInArrow(of, "word string, y int, sign bigint").distinct()
    return seen.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, ...]:
    """Bias and weights of a logistic regression by Newton steps."""
    z = np.concatenate((np.ones((len(x), 1)), x), axis=1)
    w, penalty = np.zeros(z.shape[1]), np.r_[1e-6, np.full(x.shape[1], ridge * len(x))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return tuple(float(v) for v in w)


def rising(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """logistic() with no weight below 0, as more toxic words never make a document less toxic: features that would get one are left out."""
    used = list(range(x.shape[1]))
    while True:
        bias, *found = logistic(x[:, used], y)
        if min(found, default=0.0) >= 0:
            break
        used = [u for u, w in zip(used, found) if w >= 0]
    weights = dict(zip(used, found))
    return (bias, *(weights.get(k, 0.0) for k in range(x.shape[1])))


def first_rows(rows: DataFrame, most: int, by: Column, rank: Column | None = None) -> DataFrame:
    """`most` rows at most (all, if there are no more): by falling rank, and within the rank that is cut, by hash of `by`, whole parts of PARTS.

    The driver gets a number for each rank and for each part, never a row, so what it holds does not grow with rows or partitions.
    """
    ranked = rows.withColumns({"_rank": F.lit(0) if rank is None else rank, "_share": F.pmod(F.xxhash64(by), F.lit(1 << 31)) / F.lit(float(1 << 31))})
    left, cut = most, None
    for r in sorted(ranked.groupBy("_rank").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["_rank"]):
        if r["n"] > left:
            cut = r
            break
        left -= r["n"]
    if cut is None:
        return ranked.drop("_rank", "_share")
    width = min(1.0, 4.0 * max(1, left) / cut["n"])
    part = F.floor(F.col("_share") / width * PARTS).cast("int")
    counts = ranked.filter((F.col("_rank") == cut["_rank"]) & (F.col("_share") < width)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    parts = 0
    for r in sorted(counts, key=lambda r: r["part"]):
        if r["n"] > left:
            break
        left, parts = left - r["n"], r["part"] + 1
    kept = (F.col("_rank") > cut["_rank"]) | (F.col("_rank") == cut["_rank"]) & (F.col("_share") < parts * width / PARTS)
    return ranked.filter(kept).drop("_rank", "_share")


def _sentences(sample: DataFrame, pointers: frozenset[str]) -> DataFrame:
    """(y, words) of the labelled sentences, each as its bare words, longer ones as their windows: of toxic documents those with a pointer, of clean documents all; equal sentences once.

    A sentence of more than SENTENCE_WORDS of these is several, so each is bounded in bytes, too.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column("_text"), batch.column("_y").to_pylist()):
                found = []
                for s in sentences(text.as_py() or ""):
                    words = [part for w in tokens(s) for part in windows(w.strip(EDGES))]
                    for k in range(0, len(words), SENTENCE_WORDS):
                        own = [w for w in words[k : k + SENTENCE_WORDS] if w]
                        if own and (y == 0 or not pointers.isdisjoint(own)):
                            found.append(own)
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(found), pa.int32()), pa.array(found, pa.list_(pa.string()))], ["y", "words"])

    return sample.select("_text", "_y").mapInArrow(of, "y int, words array<string>").distinct()


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN,
    toxic_sentences: int = TOXIC_SENTENCES, clean_sentences: int = CLEAN_SENTENCES, hard_words: int = HARD_WORDS, pointers: int = POINTERS, landmarks: int = LANDMARKS, seen_in: int = SEEN_IN,
) -> ToxicityModel:
    """Learns from labelled sentences of a bounded sample of labelled rows; the driver holds cut sentences, words, counts and features of the sample, never texts.

    Bounds, all parameters: labelled rows of each class (toxic_rows, clean_rows), sentences of each class that the machine is trained on (toxic_sentences, clean_sentences),
    words that first point at toxic sentences (pointers), clean words that look most toxic to the first machine (hard_words), and its landmarks. What exceeds a bound is
    left out by hash, never by place.

    Sentences get their document's label. A sentence is as toxic as its most toxic word (a bag of words, of which one is its witness): the machine learns the witness of each toxic
    sentence against all words of the clean ones. Most sentences of a toxic document are clean, so those are taken that hold a word which seen_in toxic documents and no clean one
    have. Their first witnesses are such words; the first machine then chooses each sentence's witness anew, and the second is learned from these, and from the clean words that
    the first takes for toxic. Witnesses are learned with inserted characters too. A document's score is a logistic function of its words' margins.

    Rows with a null id or label are ignored; an id labelled twice takes its larger label, one with several texts one of them. Without both
    classes, or without words that tell them apart, every document scores the smoothed rate of the label.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    )
    known = stored(known, "labels")
    rate = known.agg(((F.sum("_y") + 0.5) / (F.count("_y") + 1.0)).alias("r")).first()["r"]
    rate = 0.5 if rate is None else float(rate)
    flat = ToxicityModel(np.zeros(CLASSES**3, np.float32), -MARGIN, (math.log(rate / (1 - rate)), 0.0, 0.0, 0.0))
    wanted = first_rows(known.filter("_y = 1"), toxic_rows, F.col("_id")).unionAll(first_rows(known.filter("_y = 0"), clean_rows, F.col("_id")))
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    # at most toxic_rows + clean_rows ids of a few bytes are broadcast
    sample = rows.join(F.broadcast(wanted), F.col("_doc") == F.col("_id")).groupBy("_id", "_y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    sample = stored(sample, "toxicity-sample")
    words = stored(_seen_words(sample), "seen-words")
    pointing = first_rows(words.filter(f"clean = 0 and toxic >= {seen_in}"), pointers, F.col("word"), F.col("toxic")).collect()
    seen = {w["word"]: min(w["toxic"] - seen_in + 1, 20) for w in pointing}
    bags = stored(_sentences(sample, frozenset(seen)), "labelled-sentences")
    chosen = [first_rows(bags.filter(F.col("y") == y), n, F.col("words")) for y, n in ((1, toxic_sentences), (0, clean_sentences))]
    toxic, clean = (sorted(r["words"] for r in c.collect()) for c in chosen)
    if not toxic or not clean:
        for table in (known, sample, words, bags):
            drop_stored(table)
        return flat

    def learned(witnesses: Sequence[str], hard: Sequence[str]) -> tuple[np.ndarray, float]:
        r, counts = random.Random(42), Counter(witnesses)
        found = [(w, 1, min(n, 20)) for w, n in sorted(counts.items())]
        found += [(varied(w, r), 1, min(n, 20) / 4) for w, n in sorted(counts.items()) for _ in range(2)]
        innocent = sorted({w for s in clean for w in s}.difference(counts))
        found += [(w, 0, 1.0) for w in innocent]
        found += [(varied(w, r), 0, 0.25) for w in innocent[::2]]
        found += [(w, 0, 1.0) for w in sorted(set(hard).difference(innocent, counts))]
        marks, beta, bias = fit_machine(*map(np.array, zip(*found)), landmarks=landmarks)
        return folded(marks, beta), bias

    table, bias = learned([max((w for w in s if w in seen), key=lambda w: (seen[w], w)) for s in toxic], ())
    first = ToxicityModel(table, bias, flat.document)
    margins = dict(zip(every := sorted({w for s in toxic for w in s}), first.margins(every).tolist()))
    # a sentence whose most toxic word stands in clean documents, too, keeps the word that pointed at it
    innocent = {w for s in clean for w in s}
    witnesses = [max((w for w in s if w in seen or w not in innocent), key=lambda w: (w in seen, margins[w], w)) for s in toxic]
    hard = first_rows(_margins(words.filter("clean > 0").select("word"), first).filter("margin > -1"), hard_words, F.col("word"), F.floor(F.col("margin") * 50).cast("int"))
    table, bias = learned(witnesses, [w["word"] for w in hard.collect()])
    model = ToxicityModel(table, bias, flat.document)
    got = _features(sample, model, scored=False).toPandas().sort_values(["_id", "f1", "f2", "f3"], kind="stable")
    for table_ in (known, sample, words, bags):
        drop_stored(table_)
    if got["_y"].nunique() < 2:
        return flat
    return ToxicityModel(table, bias, rising(got[["f1", "f2", "f3"]].to_numpy(float), got["_y"].to_numpy(float)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row, in the scan of docs, without a shuffle; score is 0 to 1.

    Null and empty texts score as texts without words; repeated rows score alike; texts of any length are read whole;
    an empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return _features(rows, model, scored=True).withColumnRenamed("_id", id_col)
