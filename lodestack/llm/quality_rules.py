"""Quality classifier: a sparse ensemble of rules over text statistics (RuleFit)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import SPACES, WORD, drop_stored, stored
from lodestack.llm.toxicity import first_rows

#: Labelled rows to learn from at most, the first in an order by hash.
SAMPLE_ROWS = 8_000
#: Rules at most; the penalty rises until no more are left. So few are compiled to machine code in one piece.
MOST_RULES = 32


def with_statistics(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """docs with a struct `into` of statistics(), computed once for each row.

    Words are counted in a projection of their own, as six statistics use the count; a generator of one row
    then makes the struct, so that no rule or filter on it computes a statistic again.
    """
    words = f"{into}_words"
    counted = docs.withColumn(words, F.regexp_count(F.coalesce(docs[text_col].cast("string"), F.lit("")), F.lit(WORD)))
    struct = F.struct(*(v.alias(k) for k, v in statistics(F.col(text_col), F.col(words)).items()))
    return counted.select("*", F.explode(F.array(struct)).alias(into)).drop(words)


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Statistics of a whole text with so many words, as column expressions; of an empty text all are 0."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.length(text)
    lines = F.split(text, "\n")

    def rate(n: Column, of: Column) -> Column:
        return F.when(of > 0, n / of).otherwise(F.lit(0.0))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    return {
        "log_words": F.log1p(words),
        "word_length": rate(chars, words),
        "distinct_words": rate(F.size(F.array_distinct(F.split(F.trim(F.regexp_replace(text, SPACES, " ")), " "))), words),
        "distinct_lines": rate(F.size(F.array_distinct(lines)), F.size(lines)),
        "upper_case": rate(count(r"\p{Lu}"), chars),
        "digits": rate(count(r"\p{Nd}"), chars),
        "symbols": rate(count(r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"()\-|]"), words),
        "bars": rate(count(r"\|"), words),
        "exclamations": rate(count("!"), words),
        "stops": rate(count("[.,;:?]"), words),
    }


NAMES = ("log_words", "word_length", "distinct_words", "distinct_lines", "upper_case", "digits", "symbols", "bars", "exclamations", "stops")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    weight: float


@dataclass(frozen=True)
class RuleModel:
    """score = logistic(bias + the sum of the weights of the rules that hold)."""

    bias: float
    rules: tuple[Rule, ...]

    def score(self, features: dict[str, Column]) -> Column:
        margin = F.lit(self.bias)
        for rule in self.rules:
            holds = F.lit(True)
            for c in rule.conditions:
                holds = holds & (features[c.feature] > c.cut if c.above else features[c.feature] <= c.cut)
            margin = margin + F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _cuts(x: np.ndarray, most: int = 64) -> np.ndarray:
    """Middles between neighbouring values, at quantiles and in the widest gaps."""
    values = np.unique(x)
    if len(values) < 2:
        return np.zeros(0)
    middles, gaps = (values[1:] + values[:-1]) / 2, np.diff(values)
    if len(middles) <= most:
        return middles
    spread = np.linspace(0, len(middles) - 1, most // 2).astype(int)
    return np.unique(np.concatenate((middles[spread], middles[np.argsort(-gaps, kind="stable")[: most // 2]])))


def _tree(codes: np.ndarray, bins: Sequence[int], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int) -> tuple[list, np.ndarray]:
    """Paths [(feature, bin, above)...] to every node but the root, and the step for each row."""
    paths, step = [], np.zeros(len(grad))
    todo = [(rows, np.arange(len(grad)), ())]
    while todo:
        own, all_own, path = todo.pop()
        g, h = grad[own].sum(), hess[own].sum()
        step[all_own] = -g / (h + 1.0)
        if len(path) == depth or len(own) < 10:
            continue
        best = (1e-6, None, None)
        for f in features:
            gs = np.bincount(codes[own, f], grad[own], bins[f] + 1).cumsum()[:-1]
            hs = np.bincount(codes[own, f], hess[own], bins[f] + 1).cumsum()[:-1]
            ns = np.bincount(codes[own, f], minlength=bins[f] + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < 3) | (ns > len(own) - 3)] = 0
            if len(gain) and gain.max() > best[0] * (1 + 1e-9):
                # the middle of equally good cuts is the farthest from both sides
                at = np.flatnonzero(gain >= gain.max() * (1 - 1e-9))
                best = (gain.max(), f, int(at[len(at) // 2]))
        if best[1] is None:
            continue
        _, f, k = best
        for above in (False, True):
            way = (*path, (int(f), k, above))
            paths.append(way)
            todo.append((own[(codes[own, f] > k) == above], all_own[(codes[all_own, f] > k) == above], way))
    return paths, step


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient; columns of z lie in 0..1."""
    n, m = z.shape
    z, y = z.astype(np.float32, copy=False), y.astype(np.float32, copy=False)  # all in one type, so that no product copies z
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w, b = np.zeros(m, np.float32), math.log(rate / (1 - rate))
    vw, vb, t = w.copy(), b, 1.0
    probe = np.ones(m, np.float32)
    for _ in range(20):
        probe = z.T @ (z @ probe) / n
        probe /= np.linalg.norm(probe) or 1
    lip = 0.25 * (float(np.linalg.norm(z @ probe)) ** 2 / n + 1.0) + 1e-9
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(z @ vw + vb))) - y
        nw = vw - z.T @ error / n / lip
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / lip, 0)
        nb = vb - float(error.mean()) / lip
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def fit_rules(x: np.ndarray, y: np.ndarray, names: Sequence[str], trees: int = 40, depth: int = 3, penalty: float = 5e-4, seed: int = 42) -> RuleModel:
    """Boosted trees on half the rows each; their paths as rules; lasso weights, MOST_RULES at most; zero weights are dropped.

    With no rows the score is 0.5; with one class it is that class's smoothed rate.
    """
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    flat = RuleModel(math.log(rate / (1 - rate)), ())
    if len(y) == 0 or y.min() == y.max():
        return flat
    rng = np.random.default_rng(seed)
    cuts = [_cuts(x[:, f]) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    useful = np.array([f for f, c in enumerate(cuts) if len(c)])
    if not len(useful):
        return flat
    margin, paths = np.full(len(y), flat.bias), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.choice(len(y), max(2, len(y) // 2), replace=False))
        some = np.sort(rng.choice(useful, max(1, (2 * len(useful) + 2) // 3), replace=False))
        found, step = _tree(codes, [len(c) for c in cuts], p - y, p * (1 - p), rows, some, depth)
        margin += 0.2 * step
        paths.update(dict.fromkeys(found))

    def holds(path: tuple) -> np.ndarray:
        return np.all([(codes[:, f] > k) == above for f, k, above in path], axis=0)

    columns: dict[bytes, tuple] = {}  # of rules that hold for the same rows the shortest
    for path in sorted(paths, key=len):
        own = holds(path)
        if 0 < own.sum() < len(y):
            columns.setdefault(np.packbits(own).tobytes(), path)
    kept = list(columns.values())
    if not kept:
        return flat
    z = np.stack([holds(path) for path in kept], axis=1).astype(np.float32)
    w, b = _lasso(z, y, penalty)
    while (np.abs(w) > 1e-3).sum() > MOST_RULES:
        penalty *= 1.5
        w, b = _lasso(z, y, penalty)
    rules = [
        Rule(tuple(Condition(names[f], above, float(cuts[f][k])) for f, k, above in path), float(v))
        for path, v in zip(kept, w)
        if abs(v) > 1e-3
    ]
    return RuleModel(b, tuple(rules))


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Learns from sample_rows labelled rows at most, one of each id; the driver holds their statistics, not their texts.

    The sample is cut by hash (first_rows()), so no task and not the driver sees more rows than it keeps. Rows with a null id or label are ignored; an id labelled
    twice takes its larger label, and of rows that share an id those statistics count that are smallest in the order of their names.
    """
    wanted = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .dropna()
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
    )
    wanted = stored(wanted, "labels")
    chosen = first_rows(wanted, sample_rows, F.col("_id"))
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    # at most sample_rows ids of a few bytes are broadcast
    sample = rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    known = with_statistics(sample, "_text", "_stats").groupBy("_id", "_y").agg(F.min("_stats").alias("_stats")).select("_id", "_y", "_stats.*")
    got = known.toPandas().sort_values(["_id", *NAMES], kind="stable")
    drop_stored(wanted)
    return fit_rules(got[[*NAMES]].to_numpy(float), got["_y"].to_numpy(int), NAMES)


def score_quality(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """docs with a column `score`, 0 to 1, computed by column expressions in the scan of docs.

    Null texts score as empty ones; repeated rows score alike; texts of any length are read whole; an empty table stays empty. A column `score` that docs
    have is replaced.
    """
    held = f"_stats_{len(docs.columns)}"
    known = with_statistics(docs, text_col, held)
    return known.withColumn("score", model.score({k: F.col(held)[k] for k in NAMES})).drop(held)
