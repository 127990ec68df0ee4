"""Batches, losses and vectors for training, as expressions and aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import bound

#: Label of positions without supervision; smoothing of the overlap loss; tokens of the visual prefix.
IGNORED, SMOOTHING, PREFIX_TOKENS = -100, 1e-6, 8
POSITIVE_WEIGHT, GAMMA, LEAST_DOUBT = 20.0, 2.0, 1e-6


def token_rows(rows: DataFrame, prompt: str = "prompt_ids", answer: str = "answer_ids", most: int = 2048) -> DataFrame:
    """rows with ids, labels and mask: the answer first, up to most - 1 tokens, then as many of the prompt's last tokens as fit. `error` if the answer is empty."""
    kept = F.slice(F.col(answer), 1, most - 1)
    room = F.lit(most) - F.size(kept)
    size = F.size(prompt)
    tail = F.slice(F.col(prompt), F.greatest(size - room + 1, F.lit(1)), F.least(room, size))
    ignored = F.array_repeat(F.lit(IGNORED), F.size(tail))
    return rows.select(
        "*", F.concat(tail, kept).alias("ids"), F.concat(ignored, kept).alias("labels"), F.array_repeat(F.lit(1), F.size(tail) + F.size(kept)).alias("mask"),
        F.when(F.coalesce(F.size(answer), F.lit(0)) == 0, F.lit("the answer has no tokens")).alias("error"),
    )


def padded(batches: DataFrame, batch: str = "batch", pad: int = 0) -> DataFrame:
    """ids, labels and mask of each batch padded to its longest row."""
    # lengths alone are aggregated, so the rows of a batch never meet in one task
    longest = batches.groupBy(F.col(batch).alias("_batch")).agg(F.max(F.size("ids")).alias("_most"))
    more = F.col("_most") - F.size("ids")
    filled = {c: F.concat(F.col(c), F.array_repeat(F.lit(v), more)) for c, v in (("labels", IGNORED), ("mask", 0), ("ids", pad))}
    return batches.join(longest, F.col(batch) == F.col("_batch")).select(*(filled[c].alias(c) if c in filled else F.col(c) for c in batches.columns))


def with_prefix(rows: DataFrame, tokens: int = PREFIX_TOKENS) -> DataFrame:
    """labels and mask with room for the visual prefix."""
    return rows.withColumns(
        {"labels": F.concat(F.array_repeat(F.lit(IGNORED), tokens), F.col("labels")), "mask": F.concat(F.array_repeat(F.lit(1), tokens), F.col("mask"))}
    )


def unsupervised_batches(batches: DataFrame, batch: str = "batch") -> DataFrame:
    """Batches without one supervised token."""
    return batches.groupBy(batch).agg(F.bool_or(F.exists("labels", lambda v: v != IGNORED)).alias("any")).filter("not any").select(batch)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def cross_entropy(logit: Column, target: Column) -> Column:
    """Binary cross entropy of a logit, without overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def focal_loss(logit: Column, target: Column, positive_weight: float = POSITIVE_WEIGHT, gamma: float = GAMMA) -> Column:
    """Cross entropy weighed by class, and less where the model is sure already; gamma 0 leaves that out. A target over 0.5 is of the positive class."""
    loss, positive = cross_entropy(logit, target), target > 0.5
    loss = F.when(positive, loss * positive_weight).otherwise(loss)
    if gamma > 0:
        p = sigmoid(logit)
        right = F.when(positive, p).otherwise(F.lit(1.0) - p)
        loss = loss * F.pow(F.greatest(F.lit(1.0) - right, F.lit(LEAST_DOUBT)), F.lit(gamma))
    return loss


def dice_loss(cells: DataFrame, sample: str, logit: str, target: str) -> DataFrame:
    """(sample, dice_loss): one less the smoothed overlap of predicted and true masks."""
    p, t = sigmoid(F.col(logit)), F.col(target)
    sums = cells.groupBy(sample).agg(F.sum(p * t).alias("both"), F.sum(p).alias("p"), F.sum(t).alias("t"))
    return sums.select(sample, (1.0 - (2.0 * F.col("both") + SMOOTHING) / (F.col("p") + F.col("t") + SMOOTHING)).alias("dice_loss"))


def supervised_losses(samples: DataFrame, valid: str, by: str | None = None) -> DataFrame:
    """Means of focal, dice and presence loss over the samples whose mask counts (valid above 0.5), and their number; per `by`, or one row. No such sample: null losses, 0."""
    counts = F.col(valid) > 0.5
    means = [F.avg(F.when(counts, F.col(c))).alias(c) for c in ("focal_loss", "dice_loss", "presence_loss")]
    grouped = samples.groupBy(by) if by else samples.groupBy()
    return grouped.agg(*means, F.count_if(counts).alias("supervised"))


def composite_loss(language: Column, focal: Column, dice: Column, present: Column, overlay_weight: float = 0.25, presence_weight: float = 0.10) -> Column:
    """The language loss, with the mask's losses where there are any."""
    more = overlay_weight * (focal + dice) + presence_weight * present
    return language + F.coalesce(more, F.lit(0.0))


def softmax(values: Column) -> Column:
    """Of an array, its largest value taken off first."""
    raised = bound(F.array_max(values), lambda top: F.transform(values, lambda v: F.exp(v.cast("double") - top)))
    return bound(raised, lambda r: bound(F.aggregate(r, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(r, lambda v: v / total)))


def argmax(values: Column) -> Column:
    """Place of the largest value, the first of equals, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def class_name(place: Column, names: Sequence[str]) -> Column:
    """The name of a class, or LABEL_i where it has none."""
    return F.coalesce(F.get(F.array(*map(F.lit, names)), place), F.concat(F.lit("LABEL_"), place.cast("string")))


def without_special(ids: Column, special: Sequence[int]) -> Column:
    return F.filter(ids, lambda i: ~i.isin(*special))


def token_variants(ids: Column, special: Sequence[int]) -> Column:
    """The ids to decode, in order of preference: as they are, and without special tokens where that leaves some and changes them."""
    own = without_special(ids, special)
    return F.when((F.size(own) > 0) & (F.size(own) < F.size(ids)), F.array(ids, own)).otherwise(F.array(ids))


def masked_mean(vectors: DataFrame, by: Sequence[str], vector: str, mask: str) -> DataFrame:
    """(by, dim, mean) of vectors whose mask counts, divided by the mask's sum, 1 at least."""
    cells = vectors.select(*by, F.col(mask).cast("double").alias("_m"), F.posexplode(vector).alias("dim", "_v"))
    mean = F.sum(F.col("_v").cast("double") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(1.0))
    return cells.groupBy(*by, "dim").agg(mean.alias("mean"))


def loss_series(log: DataFrame) -> DataFrame:
    """(step, series, value) of a training log; items without a step or a value are left out."""
    return log.filter("step is not null").selectExpr("step", "stack(2, 'train', loss, 'eval', eval_loss) as (series, value)").filter("value is not null")
