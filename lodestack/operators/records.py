"""Chat records for instruction tuning: messages, questions, answers, label sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import DEFAULT_QUESTION, filled, filled_array, joined_reasoning, strip
from lodestack.schemas import CONTENT_ITEM, DETECTIONS

#: Fields of a record that may name its label file, in order.
LABEL_FIELDS = ("fault_mask_path", "mask_path", "segmentation_mask_path", "fault_label_path", "yolo_label_path")
#: Texts of records whose answer is the mask alone.
OVERLAY_QUESTION = "Is there evidence of a fault in this image?"
OVERLAY_POSITIVE = "Yes; the fault mask of this image marks where."
OVERLAY_NEGATIVE = "No; the fault mask of this image is empty."


def text_item(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"), text.alias("text")).cast(CONTENT_ITEM)


def image_item(image: Column) -> Column:
    return F.struct(F.lit("image").alias("type"), image.alias("image"), F.lit(None).cast("string").alias("text")).cast(CONTENT_ITEM)


def message(role: str, *items: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*items).alias("content"))


def exchange(image: Column, question: Column, answer: Column) -> Column:
    """A user's image and question and the assistant's answer."""
    return F.array(message("user", image_item(image), text_item(question)), message("assistant", text_item(answer)))


def sft_record(image: Column, question: Column, reasoning: Column, answer: Column, source: Column, detections: Column) -> list[Column]:
    return [
        image.alias("image"), question.alias("question"), source.alias("answer_source"), F.coalesce(detections, F.expr(f"cast(array() as {DETECTIONS})")).alias("detections"),
        filled_array(reasoning).alias("reasoning"), answer.alias("answer"), exchange(image, question, joined_reasoning(reasoning, answer)).alias("messages"),
    ]


def instruction_record(
    image: Column, split: Column, question: Column, detections: Column, generator: tuple[Column, Column, Column], second: tuple[Column, Column, Column], merged: tuple[Column, Column, Column]
) -> list[Column]:
    """Sixteen fields; generator, second and merged are (raw, reasoning, answer), and a missing raw text is the answer."""
    out = [image.alias("image"), split.alias("split"), question.alias("question"), detections.alias("detections")]
    for name, (raw, reasoning, answer) in (("generator", generator), ("second", second), ("merged", merged)):
        out += [filled(raw, answer).alias(f"{name}_answer_raw"), filled_array(reasoning).alias(f"{name}_reasoning"), answer.alias(f"{name}_answer")]
    out += [exchange(image, question, answer).alias(f"messages_{name}") for name, (_, _, answer) in (("generator", generator), ("second", second))]
    raw, reasoning, answer = merged
    return [*out, exchange(image, question, joined_reasoning(reasoning, F.coalesce(answer, F.lit("")))).alias("messages_merged")]


def overlay_record(image: Column, split: Column, label_path: Column, label_text: Column) -> list[Column]:
    """A record whose answer tells whether the label file has content."""
    answer = F.when(F.coalesce(strip(label_text), F.lit("")) != "", F.lit(OVERLAY_POSITIVE)).otherwise(F.lit(OVERLAY_NEGATIVE))
    question = F.lit(OVERLAY_QUESTION)
    return [
        image.alias("image"), split.alias("split"), question.alias("question"), answer.alias("answer"), label_path.alias("fault_label_path"),
        exchange(image, question, answer).alias("messages"),
    ]


def _texts(m: Column) -> Column:
    return F.filter(m["content"], lambda i: i["type"] == "text")


def assistant_text(messages: Column) -> Column:
    """Text of the first assistant message that has a text item, else an empty text."""
    said = F.filter(messages, lambda m: (m["role"] == "assistant") & (F.size(_texts(m)) > 0))
    first = F.get(said, F.lit(0))
    return F.coalesce(F.get(_texts(first), F.lit(0))["text"], F.lit(""))


def question_text(question: Column, messages: Column, default: str = DEFAULT_QUESTION) -> Column:
    """The question, else the texts of the first user message by lines, else a default."""
    asked = F.filter(messages, lambda m: m["role"] == "user")
    joined = strip(F.array_join(F.transform(_texts(F.get(asked, F.lit(0))), lambda i: F.coalesce(i["text"], F.lit(""))), "\n"))
    return F.coalesce(F.nullif(question, F.lit("")), F.when(F.coalesce(F.size(asked), F.lit(0)) > 0, F.coalesce(joined, F.lit(""))), F.lit(default))


def label_source(real_path: Column, detections: Column, allow_pseudo: bool) -> Column:
    """real, pseudo or missing. Detections count if the field is there, even empty."""
    out = F.when(real_path.isNotNull(), "real")
    return (out.when(detections.isNotNull(), "pseudo") if allow_pseudo else out).otherwise("missing")


def label_source_counts(rows: DataFrame, source: str = "label_source") -> DataFrame:
    """One row with all three counts, 0 where there are none."""
    return rows.agg(*(F.count_if(F.col(source) == s).alias(s) for s in ("real", "pseudo", "missing")))


def conversations(turns: DataFrame, by: str, order: str, role: str, text: str) -> DataFrame:
    """(by, messages) with the turns of a conversation in order. A conversation is one row here, as one chat record."""
    turn = F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.array(text_item(F.col(text))).alias("content"))
    gathered = turns.groupBy(by).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return gathered.select(by, F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def chosen_answer(*answers: Column, default: Column | None = None) -> Column:
    return F.coalesce(*(F.nullif(a, F.lit("")) for a in answers), default if default is not None else F.lit(""))


def label_candidates(row: DataFrame, fields: Sequence[str] = LABEL_FIELDS) -> list[Column]:
    return [F.col(f) for f in fields if f in row.columns]


def training_rows(rows: DataFrame, listing: DataFrame, labels: DataFrame, allow_pseudo: bool = False, size: int = 32) -> DataFrame:
    """(row_id, image, question, answer, mask, present, valid, source) of records (row_id, image, width, height, question, messages, chosen_answer, detections, label fields).

    listing: paths that exist. labels: (path, lines array<string>, values array<float>), lines of .txt labels and masks of array files. Labels meet records by an equality.
    """
    from lodestack.operators.pairing import real_labels
    from lodestack.operators.raster import target

    found = real_labels(rows, listing).join(labels.select(F.col("path").alias("_path"), "lines", "values"), F.col("label_path") == F.col("_path"), "left")
    t = target(F.col("label_path"), F.col("lines"), F.col("values"), F.col("detections"), F.col("width"), F.col("height"), allow_pseudo, size)
    answer = chosen_answer(assistant_text(F.col("messages")), F.col("chosen_answer"))
    # inline() makes a target once; as a column it would be made again for each of its fields
    return found.select("row_id", "image", question_text(F.col("question"), F.col("messages")).alias("question"), answer.alias("answer"), F.inline(F.array(t)))
