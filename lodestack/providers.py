"""Models behind a small interface, and the pipeline that calls them row by row, keeping failures apart."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestack.functions.text import ANSWER_PROMPT, MERGE_PROMPT, QUESTION_PROMPT, detections_text, filled, path_order, rendered, split_reasoning
from lodestack.operators.raster import detection_rows
from lodestack.schemas import DETECTIONS
from lodestack.session import written

#: The answer that stands in for the second one where it was not asked for, and the sources of merged answers.
NO_SECOND_ANSWER = "No second answer was generated for this sample."
MERGED_WITH_SECOND, MERGED_ALONE = "merged_with_second", "merged_with_detections"


class Generator(Protocol):
    """Text from an image path and a prompt. Calls may be repeated when a task is retried, so they should be idempotent."""

    def generate(self, image: str, prompt: str, max_tokens: int, temperature: float) -> str: ...


class Stub:
    """A generator whose reply depends on its input alone."""

    def __init__(self, fails: Callable[[str], bool] = lambda image: False) -> None:
        self.fails = fails

    def generate(self, image: str, prompt: str, max_tokens: int, temperature: float) -> str:
        if self.fails(image):
            raise ValueError(f"no reply for {image}")
        token = hashlib.md5(f"{image}|{prompt}".encode()).hexdigest()[:8]
        return f'{{"reasoning": ["seen {token}"], "final_answer": "A possible fault at {token}."}}'


def called(rows: DataFrame, provider: Callable[[], Generator], prompt: Column, into: str, image: str = "image", max_tokens: int = 1536, temperature: float = 0.0) -> DataFrame:
    """rows with `into` and `error`: the reply to each prompt. provider() is made once a task; rows that have an error already are not sent."""
    if "error" not in rows.columns:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    asked = rows.drop(into).withColumn("_prompt", prompt)
    schema = rows.drop(into).withColumn(into, F.lit(None).cast("string")).schema
    names = schema.names

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for pdf in batches:
            replies, errors = [], []
            for path, text, error in zip(pdf[image], pdf["_prompt"], pdf["error"]):
                reply = None
                if error is None:
                    try:
                        reply = model.generate(path, text, max_tokens, temperature)
                    except Exception as e:  # one bad row must not end the others
                        error = f"{type(e).__name__}: {e}"
                replies.append(reply)
                errors.append(error)
            yield pdf.assign(**{into: replies, "error": errors})[names]

    return asked.mapInPandas(of, schema)


class Detector(Protocol):
    """Detections of an image as parallel arrays: boxes, scores, classes (or None), mask coverages and outlines (both may be shorter)."""

    def detect(self, image: str, confidence: float) -> dict[str, list]: ...


#: The names of classes, and what detections are kept, by default and while generating.
CONFIDENCE, GENERATION_CONFIDENCE = 0.25, 0.05
_FOUND = "boxes array<array<double>>, scores array<double>, classes array<int>, coverages array<double>, outlines array<array<array<double>>>"


def detected(images: DataFrame, provider: Callable[[], Detector] | None, names: Mapping[int, str] | None = None, confidence: float = CONFIDENCE, image: str = "image") -> DataFrame:
    """images with `detections` of a confidence on and `error`; without a detector no image has any. provider() is made once a task."""
    if provider is None:
        return images.withColumn("detections", F.expr(f"cast(array() as {DETECTIONS})")).withColumn("error", F.lit(None).cast("string"))
    keys = [f.strip().split(" ")[0] for f in _FOUND.split(", ")]
    schema = StructType(images.schema.fields + StructType.fromDDL(_FOUND).fields + StructType.fromDDL("error string").fields)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for pdf in batches:
            found, errors = [], []
            for path in pdf[image]:
                try:
                    found.append(model.detect(path, confidence))
                    errors.append(None)
                except Exception as e:  # one bad image must not end the others
                    found.append({})
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(**{k: [f.get(k) for f in found] for k in keys}, error=errors)

    labels = F.create_map(*(F.lit(v) for pair in (names or {}).items() for v in pair)) if names else F.expr("cast(map() as map<int,string>)")
    # a model that ignores the threshold is held to it
    made = detection_rows(F.col("boxes"), F.col("scores"), F.col("classes"), labels, F.col("coverages"), F.col("outlines"), confidence)
    rows = images.mapInPandas(of, schema)
    return rows.select(*images.columns, F.coalesce(made.cast(DETECTIONS), F.expr(f"cast(array() as {DETECTIONS})")).alias("detections"), "error")


def generate(images: DataFrame, generator: Callable[[], Generator], second: Callable[[], Generator] | None = None) -> DataFrame:
    """images (image, split, detections) with question, answers, merged answer and error; a row whose call fails goes on as an error row.

    The merged answer falls back to the first and then to the second answer.
    """
    rows = called(images, generator, F.lit(QUESTION_PROMPT), "_question", max_tokens=256, temperature=0.7)
    rows = rows.withColumn("question", split_reasoning(F.col("_question"))["answer"]).drop("_question")
    shown = detections_text(F.col("detections"))
    rows = called(rows, generator, rendered(ANSWER_PROMPT, question=F.col("question"), detections=shown), "generator_answer_raw")
    if second is None:
        rows = rows.withColumn("second_answer_raw", F.lit(""))
    else:
        rows = called(rows, second, F.col("question"), "second_answer_raw")
    rows = rows.withColumn("_g", split_reasoning(F.col("generator_answer_raw"))).withColumn("_s", split_reasoning(F.col("second_answer_raw")))
    if second is None:
        rows = rows.withColumn("_s", F.struct(F.col("_s.reasoning").alias("reasoning"), F.lit(NO_SECOND_ANSWER).alias("answer")))
    prompt = rendered(
        MERGE_PROMPT, question=F.col("question"), detections=shown, first_reasoning=F.to_json("_g.reasoning"), first_answer=F.col("_g.answer"),
        second_reasoning=F.to_json("_s.reasoning"), second_answer=F.col("_s.answer"),
    )
    rows = called(rows, generator, prompt, "merged_answer_raw").withColumn("_m", split_reasoning(F.col("merged_answer_raw")))
    return rows.select(
        *images.columns, "question", "generator_answer_raw", F.col("_g.reasoning").alias("generator_reasoning"), F.col("_g.answer").alias("generator_answer"),
        "second_answer_raw", F.col("_s.reasoning").alias("second_reasoning"), F.col("_s.answer").alias("second_answer"), "merged_answer_raw",
        F.col("_m.reasoning").alias("merged_reasoning"), filled(F.col("_m.answer"), F.col("_g.answer"), F.col("_s.answer")).alias("merged_answer"),
        F.lit(MERGED_ALONE if second is None else MERGED_WITH_SECOND).alias("answer_source"), "error",
    )


#: Images of a round, at least.
ROUND = 64


def in_rounds(images: DataFrame, run: Callable[[DataFrame], DataFrame], limit: int, least: int = ROUND, image: str = "image") -> DataFrame:
    """run(images) (for example generate()) of as many images in order of paths as give `limit` successes, round by round; further images are never sent to a model.

    The rows are those of trying images one by one: the first `limit` successes, and the failures before the last of them; fewer where there are not so many. A round has
    as many images as successes are short, or `least`, and is spread over the whole cluster; it starts only while successes are short. Its rows are written to the
    shared folder, so that no reply is asked for twice; the driver sees two numbers a round. run must keep its input's columns and tell failures by `error`.
    """
    ordered = images.orderBy(path_order(F.col(image))).withColumn("_number", F.monotonically_increasing_id())
    ordered = written(ordered, "images")
    # places in order: a row's number within its partition, behind the rows of all partitions before it (one small row each)
    part = F.shiftright("_number", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_number").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ordered.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_place", place).drop("_part", "_before", "_number")
    total, got, at, done = ordered.count(), 0, 0, []
    tasks = images.sparkSession.sparkContext.defaultParallelism
    while got < limit and at < total:
        to = min(total, at + max(least, limit - got))
        rows = placed.filter((F.col("_place") >= at) & (F.col("_place") < to)).repartition(tasks, "_place")
        made = written(run(rows), "round")
        good = made.filter("error is null").select("_place")
        if got + (n := good.count()) >= limit:
            last = good.orderBy("_place").limit(limit - got).agg(F.max("_place")).first()[0]
            made = made.filter(F.col("_place") <= F.lit(-1 if last is None else last))
        done.append(made)
        got, at = got + n, to
    if not done:
        return run(images.limit(0))
    return functools.reduce(DataFrame.unionByName, done).drop("_place")


def succeeded(rows: DataFrame) -> DataFrame:
    return rows.filter("error is null").drop("error")


def failed(rows: DataFrame) -> DataFrame:
    return rows.filter("error is not null").select("image", "split", "error")


def first_successes(rows: DataFrame, n: int, path: str = "image") -> DataFrame:
    """The first n rows without an error, in order of paths; failures do not count towards n."""
    return rows.filter("error is null").orderBy(path_order(F.col(path))).limit(n)


def sample_pair(rows: DataFrame, has: Column, path: str = "image", most: int = 200) -> DataFrame:
    """Of the first `most` rows in order of paths, the first where `has` holds and the first where it does not."""
    scanned = rows.withColumn("has", has).orderBy(path_order(F.col(path))).limit(most)
    turn = F.row_number().over(Window.partitionBy("has").orderBy(path_order(F.col(path))))
    return scanned.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")
