"""Claims checked against detector evidence: premise, rules, verdicts, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import ABSENCE_TERMS, CERTAINTY_TERMS, FAULT_TERMS, UNCERTAINTY_TERMS, filled, fixed, mentions, normalized_claim

#: Verdicts in the order of a model's classes, and those that remove a row.
LABELS = ("SUPPORT", "UNCERTAIN", "CONTRADICT", "OVERCLAIM")
REMOVED = ("CONTRADICT", "OVERCLAIM")
#: What the verifier looks for in a premise.
NO_DETECTIONS, WEAK = "produced no fault detections", "weak evidence only"
DETECTOR = "detector"


def _has(detection: Column, field: str) -> Column:
    return F.coalesce(F.size(detection[field]) > 0, F.lit(False))


def _number(detections: Column) -> Column:
    return F.coalesce(F.size(detections), F.lit(0))


def max_confidence(detections: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(detections, lambda d: F.coalesce(d["confidence"], F.lit(0.0)))), F.lit(0.0))


def evidence(detections: Column) -> Column:
    """struct of what detections show: whether, how many, the best score, boxes, polygons."""
    return F.struct(
        (_number(detections) > 0).alias("fault_present"),
        _number(detections).cast("bigint").alias("detection_count"),
        max_confidence(detections).alias("max_confidence"),
        F.coalesce(F.exists(detections, lambda d: _has(d, "box_xyxy")), F.lit(False)).alias("has_box_overlay"),
        F.coalesce(F.exists(detections, lambda d: _has(d, "polygon_xy_sample")), F.lit(False)).alias("has_polygon_overlay"),
    )


def premise(detections: Column, detector: str = DETECTOR) -> Column:
    """The detections in words."""

    def counted(field: str) -> Column:
        return F.size(F.filter(detections, lambda d: _has(d, field))).cast("string")

    found = F.concat(
        F.lit(f"Auxiliary {detector} produced "), _number(detections).cast("string"), F.lit(" fault detection(s), "), counted("box_xyxy"),
        F.lit(" boxed region(s), and "), counted("polygon_xy_sample"), F.lit(" polygon overlay sample(s). The maximum detection confidence is "),
        fixed(max_confidence(detections), 3), F.lit("."),
    )
    none = f"Auxiliary {detector} {NO_DETECTIONS} for this image. This absence is {WEAK} and does not prove faults are absent."
    return F.when(_number(detections) == 0, F.lit(none)).otherwise(found)


def nli(detections: Column, *answers: Column, detector: str = DETECTOR) -> Column:
    """Premise and hypothesis of a row; the hypothesis is the first of answers that is not empty."""
    return F.struct(
        premise(detections, detector).alias("premise"),
        normalized_claim(filled(*answers)).alias("hypothesis"),
        F.lit("fault_overlay_claim").alias("claim_type"),
        evidence(detections).alias("variables"),
    )


def verdict(premise: Column, hypothesis: Column) -> Column:
    """struct(label, confidence, scores) by rule; the first rule that holds decides. An empty side is UNCERTAIN at 0 without scores."""

    def found(label: str, *scores: tuple[str, float]) -> Column:
        table = F.create_map(*(F.lit(x) for pair in scores for x in pair))
        return F.struct(F.lit(label).alias("label"), F.lit(scores[0][1]).alias("confidence"), table.alias("scores"))

    detected = ~F.lower(premise).contains(NO_DETECTIONS)
    weak = F.lower(premise).contains(WEAK)
    about = mentions(hypothesis, FAULT_TERMS)
    absent = about & mentions(hypothesis, ABSENCE_TERMS)
    certain, hedged = mentions(hypothesis, CERTAINTY_TERMS), mentions(hypothesis, UNCERTAINTY_TERMS)
    empty = F.struct(F.lit("UNCERTAIN").alias("label"), F.lit(0.0).alias("confidence"), F.expr("cast(map() as map<string,double>)").alias("scores"))
    S, U, C, O = LABELS
    return (
        F.when((F.coalesce(premise, F.lit("")) == "") | (F.coalesce(hypothesis, F.lit("")) == ""), empty)
        .when(~about, found(U, (U, 0.55), (S, 0.25), (C, 0.15), (O, 0.05)))
        .when(detected & absent, found(C, (C, 0.80), (U, 0.10), (S, 0.05), (O, 0.05)))
        .when(detected & certain, found(O, (O, 0.70), (S, 0.15), (U, 0.10), (C, 0.05)))
        .when(detected & hedged, found(S, (S, 0.72), (U, 1.0 - 0.72)))
        .when(detected, found(S, (S, 0.82), (U, 1.0 - 0.82)))
        .when(weak & absent & certain, found(O, (O, 0.76), (U, 0.18), (S, 0.06)))
        .when(weak & absent, found(S, (S, 0.62), (U, 0.30), (O, 0.08)))
        .otherwise(found(U, (U, 0.68), (S, 0.20), (C, 0.08), (O, 0.04)))
    )


def verify(rows: DataFrame, *answers: str, detections: str = "detections", detector: str = DETECTOR, verifier=verdict) -> DataFrame:
    """rows with nli and verification; verifier(premise, hypothesis) gives the struct, by rule or from a model. One narrow stage."""
    checked = rows.withColumn("nli", nli(F.col(detections), *(F.col(a) for a in answers), detector=detector))
    judged = checked.withColumn("_v", verifier(F.col("nli.premise"), F.col("nli.hypothesis")))
    remove = F.col("_v.label").isin(*REMOVED)
    whole = F.struct("_v.label", "_v.confidence", "_v.scores", remove.alias("remove"))
    return judged.withColumn("verification", whole).drop("_v")


def kept(verified: DataFrame) -> DataFrame:
    return verified.filter(~F.col("verification.remove"))


def summary(verified: DataFrame) -> DataFrame:
    """One row: total, kept, removed, missing, and labels as a map; one aggregation of a few counters a task."""
    label = F.col("verification.label")
    counts = [F.count_if(label == name).alias(name) for name in LABELS]
    one = verified.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("verification.remove")).alias("kept"),
        F.count_if(F.col("verification.remove")).alias("removed"),
        F.count_if((F.col("nli.hypothesis") == "") | (F.col("nli.premise") == "")).alias("missing_premise_or_hypothesis"),
        *counts,
    )
    labels = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in LABELS)), lambda e: e["value"] > 0))
    return one.withColumn("labels", labels).drop(*LABELS)
