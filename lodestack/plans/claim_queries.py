"""Claims made from events: a template for each rule, and errors of 20 or more as detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.functions.text import rounded
from lodestack.operators import claims as C
from lodestack.plans.registry import query, table
from lodestack.schemas import DETECTIONS

#: One for each outcome of the rules.
TEMPLATES = (
    "Faulting offsets the reflectors.", "A possible fault disrupts continuity.", "No fault is visible.", "The section definitely shows a fault.",
    "Faults are definitely absent, no fault.", "The reflectors are continuous.",
)


def made_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, answer, detections): one claim for each user and day. An aggregation that combines before its one shuffle."""
    e = table(spark, sf_dir, "events")
    hit = (F.col("event_type") == "error") & (F.col("value") >= 20)
    box = F.when(F.col("event_id") % 2 == 0, F.array(*(F.col("value") * k for k in (0.5, 1.0, 1.5, 2.0))))
    point = F.array(F.col("value"), F.col("value") / 2)
    one = F.struct(
        F.col("event_id").alias("id"), F.lit("fault").alias("label"), rounded(F.col("value") / 1000, 4).alias("confidence"), box.alias("box_xyxy"),
        F.lit(None).cast("double").alias("mask_coverage"), F.when(F.col("event_id") % 3 == 0, F.array(point, point, point)).alias("polygon_xy_sample"),
    )
    by = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("event_id").alias("ids"), F.array_sort(F.collect_list(F.when(hit, one))).alias("found"))
    names = ("label", "confidence", "box_xyxy", "mask_coverage", "polygon_xy_sample")
    detections = F.transform("found", lambda d: F.struct(*(d[n].alias(n) for n in names))).cast(DETECTIONS)
    answer = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("ids") % len(TEMPLATES) + 1).cast("int"))
    return by.select("user_id", "day", answer.alias("answer"), detections.alias("detections"))


def verified_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.verify(made_claims(spark, sf_dir), "answer")


_LIST = ", ".join(f"'{t}'" for t in TEMPLATES)
_WORD = "(?:^|[^\\p{{L}}\\p{{N}}_])(?:{})(?:$|[^\\p{{L}}\\p{{N}}_])"


def _has(terms: str, of: str = "answer") -> str:
    return f"regexp_matches({of}, '(?i){_WORD.format(terms)}')"


CLAIMS = f"""
WITH e AS (
    SELECT *, event_type = 'error' AND value >= 20 AS hit FROM events
), c AS (
    SELECT user_id, ts::DATE AS day, [{_LIST}][(sum(event_id) % 6)::INT + 1] AS answer, count(*) FILTER (hit) AS n,
        coalesce(max(printf('%.4f', value / 1000)::DOUBLE) FILTER (hit), 0::DOUBLE) AS best,
        count(*) FILTER (hit AND event_id % 2 = 0) AS boxes, count(*) FILTER (hit AND event_id % 3 = 0) AS polygons
    FROM e GROUP BY ALL
), f AS (
    SELECT *, n > 0 AS pf, {_has(T.FAULT_TERMS)} AS cf, {_has(T.ABSENCE_TERMS)} AS ab, {_has(T.CERTAINTY_TERMS)} AS oc, {_has(T.UNCERTAINTY_TERMS)} AS h FROM c
), v AS (
    SELECT *, CASE WHEN NOT cf THEN 'UNCERTAIN' WHEN pf AND ab THEN 'CONTRADICT' WHEN pf AND oc THEN 'OVERCLAIM' WHEN pf THEN 'SUPPORT'
            WHEN ab AND oc THEN 'OVERCLAIM' WHEN ab THEN 'SUPPORT' ELSE 'UNCERTAIN' END AS label,
        CASE WHEN NOT cf THEN 0.55 WHEN pf AND ab THEN 0.80 WHEN pf AND oc THEN 0.70 WHEN pf AND h THEN 0.72 WHEN pf THEN 0.82
            WHEN ab AND oc THEN 0.76 WHEN ab THEN 0.62 ELSE 0.68 END::DOUBLE AS confidence,
        CASE WHEN n = 0 THEN 'Auxiliary detector produced no fault detections for this image. This absence is weak evidence only and does not prove faults are absent.'
            ELSE printf('Auxiliary detector produced %d fault detection(s), %d boxed region(s), and %d polygon overlay sample(s). The maximum detection confidence is %.3f.',
                n, boxes, polygons, best) END AS premise
    FROM f
)
"""


@query(CLAIMS + "SELECT label, confidence, n > 0 AS detected, count(*) AS claims FROM v GROUP BY ALL")
def q01_claim_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verified_claims(spark, sf_dir)
    by = v.groupBy(F.col("verification.label").alias("label"), F.col("verification.confidence").alias("confidence"), F.col("nli.variables.fault_present").alias("detected"))
    return by.agg(F.count(F.lit(1)).alias("claims"))


@query(CLAIMS + "SELECT user_id, day, answer AS hypothesis, label, confidence, label IN ('CONTRADICT', 'OVERCLAIM') AS remove FROM v")
def q02_verified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_claims(spark, sf_dir).select("user_id", "day", "nli.hypothesis", "verification.label", "verification.confidence", "verification.remove")


@query(CLAIMS + "SELECT user_id, day, label FROM v WHERE label NOT IN ('CONTRADICT', 'OVERCLAIM')")
def q03_kept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kept(verified_claims(spark, sf_dir)).select("user_id", "day", "verification.label")


@query(
    CLAIMS + """SELECT count(*) AS total, count(*) FILTER (label NOT IN ('CONTRADICT', 'OVERCLAIM')) AS kept, count(*) FILTER (label IN ('CONTRADICT', 'OVERCLAIM')) AS removed,
    count(*) FILTER (answer = '') AS missing, count(*) FILTER (label = 'SUPPORT') AS support, count(*) FILTER (label = 'CONTRADICT') AS contradict FROM v"""
)
def q04_verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.summary(verified_claims(spark, sf_dir))
    label = F.col("labels")
    return s.select(
        "total", "kept", "removed", F.col("missing_premise_or_hypothesis").alias("missing"), F.coalesce(F.try_element_at(label, F.lit("SUPPORT")), F.lit(0)).alias("support"),
        F.coalesce(F.try_element_at(label, F.lit("CONTRADICT")), F.lit(0)).alias("contradict"),
    )


@query(CLAIMS + "SELECT user_id, day, n > 0 AS fault_present, n AS detection_count, best AS max_confidence, boxes > 0 AS has_box_overlay, polygons > 0 AS has_polygon_overlay FROM v")
def q05_evidence_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_claims(spark, sf_dir).select("user_id", "day", C.evidence(F.col("detections")).alias("v")).select("user_id", "day", "v.*")


@query(CLAIMS + "SELECT user_id, day, premise FROM v")
def q06_premise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_claims(spark, sf_dir).select("user_id", "day", C.premise(F.col("detections")).alias("premise"))


_SPACES = "[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query(
    f"""WITH t AS (SELECT 'd' AS kind, doc_id AS id, 0 AS turn, text FROM documents UNION ALL SELECT 'c', conv_id, turn, text FROM conversations),
    n AS (SELECT kind, id, turn, trim(regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g'), ' ') AS t FROM t)
    SELECT kind, id, turn, CASE WHEN length(t) > 600 THEN regexp_replace(t[1:597], ' [^ ]*$', '') || '...' ELSE t END AS claim FROM n"""
)
def q07_normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"), "text")
    c = table(spark, sf_dir, "conversations").select(F.lit("c").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    return d.unionByName(c).select("kind", "id", "turn", T.normalized_claim(F.col("text")).alias("claim"))


@query(f"SELECT doc_id, {_has(T.FAULT_TERMS, 'text')} AS fault, {_has(T.ABSENCE_TERMS, 'text')} AS absence, {_has(T.CERTAINTY_TERMS, 'text')} AS certain, {_has(T.UNCERTAINTY_TERMS, 'text')} AS hedged FROM documents")
def q08_vocab_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    flags = {"fault": T.FAULT_TERMS, "absence": T.ABSENCE_TERMS, "certain": T.CERTAINTY_TERMS, "hedged": T.UNCERTAINTY_TERMS}
    return table(spark, sf_dir, "documents").select("doc_id", *(T.mentions(t, v).alias(k) for k, v in flags.items()))
