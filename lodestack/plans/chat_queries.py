"""Replies, records and batches made from conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import learning as L
from lodestack.operators import records as R
from lodestack.plans.registry import query, table

_PLAIN = "regexp_replace(text, '[^\\p{L}\\p{N} ]+', ' ', 'g')"


@query(
    f"""WITH t AS (SELECT conv_id, turn, conv_id % 4 AS kind, trim(regexp_replace({_PLAIN}, ' +', ' ', 'g')) AS t FROM conversations)
    SELECT conv_id, turn, CASE kind WHEN 0 THEN 'step' WHEN 1 THEN 'one|two' WHEN 2 THEN 'a' ELSE '' END AS reasoning, t AS answer FROM t"""
)
def q09_split_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a JSON object, as lines with a final answer, as a list, or plain."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"[^\p{L}\p{N} ]+", " "), " +", " "))
    kind = F.col("conv_id") % 4
    shown = (
        F.when(kind == 0, F.concat(F.lit('note {"reasoning": ["step", ""], "final_answer": "'), plain, F.lit('"} end')))
        .when(kind == 1, F.concat(F.lit('- one\n"two"\nFinal answer: "'), plain, F.lit('"')))
        .when(kind == 2, F.concat(F.lit('["a", "'), plain, F.lit('"]')))
        .otherwise(plain)
    )
    got = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.split_reasoning(shown).alias("s"))
    return got.select("conv_id", "turn", F.array_join("s.reasoning", "|").alias("reasoning"), "s.answer")


@query(
    """SELECT conv_id, turn, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) != ''), lambda x: regexp_replace(trim(x), '[.]+$', '')), '. ')
        || '. ' || role AS paragraph FROM conversations WHERE trim(text) != ''"""
)
def q10_format_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter(F.trim("text") != "")
    return c.select("conv_id", "turn", T.joined_reasoning(F.split("text", "\n"), F.col("role")).alias("paragraph"))


@query(
    """SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS outline, md5(string_agg(text, chr(30) ORDER BY turn)) AS texts_md5, count(*) AS n FROM conversations GROUP BY conv_id"""
)
def q11_chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.conversations(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    texts = F.transform("messages", lambda m: m["content"][0]["text"])
    outline = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"][0]["text"])))
    return c.select("conv_id", F.array_join(outline, "|").alias("outline"), F.md5(F.array_join(texts, "\x1e")).alias("texts_md5"), F.size("messages").cast("bigint").alias("n"))


@query(
    f"""SELECT conv_id, coalesce(trim(min_by(text, turn) FILTER (role = 'user'), ' ' || chr(9) || chr(10) || chr(13)), '{T.DEFAULT_QUESTION}') AS question,
    coalesce(min_by(text, turn) FILTER (role = 'assistant'), '') AS answer FROM conversations GROUP BY conv_id"""
)
def q12_first_question_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.conversations(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    m = F.col("messages")
    return c.select("conv_id", R.question_text(F.lit(None).cast("string"), m).alias("question"), R.assistant_text(m).alias("answer"))


@query(
    """WITH t AS (SELECT conv_id, turn, conv_id % 10 AS batch, list_transform(string_split(text, ''), lambda x: unicode(x)) AS ids FROM conversations WHERE text != ''),
    p AS (SELECT conv_id, turn, batch, ids[1:12] AS prompt, ids[13:] AS answer FROM t WHERE len(ids[13:]) > 0),
    k AS (SELECT conv_id, turn, batch, answer[1:23] AS a, prompt FROM p),
    r AS (SELECT conv_id, turn, batch, a, list_slice(prompt, greatest(len(prompt) - (24 - len(a)) + 1, 1), len(prompt)) AS tail FROM k),
    z AS (SELECT *, max(len(tail) + len(a)) OVER (PARTITION BY batch) AS most FROM r)
    SELECT conv_id, turn, array_to_string(list_concat(tail, a, list_transform(range(most - len(tail) - len(a)), lambda i: 0)), ',') AS ids,
        array_to_string(list_concat(list_transform(tail, lambda i: -100), a, list_transform(range(most - len(tail) - len(a)), lambda i: -100)), ',') AS labels,
        len(tail) + len(a) AS attended FROM z"""
)
def q30_batch_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points as token ids: twelve of prompt, the rest answer, 24 in all at most, in ten batches. Rows without an answer are refused by token_rows()."""
    ids = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), _code)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 10).alias("batch"), F.coalesce(ids, F.array().cast("array<int>")).alias("all"))
    c = c.select("conv_id", "turn", "batch", F.slice("all", 1, 12).alias("prompt_ids"), F.slice(F.col("all"), F.lit(13), F.size("all")).alias("answer_ids"))
    out = L.padded(L.token_rows(c, most=24).filter("error is null"))

    def joined(name: str) -> Column:
        return F.array_join(F.transform(name, lambda v: v.cast("string")), ",").alias(name)

    attended = F.aggregate("mask", F.lit(0), lambda a, v: a + v).cast("bigint").alias("attended")
    return out.select("conv_id", "turn", joined("ids"), joined("labels"), attended)


def _code(c: Column) -> Column:
    """Code point of a one-character text."""
    return F.ascii(c)
