"""The corpus operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import fold, read_table
from lodestack.llm.exact_dedup import exact_dedup
from lodestack.llm.hard_negatives import hard_negatives
from lodestack.llm.html_main_text import main_text
from lodestack.llm.licenses import PASSAGES, scan_passages
from lodestack.llm.line_dedup import kept_lines, line_bitmaps
from lodestack.llm.mixing import mix
from lodestack.llm.quality_rules import fit_quality, score_quality
from lodestack.llm.quote_linking import reply_order
from lodestack.llm.sentencepiece_unigram import encode_documents, load_vocabulary
from lodestack.llm.simhash import document_fingerprints
from lodestack.llm.simhash_dedup import near_dedup
from lodestack.llm.token_alignment import align_tokenizers
from lodestack.llm.toxicity import fit_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Documents that score this or more are of good quality.
QUALITY_CUT = 0.3
#: Documents that score this or more are toxic.
TOXIC_CUT = 0.7


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 3) != 1)
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_CUT).cast("int").alias("predicted"),
    )


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also near_rows: how many other rows are within three bits of those whose doc_id is divisible by 100."""
    return document_fingerprints(read_table(spark, sf_dir, "documents"), search=F.col("doc_id") % 100 == 0)


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


@query
def op4_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(read_table(spark, sf_dir, "conversations"))


@query
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"))


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices and whole license texts wherever they stand, one license a passage."""
    found = scan_passages(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.col("n_passages").alias("n_matches"), F.round("best_dice", 6).alias("best_dice"))


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_ids of every document, and whether decoding them gives the text back."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_documents(docs, load_vocabulary(), check=True)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "round_trip", "decoded_sha256", "token_ids")


@query
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"),
    )


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).drop("hash128")


@query
def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(read_table(spark, sf_dir, "documents"))


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return kept_lines(docs, line_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose vec_id is divisible by 7 are moved on by one; anchors are the rows whose vec_id is divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 100 == 0)


ORACLE_SQL["op10_exact_dedup"] = """
WITH d AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
    SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""

ORACLE_SQL["op12_line_dedup"] = """
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), k AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), common AS (
    SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
    SELECT doc_id, line, place, largest IS NOT NULL AND largest != doc_id AS gone FROM k LEFT JOIN common USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLE_SQL["op13_hard_negatives"] = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

_FORMS = ",\n".join("('{}', '{}')".format(name, form.replace("'", "''")) for name, forms in PASSAGES.items() for form in forms)
_WORDS = """string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"""
ORACLE_SQL["op6_licenses"] = f"""
WITH RECURSIVE forms(license, form) AS (VALUES {_FORMS}
), f AS (
    SELECT row_number() OVER () AS tid, license, {_WORDS.format("form")} AS w FROM forms
), g AS (
    SELECT tid, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams, len(w) - 1 AS n FROM f
), t AS (
    SELECT *, len(grams) AS size, greatest(1, ceil(len(grams) * 0.8::DOUBLE / 1.2::DOUBLE - 1e-9::DOUBLE))::INT AS low, floor(n * 1.2::DOUBLE / 0.8::DOUBLE + 1e-9::DOUBLE)::INT AS high FROM g
), tg AS (
    SELECT tid, unnest(grams) AS g FROM t
), d AS (
    SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), p AS (
    SELECT doc_id, pos, w[pos] || ' ' || w[pos + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS pos FROM d)
), met AS (
    SELECT doc_id, tid FROM p JOIN tg USING (g) JOIN t USING (tid) GROUP BY doc_id, tid, low HAVING count(DISTINCT g) >= low
), h AS (
    SELECT doc_id, tid, pos FROM met JOIN p USING (doc_id) SEMI JOIN tg USING (tid, g)
), c AS (
    SELECT doc_id, tid, a.pos AS low_at, b.pos AS high_at FROM h a JOIN h b USING (doc_id, tid) JOIN t USING (tid) WHERE b.pos - a.pos + 1 BETWEEN low AND high
), m AS (
    SELECT c.doc_id, c.tid, low_at, high_at, 2.0::DOUBLE * count(DISTINCT tg.g) / (count(DISTINCT p.g) + size) AS dice
    FROM c JOIN p ON p.doc_id = c.doc_id AND p.pos BETWEEN low_at AND high_at JOIN t ON t.tid = c.tid LEFT JOIN tg ON tg.tid = c.tid AND tg.g = p.g
    GROUP BY c.doc_id, c.tid, low_at, high_at, size
), best AS (
    SELECT doc_id, license, low_at, high_at, dice FROM m JOIN t USING (tid) WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, tid, low_at ORDER BY dice DESC, high_at) = 1
), r AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, high_at - low_at DESC, low_at, license, high_at) AS k FROM best
), taken AS (
    SELECT doc_id, 1 AS k, [{{'license': license, 'low_at': low_at, 'high_at': high_at, 'dice': dice}}] AS own FROM r WHERE k = 1
    UNION ALL
    SELECT r.doc_id, r.k, CASE WHEN len(list_filter(own, lambda o: o.low_at <= r.high_at + 1 AND r.low_at <= o.high_at + 1)) = 0
        THEN list_append(own, {{'license': license, 'low_at': low_at, 'high_at': high_at, 'dice': dice}}) ELSE own END
    FROM taken JOIN r ON r.doc_id = taken.doc_id AND r.k = taken.k + 1
), found AS (
    SELECT doc_id, own FROM taken QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1
)
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(own, lambda o: o.license))), ','), '') AS licenses, coalesce(len(own), 0) AS n_matches,
    round(coalesce(list_max(list_transform(own, lambda o: o.dice)), 0::DOUBLE), 6) AS best_dice
FROM documents LEFT JOIN found USING (doc_id)
"""

_LEVEL = "len(regexp_replace(regexp_extract(line, '^((?:[ \\t]*>)+)', 1), '[^>]', '', 'g'))"
_BARE = "'(?m)^[^\\n]*(?:wrote|schrieb|écrit|escribió)[ \\t]*:[ \\t]*\\n([ \\t]*>)', '\\1', 'g'"
ORACLE_SQL["op4_quote_linking"] = f"""
WITH RECURSIVE m AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS raw, string_split(regexp_replace(coalesce(text, ''), {_BARE}), chr(10)) AS lines FROM conversations
), l AS (
    SELECT conv_id, turn, line, {_LEVEL} AS level,
        lower(trim(regexp_replace(regexp_replace(line, '^((?:[ \\t]*>)+)', ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS norm
    FROM (SELECT conv_id, turn, unnest(lines) AS line FROM m)
), found AS (
    SELECT q.conv_id, q.turn, q.level, (SELECT max(o.turn) FROM l o WHERE o.conv_id = q.conv_id AND o.level = 0 AND o.norm = q.norm AND o.turn < q.turn) AS parent
    FROM l q WHERE q.level > 0 AND q.norm != ''
), votes AS (
    SELECT conv_id, turn, level, parent, count(*) AS lines FROM found WHERE parent IS NOT NULL GROUP BY ALL
), best AS (
    SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, lines DESC, parent DESC) = 1
), t AS (
    SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT DISTINCT conv_id, turn FROM m)
), r AS (
    SELECT t.conv_id, t.turn, coalesce(parent, previous) AS reply_to, parent IS NOT NULL AS linked, coalesce(lines, 0) AS quoted_lines FROM t LEFT JOIN best USING (conv_id, turn)
), tree AS (
    SELECT conv_id, turn, turn AS root, 0 AS depth FROM r WHERE reply_to IS NULL
    UNION ALL SELECT r.conv_id, r.turn, tree.root, tree.depth + 1 FROM tree JOIN r ON r.conv_id = tree.conv_id AND r.reply_to = tree.turn
)
SELECT m.conv_id, m.turn, role,
    regexp_replace(array_to_string(list_filter(lines, lambda line: {_LEVEL} = 0), chr(10)), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS text,
    reply_to, linked, quoted_lines, root, depth, row_number() OVER (PARTITION BY m.conv_id ORDER BY root, m.turn, role, raw) AS position
FROM m JOIN r USING (conv_id, turn) JOIN tree USING (conv_id, turn)
"""
