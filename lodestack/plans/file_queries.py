"""Files, pairs, lookups, paths and catalogues, made from the tables' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import pairing as P
from lodestack.operators import records as R
from lodestack.plans.registry import query, table
from lodestack.sources.files import checked_files

NAMES = """
WITH p AS (
    SELECT p_partkey AS pos, (p_partkey % 400) AS k, CASE WHEN p_size % 2 = 0 THEN 'seismic' ELSE 'Fault_' END || ['Train', 'test', 'val', 'other'][(p_partkey % 4)::INT + 1]
        || '-' || (p_partkey % 400) || CASE WHEN p_size % 3 = 0 THEN '.npz' WHEN p_size % 7 = 0 THEN '.txt' ELSE '.npy' END AS name FROM part
), f AS (
    SELECT pos, name, CASE WHEN name NOT LIKE '%.txt' THEN CASE WHEN lower(name) LIKE 'seis%' THEN 'seis' ELSE 'fault' END END AS kind,
        regexp_replace(regexp_replace(regexp_replace(lower(name), '[.]np.$', ''), '^(seis(mic)?|faults?)[_\\-\\s]*', ''), '[^a-z0-9]', '', 'g') AS key FROM p
), best AS (
    SELECT kind, key, name, min(pos) OVER (PARTITION BY kind, key) AS first_pos FROM f WHERE kind IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY name LIKE '%.npy', pos) = 1
)
"""


def made_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(F.col("p_size") % 2 == 0, "seismic").otherwise("Fault_")
    split = F.element_at(F.array(*map(F.lit, ("Train", "test", "val", "other"))), (k % 4 + 1).cast("int"))
    end = F.when(F.col("p_size") % 3 == 0, ".npz").when(F.col("p_size") % 7 == 0, ".txt").otherwise(".npy")
    name = F.concat(kind, split, F.lit("-"), (k % 400).cast("string"), end)
    return table(spark, sf_dir, "part").select(k.alias("pos"), name.alias("name"))


@query(NAMES + "SELECT kind, key, name, first_pos FROM best")
def q13_best_file_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.best_files(made_names(spark, sf_dir)).select("kind", "key", "name", "first_pos")


@query(
    NAMES + """, n AS (SELECT *, regexp_extract(key, '[0-9]+') AS id, CASE WHEN key LIKE '%train%' THEN 'train' WHEN key LIKE '%test%' THEN 'test' WHEN key LIKE '%val%' THEN 'val' END AS split FROM best)
    SELECT split, id, max_by(name, first_pos) FILTER (kind = 'seis') AS seis, max_by(name, first_pos) FILTER (kind = 'fault') AS fault FROM n WHERE id != '' AND split IS NOT NULL
    GROUP BY split, id HAVING seis IS NOT NULL AND fault IS NOT NULL"""
)
def q14_pair_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair_manifest(P.best_files(made_names(spark, sf_dir)))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q15_semi_join_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_label(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q16_missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.without(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    """SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS "real", count(*) FILTER (l.doc_id IS NULL AND lang = 'en') AS pseudo, count(*) FILTER (l.doc_id IS NULL AND lang != 'en') AS missing
    FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def q17_label_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents stand for records that have detections."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit("there").alias("path"))
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    pseudo = F.when(F.col("lang") == "en", F.array())
    return R.label_source_counts(joined.withColumn("label_source", R.label_source(F.col("path"), pseudo, allow_pseudo=True)))


@query(
    """WITH c AS (SELECT page_id, ['/masks/' || page_id || '.npy', '/labels/' || page_id || '.txt', '/labels/' || page_id // 2 || '.txt'] AS paths FROM pages),
    l AS (SELECT '/labels/' || doc_id || '.txt' AS path FROM labels)
    SELECT page_id, (SELECT p FROM (SELECT unnest(paths) AS p, unnest(range(3)) AS k) x WHERE p IN (SELECT path FROM l) ORDER BY k LIMIT 1) AS label_path FROM c"""
)
def q18_priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = table(spark, sf_dir, "labels").select(F.concat(F.lit("/labels/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    k = F.col("row_id")

    def path(folder: str, n: object, end: str) -> object:
        return F.concat(F.lit(folder), n.cast("string"), F.lit(end))

    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("row_id"))
    found = P.first_existing(rows, [path("/masks/", k, ".npy"), path("/labels/", k, ".txt"), path("/labels/", F.expr("row_id div 2"), ".txt")], listing, "label_path")
    return found.select(F.col("row_id").alias("page_id"), "label_path")


@query(
    """SELECT regexp_extract(url, '://([^/]*)', 1) || '-' || page_id || '.tar.gz' AS name, length(html) AS size, md5(html) AS md5, url,
    ['train', 'validation', 'test'][(page_id % 3)::INT + 1] AS split FROM pages"""
)
def q19_catalog_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page stands for an archive, with its address and checksum as a catalogue gives them."""
    p = table(spark, sf_dir, "pages")
    name = F.concat(F.regexp_extract("url", "://([^/]*)", 1), F.lit("-"), F.col("page_id").cast("string"), F.lit(".tar.gz"))
    links = F.struct(F.lit("").alias("self"), F.col("url").alias("download"))
    made = F.struct(name.alias("key"), F.length("html").cast("bigint").alias("size"), F.concat(F.lit("md5:"), F.md5("html")).alias("checksum"), links.alias("links"))
    files = P.catalog_files(p.select(F.array(made).alias("files")))
    number = F.regexp_extract("name", r"-(\d+)\.tar\.gz$", 1).cast("int")
    split = F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))), number % 3 + 1)
    return files.withColumn("split", split)


@query(
    """WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts FROM pages)
    SELECT page_id, array_to_string(parts, '/') AS path, parts[-1] AS name, row_number() OVER (ORDER BY parts, page_id) AS place FROM p QUALIFY place <= 50"""
)
def q20_path_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 paths in order of their parts."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    first = p.orderBy(T.path_order(F.col("path")), "page_id").limit(50)
    order = F.row_number().over(Window.orderBy(T.path_order(F.col("path")), "page_id"))
    return first.select("page_id", "path", F.element_at(T.path_order(F.col("path")), -1).alias("name"), order.alias("place"))


@query(
    """WITH w AS (SELECT doc_id AS name, strlen(text) + (doc_id % 7 = 0)::INT AS size, CASE WHEN doc_id % 5 = 0 THEN md5(text || '.') ELSE md5(text) END AS md5 FROM documents),
    f AS (SELECT doc_id AS name, strlen(text) AS found, md5(text) AS digest FROM documents WHERE doc_id % 3 != 0)
    SELECT name, size, coalesce(size = found AND md5 = digest, false) AS ok FROM w LEFT JOIN f USING (name)"""
)
def q35_md5_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as downloads: every third is missing; every fifth has another checksum in the catalogue, every seventh another size."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    k = F.col("doc_id")
    other = F.md5(F.concat("content", F.lit(b".")))
    wanted = d.select(
        k.alias("name"), (F.length("content") + (k % 7 == 0).cast("int")).cast("bigint").alias("size"), F.when(k % 5 == 0, other).otherwise(F.md5("content")).alias("md5")
    )
    return checked_files(d.filter(k % 3 != 0).select(k.alias("name"), "content"), wanted)


@query(
    """WITH s AS (SELECT doc_id, (n_chars * n_chars * (doc_id % 7) * (doc_id % 5) * 1000 + n_chars)::DOUBLE AS n FROM documents)
    SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576)
        WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824) ELSE printf('%.1f TB', n / 1099511627776) END AS size FROM s"""
)
def q36_human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 7) * (F.col("doc_id") % 5) * 1000 + F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", T.human_bytes(n).alias("size"))


@query("SELECT event_id, json_keys(props)[1] AS key, (props ->> '$.k')::BIGINT AS k, json_array_length(json_keys(props)::JSON) AS n FROM events")
def q37_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.parsed_object(F.col("props"))
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", F.get(keys, F.lit(0)).alias("key"), F.try_variant_get(v, "$.k", "bigint").alias("k"), F.size(keys).cast("bigint").alias("n"))


@query(
    """SELECT split, place, doc_id, lang FROM (
        SELECT 'train' AS split, 0 AS place, doc_id, lang FROM documents WHERE n_chars < 500
        UNION ALL SELECT 'validation', 1, doc_id, lang FROM documents WHERE lang = 'en'
        UNION ALL SELECT 'test', 2, doc_id, lang FROM documents WHERE source IN ('src1', 'src2'))"""
)
def q38_split_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits from inputs of their own (a document may be in several), one after the other."""
    d = table(spark, sf_dir, "documents")
    splits = {"train": d.filter("n_chars < 500"), "validation": d.filter("lang = 'en'"), "test": d.filter("source in ('src1', 'src2')")}
    return P.union_of_splits({k: v.select("doc_id", "lang") for k, v in splits.items()}).select("split", F.col("split_place").alias("place"), "doc_id", "lang")
