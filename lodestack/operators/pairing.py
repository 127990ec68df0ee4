"""Files of volumes: kinds, the best file of each key, pairs, manifests, and lookups on listings."""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import file_name, stem, suffix
from lodestack.operators.records import LABEL_FIELDS

#: Suffixes of images and volumes.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".npy")
VOLUME_SUFFIXES = (".npz", ".npy")


def has_suffix(path: Column, suffixes: Sequence[str]) -> Column:
    return F.lower(suffix(path)).isin(*suffixes)


def file_kind(name: Column) -> Column:
    """seis, fault or null: by suffix and by how the name begins."""
    low = F.lower(stem(name))
    kind = F.when(low.startswith("seis"), "seis").when(low.startswith("fault"), "fault")
    return F.when(has_suffix(name, VOLUME_SUFFIXES), kind)


def file_key(name: Column) -> Column:
    """What is left of a name without its kind: lower-case letters and digits; null without a kind."""
    low = F.regexp_replace(F.lower(stem(name)), r"^(?:seis(?:mic)?|faults?)[_\-\s]*", "")
    return F.when(file_kind(name).isNotNull(), F.regexp_replace(low, "[^a-z0-9]", ""))


def best_files(files: DataFrame, name: str = "name", position: str = "pos") -> DataFrame:
    """One file of each (kind, key): .npz before .npy, then the first by position; `first_pos` is where the key first came.

    An aggregation with map-side combine, not a window: a key with many files costs one row a task.
    """
    kinds = files.withColumn("kind", file_kind(F.col(name))).withColumn("key", file_key(F.col(name))).filter("kind is not null")
    rank = F.struct((F.lower(suffix(F.col(name))) != ".npz").alias("npy"), F.col(position).alias("pos"))
    return kinds.groupBy("kind", "key").agg(F.min_by(name, rank).alias(name), F.min(position).alias("first_pos"))


def split_of_key(key: Column) -> Column:
    return F.when(key.contains("train"), "train").when(key.contains("test"), "test").when(key.contains("val"), "val")


def pair_manifest(best: DataFrame, name: str = "name") -> DataFrame:
    """(split, id, seis, fault) of numbers that have both files; of several keys with one number the last by position counts."""
    numbered = best.withColumn("id", F.regexp_extract("key", r"\d+", 0)).withColumn("split", split_of_key(F.col("key")))
    usable = numbered.filter("id != '' and split is not null")
    sides = [F.max_by(F.when(F.col("kind") == side, F.col(name)), F.when(F.col("kind") == side, F.col("first_pos"))).alias(side) for side in ("seis", "fault")]
    return usable.groupBy("split", "id").agg(*sides).filter("seis is not null and fault is not null")


def with_label(images: DataFrame, labels: DataFrame, on: Sequence[str] = ("split", "stem")) -> DataFrame:
    """Images that have a label file."""
    return images.join(labels.select(*on), list(on), "left_semi")


def without(wanted: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """What is wanted and not there: files to fetch, weights that miss."""
    return wanted.join(present.select(*on), list(on), "left_anti")


def first_existing(rows: DataFrame, candidates: Sequence[Column], listing: DataFrame, into: str, path: str = "path", or_first: bool = False) -> DataFrame:
    """rows with `into`: the first of candidate paths that the listing has, or null; with or_first, else the first that is not null.

    Candidates become rows with their rank and meet the listing by an equality, so its size does not matter; ranks are then reduced per row
    by an aggregation that combines before it shuffles. rows need a unique column `row_id`.
    """
    ranked = rows.select("row_id", F.posexplode(F.array(*candidates)).alias("_rank", "_path")).filter("_path is not null and _path != ''")
    there = listing.select(F.col(path).alias("_path")).distinct()
    found = ranked.join(there, "_path", "left_semi").groupBy("row_id").agg(F.min_by("_path", "_rank").alias(into))
    joined = rows.join(found, "row_id", "left")
    return joined.withColumn(into, F.coalesce(F.col(into), *candidates)) if or_first else joined


def sibling(image: Column, path: Column) -> Column:
    """path beside image, unless it is absolute."""
    folder = F.regexp_replace(image, "/?[^/]*$", "")
    return F.when(path.startswith("/") | (folder == ""), path).otherwise(F.concat(folder, F.lit("/"), path))


def beside_dataset(dataset: Column, path: Column) -> Column:
    """path relative to the folder that holds the dataset's folder; the second candidate after path itself."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(dataset, "/?[^/]*/*$", ""), F.lit("/"), path))


def real_labels(rows: DataFrame, listing: DataFrame, image: str = "image", fields: Sequence[str] = LABEL_FIELDS, into: str = "label_path") -> DataFrame:
    """rows with the label file of each record: the first of its label fields that names a listed file, as given or beside the image, else the file derived from the image's path.

    rows need a unique column row_id.
    """
    own = [F.nullif(F.col(f), F.lit("")) for f in fields if f in rows.columns]
    candidates = [c for f in own for c in (f, sibling(F.col(image), f))] + [label_of_image(F.col(image))]
    return first_existing(rows, candidates, listing, into)


def label_of_image(image: Column) -> Column:
    """The label file of an image: its last folder `images` becomes `labels`, its suffix .txt; null without such a folder."""
    parts = F.split(image, "/")
    back = F.array_position(F.reverse(parts), F.lit("images"))
    at = F.size(parts) - back + 1
    moved = F.concat(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0))), F.array(F.lit("labels")), F.slice(parts, at + 1, F.size(parts)))
    return F.when(back > 0, F.concat(F.regexp_replace(F.array_join(moved, "/"), r"(?<=[^./])\.[^./]+$", ""), F.lit(".txt")))


def label_path(root: Column, split: Column, image: Column) -> Column:
    return F.concat_ws("/", root, F.lit("labels"), split, F.concat(stem(image), F.lit(".txt")))


def slice_name(volume: Column, index: Column) -> Column:
    return F.concat(volume, F.lit("_"), F.lpad(index.cast("string"), F.greatest(F.lit(3), F.length(index.cast("string"))), F.lit("0")))


def catalog_files(catalog: DataFrame) -> DataFrame:
    """(name, size, md5, url) of an archive catalogue, by name."""
    f = F.explode("files").alias("f")
    return catalog.select(f).select(
        F.col("f.key").alias("name"), F.col("f.size").cast("bigint").alias("size"), F.regexp_replace("f.checksum", "^md5:", "").alias("md5"),
        F.coalesce(F.nullif("f.links.self", F.lit("")), "f.links.download").alias("url"),
    ).orderBy("name")


def repository_files(catalog: DataFrame) -> DataFrame:
    """(id, name, size, restricted) of a repository catalogue; the label names a file, else its own name."""
    f = F.explode("data.latestVersion.files").alias("f")
    return catalog.select(f).select(
        F.col("f.dataFile.id").alias("id"), F.coalesce(F.nullif("f.label", F.lit("")), "f.dataFile.filename").alias("name"),
        F.coalesce("f.dataFile.filesize", F.lit(0)).alias("size"), F.coalesce("f.restricted", F.lit(False)).alias("restricted"),
    )


#: The archives of the image dataset, one for each split.
ARCHIVES = ("train.tar.gz", "validation.tar.gz", "test.tar.gz")


def selected_archives(files: DataFrame, splits: Sequence[str] = ("all",), name: str = "name") -> DataFrame:
    """The dataset's archives of the wanted splits; `all` among them wants every one."""
    wanted = [a for a in ARCHIVES if "all" in splits or a.removesuffix(".tar.gz") in splits]
    return files.filter(F.col(name).isin(*wanted))


def union_of_splits(splits: Mapping[str, DataFrame]) -> DataFrame:
    """The rows of several splits with `split` and `split_place`, the place of the split in the order given; order by it where the order matters. Columns that a split lacks are null.

    No shuffle: each split is read by its own plan, with its own pushed filters.
    """
    parts = [rows.withColumn("split", F.lit(name)).withColumn("split_place", F.lit(k)) for k, (name, rows) in enumerate(splits.items())]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def folders_with(listing: DataFrame, names: Sequence[str], path: str = "path", every: bool = False) -> DataFrame:
    """(folder, complete): whether a folder holds any of the files, or with `every` all; names may lie deeper (adapter/model.bin). One aggregation of a few flags."""
    found = [F.col(path).endswith("/" + n) for n in names]
    folder = F.coalesce(*(F.when(hit, F.regexp_replace(path, "/" + re.escape(n) + "$", "")) for n, hit in zip(names, found)), F.regexp_replace(path, "/[^/]*$", ""))
    flags = [F.bool_or(hit).alias(f"_{k}") for k, hit in enumerate(found)]
    joined = " and " if every else " or "
    return listing.groupBy(folder.alias("folder")).agg(*flags).select("folder", F.expr(joined.join(f"_{k}" for k in range(len(names)))).alias("complete"))


def rows_per_split(rows: DataFrame, splits: Sequence[str], split: str = "split") -> DataFrame:
    """(split, n) for each wanted split, 0 where it has no rows; one aggregation with a counter for each."""
    counts = rows.agg(*(F.count_if(F.col(split) == s).alias(s) for s in splits))
    named = F.explode(F.array(*(F.struct(F.lit(s).alias("split"), F.col(s).alias("n")) for s in splits)))
    return counts.select(named.alias("c")).select("c.split", "c.n")


def weights_complete(index: DataFrame | None, listing: DataFrame) -> DataFrame:
    """One row, `complete`: every file of the index (columns weight_map) is listed, and it names some; without an index any weight file will do."""
    if index is None:
        return listing.agg(F.coalesce(F.bool_or(F.lower(suffix(F.col("path"))).isin(".bin", ".safetensors")), F.lit(False)).alias("complete"))
    wanted = index.select(F.explode(F.map_values("weight_map")).alias("name")).distinct()
    there = listing.select(file_name(F.col("path")).alias("name"), F.lit(1).alias("there")).distinct()
    return wanted.join(there, "name", "left").agg(((F.count(F.lit(1)) > 0) & (F.count_if(F.col("there").isNull()) == 0)).alias("complete"))
