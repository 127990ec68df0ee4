"""Sources, sinks and model boundaries that need files."""

import io
import json
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack import providers
from lodestack.operators import imaging as I
from lodestack.operators import pairing as P
from lodestack.operators import raster as G
from lodestack.schemas import DETECTIONS
from lodestack.sinks import files as sinks
from lodestack.sources import files as sources
from lodestack.sources import volumes


def test_overlay_above_and_below_the_threshold(spark):
    got = spark.range(1).select(I.overlaid(F.lit(100.0), F.lit(0.2), F.lit(255.0)).alias("low"), I.overlaid(F.lit(100.0), F.lit(1.0), F.lit(255.0)).alias("high"), I.grey(F.lit(0.999)).alias("g")).first()
    mask = 51 / 255 * 0.45
    assert got.low == int(100 * (1 - mask) + 255 * mask)
    assert got.high == int((100 * 0.55 + 255 * 0.45) * 0.65 + 255 * 0.35) and got.g == 254


def test_members_of_archives(spark, tmp_path):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as tar:
        for name, content in (("a/x.txt", b"one"), ("y.bin", b""), ("z", b"\0" * 70_000)):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
    (tmp_path / "train.tar.gz").write_bytes(data.getvalue())
    rows = sources.read_archive_members(spark, f"{tmp_path}/train.tar.gz").collect()
    assert [(r.member, r.size, bytes(r.content[:3])) for r in rows] == [("a/x.txt", 3, b"one"), ("y.bin", 0, b""), ("z", 70_000, b"\0\0\0")]


def test_masks_and_images_of_array_files(spark, tmp_path):
    volume = np.zeros((3, 64, 64))
    volume[1, :32] = 2
    np.savez(tmp_path / "m.npz", fault=volume)
    np.save(tmp_path / "i.npy", np.arange(24.0).reshape(1, 4, 2, 3))
    files = sources.read_images(spark, str(tmp_path), (".npz",))
    row = volumes.masks(files).first()
    assert sum(row["values"]) == 512 and row["values"][0] == 1 and row["values"][-1] == 0
    image = volumes.array_images(sources.read_images(spark, str(tmp_path))).filter("path like '%npy'").first()
    assert (image.height, image.width, image["values"]) == (4, 2, [float(v) for v in range(0, 24, 3)])


def test_pairs_of_volumes(spark, tmp_path):
    spark.dataSource.register(volumes.VolumeSource)
    a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    for name, x in (("s.npy", a), ("f.npy", a > 5), ("other.npy", a.reshape(2, 4, 3))):
        np.save(tmp_path / name, x)

    def read(name):
        return spark.read.format("volume").load(f"{tmp_path}/{name}").withColumn("id", F.lit("v")).drop("path")

    rows = volumes.paired_slices(read("s.npy"), read("f.npy")).orderBy("slice_idx").collect()
    assert [(r.id, r.slice_idx, r.seis[0], sum(r.fault)) for r in rows] == [("v", 0, 0.0, 6.0), ("v", 1, 12.0, 12.0)]
    with pytest.raises(Exception, match="differ in shape"):
        volumes.paired_slices(read("s.npy"), read("other.npy")).collect()
    assert volumes.listed(f"file://{tmp_path}/*.npy") == [f"file://{tmp_path}/{n}" for n in ("f.npy", "other.npy", "s.npy")]
    assert spark.read.format("volume").load(f"file://{tmp_path}/s.npy").count() == 2


def test_grey_images(spark, tmp_path):
    rows = spark.createDataFrame([("m", 2, 3, [0, 1, 2, 253, 254, 255])], "name string, height int, width int, values array<int>")
    written = sinks.write_grey_images(rows, f"{tmp_path}/out").collect()
    data = (tmp_path / "out" / "m.png").read_bytes()
    assert written[0].size == len(data) and data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (3, 2)
    begin = data.index(b"IDAT")
    (n,) = struct.unpack(">I", data[begin - 4 : begin])
    assert zlib.decompress(data[begin + 4 : begin + 4 + n]) == b"\0\0\1\2\0\xfd\xfe\xff"
    assert (tmp_path / "y").exists() is False and open(sinks.write_data_yaml(f"{tmp_path}/y")).read() == sinks.data_yaml(f"{tmp_path}/y")


def read_rows(path):
    return sorted((json.loads(line) for f in path.glob("part-*") for line in f.read_text().splitlines()), key=lambda r: r["image"])


def test_generated_rows_to_three_sinks(spark, tmp_path):
    images = spark.createDataFrame([(f"d/{k}", "train") for k in range(8)], "image string, split string").withColumn("detections", F.lit(None).cast(DETECTIONS))
    rows = providers.generate(images, lambda: providers.Stub(lambda p: p[-1] in "17"))
    sinks.write_generated(rows, str(tmp_path), "train", limit=4)
    ok, sft, bad = (read_rows(tmp_path / f"train{end}.jsonl") for end in ("", "_sft", "_errors"))
    assert [r["image"] for r in ok] == [r["image"] for r in sft] == ["d/0", "d/2", "d/3", "d/4"] and [r["image"] for r in bad] == ["d/1"]
    assert ok[0]["second_answer"] == providers.NO_SECOND_ANSWER and sft[0]["answer_source"] == providers.MERGED_ALONE
    assert sft[0]["messages"][1]["content"][0]["text"].endswith(ok[0]["merged_answer"])
    sinks.write_generated(rows, str(tmp_path), "all")
    assert [len(read_rows(tmp_path / f"all{end}.jsonl")) for end in ("", "_sft", "_errors")] == [6, 6, 2]
    with_second = providers.generate(images.filter("image = 'd/0'"), providers.Stub, providers.Stub).first()
    assert with_second.answer_source == providers.MERGED_WITH_SECOND and with_second.second_answer.startswith("A possible fault")


def test_overlay_splits(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "test")], "image string, split string")
    assert sinks.write_overlay_splits(rows, str(tmp_path), ["train", "val", "test"]) == {"train": 2, "val": 0, "test": 1}
    assert not (tmp_path / "val_sft.jsonl").exists() and len(read_rows(tmp_path / "train_sft.jsonl")) == 2


def test_detector_thresholds_and_failures(spark):
    class Two:
        def detect(self, image, confidence):
            if image == "bad":
                raise OSError("no image")
            return {"boxes": [[0.0, 0.0, 1.005, 1.0]] * 2, "scores": [0.25, 0.24999], "classes": [5, 5], "coverages": [], "outlines": []}

    images = spark.createDataFrame([("a",), ("bad",)], "image string")
    got = {r.image: r for r in providers.detected(images, Two).collect()}
    assert [(d.label, d.confidence, d.mask_coverage) for d in got["a"].detections] == [("fault", 0.25, None)]
    assert got["bad"].detections == [] and got["bad"].error == "OSError: no image"
    assert providers.detected(images, None).select("detections").first().detections == []
    some = F.array(*(F.struct(F.lit(c).alias("confidence")) for c in (0.1, 0.3)))
    assert [d.confidence for d in images.limit(1).select(G.confident(some, 0.2).alias("d")).first().d] == [0.3]


def test_labels_of_records(spark):
    rows = spark.createDataFrame([(1, "d/images/t/a.png", None, "m.npy"), (2, "d/images/t/b.png", "", None), (3, "x.png", "gone.npy", None)], "row_id int, image string, mask_path string, yolo_label_path string")
    listing = spark.createDataFrame([("d/images/t/m.npy",), ("d/labels/t/b.txt",)], "path string")
    assert {r.row_id: r.label_path for r in P.real_labels(rows, listing).collect()} == {1: "d/images/t/m.npy", 2: "d/labels/t/b.txt", 3: None}


def test_targets_are_made_once(spark):
    """The fields of a training row share one target, and cells are told apart as numbers: structs would all be compared with each other."""
    from lodestack.plans.record_queries import _labels, _records
    from lodestack.operators import raster, records

    sf = "/root/testdata/sf0.001"
    labels = _labels(spark, sf)
    rows = records.training_rows(_records(spark, sf), labels.select("path"), labels, allow_pseudo=True)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    alone = plan(rows.select("mask")).count("array_sort")
    assert alone and plan(rows).count("array_sort") == alone
    box = lambda *b: F.struct(F.lit("f").alias("label"), F.lit(0.5).alias("confidence"), F.array(*(F.lit(float(v)) for v in b)).alias("box_xyxy"), F.lit(None).cast("array<array<double>>").alias("polygon_xy_sample"))
    cells = raster.detection_cells(F.array(box(0, 0, 2, 1), box(1, 0, 3, 1)), F.lit(31.0), F.lit(31.0))
    made = spark.range(1).select(cells.alias("c"))
    assert [tuple(c) for c in made.first().c] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (0, 3), (1, 3)]
