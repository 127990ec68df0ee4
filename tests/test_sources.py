import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions.text import path_order
from lodestack.operators import claims
from lodestack.sinks import files as sinks
from lodestack.sources import files as sources
from lodestack.sources import volumes
from lodestack.streaming import flows


def archive(path, array, method):
    data = io.BytesIO()
    np.save(data, array)
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr("seis.npy", data.getvalue())


def test_volumes(spark, tmp_path):
    array = np.arange(4 * 3 * 5, dtype=np.int16).reshape(4, 3, 5)
    np.save(tmp_path / "a.npy", array)
    archive(tmp_path / "b.npz", array, zipfile.ZIP_DEFLATED)
    archive(tmp_path / "c.npz", array, zipfile.ZIP_STORED)
    big = np.random.default_rng(1).random((6, 64, 64))
    archive(tmp_path / "whole.npz", big, zipfile.ZIP_DEFLATED)
    data = (tmp_path / "whole.npz").read_bytes()
    (tmp_path / "d.npz").write_bytes(data[: len(data) // 2])
    spark.dataSource.register(volumes.VolumeSource)
    rows = spark.read.format("volume").load(f"{tmp_path}/[abc].np?").collect()
    assert len(rows) == 12
    for r in rows:
        assert np.array_equal(np.array(r["values"]).reshape(r.height, r.width), array[r.slice_idx])
    assert spark.read.format("volume").option("maxSlices", 2).load(f"{tmp_path}/a.npy").count() == 2
    assert 0 < spark.read.format("volume").load(f"{tmp_path}/d.npz").count() < 6
    np.save(tmp_path / "two.npy", array[0])
    (tmp_path / "bad.npy").write_bytes(b"nothing at all")
    for name in ("two.npy", "bad.npy"):
        with pytest.raises(ValueError):
            list(volumes.slices(str(tmp_path / name)))


def read_volume(spark, path, **options):
    spark.dataSource.register(volumes.VolumeSource)
    frame = spark.read.format("volume").options(**options).load(path)
    rows = frame.collect()
    assert sorted(r.slice_idx for r in rows) == list(range(len(rows)))
    return frame, np.array([np.array(r["values"]).reshape(r.height, r.width) for r in sorted(rows, key=lambda r: r.slice_idx)])


def test_one_volume_feeds_many_tasks(spark, tmp_path):
    array = np.random.default_rng(3).random((23, 7, 11)).astype(np.float32)
    np.save(tmp_path / "a.npy", array)
    archive(tmp_path / "stored.npz", array, zipfile.ZIP_STORED)
    archive(tmp_path / "deflated.npz", array, zipfile.ZIP_DEFLATED)
    for name in ("a.npy", "stored.npz", "deflated.npz"):
        for split in (100, 308, 1000, 1 << 20):
            frame, got = read_volume(spark, f"{tmp_path}/{name}", splitBytes=split)
            assert np.array_equal(got, array)
            size = (tmp_path / name).stat().st_size
            assert frame.rdd.getNumPartitions() == -(-size // split)
            filled = frame.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
            assert name == "deflated.npz" or max(filled) <= -(-split // 308)
        assert np.array_equal(read_volume(spark, f"{tmp_path}/{name}", splitBytes=500, maxSlices=5)[1], array[:5])
    data = (tmp_path / "a.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(data[: 128 + 308 * 4 + 7])
    assert np.array_equal(read_volume(spark, f"{tmp_path}/cut.npy", splitBytes=700)[1], array[:4])


@pytest.mark.parametrize("gathered,chunk", [(64 << 20, 1 << 20), (700, 1 << 20), (700, 64)])
def test_column_major_volumes(tmp_path, monkeypatch, gathered, chunk):
    """The sections of the row-major copy, whatever is gathered at a time, by whole or strided reads."""
    monkeypatch.setattr(volumes, "GATHERED", gathered)
    monkeypatch.setattr(volumes, "CHUNK", chunk)
    array = np.random.default_rng(4).integers(0, 99, (60, 5, 7)).astype(np.int16)
    np.save(tmp_path / "c.npy", np.asfortranarray(array))
    archive(tmp_path / "c.npz", np.asfortranarray(array), zipfile.ZIP_DEFLATED)
    for name in ("c.npy", "c.npz"):
        path = str(tmp_path / name)
        got = list(volumes.slices(path))
        assert [k for k, _ in got] == list(range(60)) and all(np.array_equal(x, array[k]) for k, x in got)
        parts = [x for part in range(20) for x in volumes.slices(path, part=part, split=300)]
        assert [k for k, _ in parts] == list(range(60)) and all(np.array_equal(x, array[k]) for k, x in parts)
    data = (tmp_path / "c.npy").read_bytes()
    for n, whole in ((2, 59), (20, 50), (118, 1), (120, 0), (200, 0)):  # of the last column's bytes so many are missing
        (tmp_path / "cut.npy").write_bytes(data[:-n])
        got = list(volumes.slices(str(tmp_path / "cut.npy")))
        assert [k for k, _ in got] == list(range(whole)) and all(np.array_equal(x, array[k]) for k, x in got)


def test_column_major_volume_as_a_table(spark, tmp_path):
    array = np.random.default_rng(5).random((9, 4, 6)).astype(np.float32)
    np.save(tmp_path / "c.npy", np.asfortranarray(array))
    assert np.array_equal(read_volume(spark, f"{tmp_path}/c.npy", splitBytes=200)[1], array)


def test_masks(tmp_path):
    volume = np.zeros((3, 64, 64))
    volume[1, :32] = 2
    np.savez(tmp_path / "m.npz", other=np.zeros((2, 2)), fault=volume)
    mask = volumes.load_mask((tmp_path / "m.npz").read_bytes())
    assert mask.shape == (32, 32) and mask[:16].all() and not mask[16:].any()


def test_jsonl_round_trip(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"image": "é.png", "split": "train", "extra": 1}\n\n   \n{"image": null}\n')
    rows = sources.read_training_rows(spark, str(path), "image string, split string, error string")
    assert sorted(rows.collect(), key=str) == sorted([("é.png", "train", None), (None, None, None)], key=str)
    for _ in range(2):
        sinks.append_jsonl(rows, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 4
    sinks.write_jsonl(rows, f"{tmp_path}/out", keep_nulls=True)
    assert '"error":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"image": "a"}\n{broken\n')
    with pytest.raises(Exception):
        sources.read_jsonl(spark, str(bad), "image string").collect()
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        sources.read_training_rows(spark, str(tmp_path / "none.jsonl"), "image string")


def test_listings_and_checks(spark, tmp_path):
    for name in ("train/a/b/c.png", "train/a/b-x/c.PNG", "train/a/b.jpg", "train/a/n.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    got = [r.path.removeprefix(f"{tmp_path}/train/") for r in sources.list_split_images(spark, str(tmp_path), "train").collect()]
    assert got == ["a/b/c.png", "a/b-x/c.PNG", "a/b.jpg"]
    assert sources.list_files(spark, f"{tmp_path}/train/a", recursive=False).count() == 1
    with pytest.raises(Exception):
        sources.list_split_images(spark, str(tmp_path), "test").collect()
    images = sources.read_images(spark, str(tmp_path)).withColumn("name", F.element_at(path_order(F.col("path")), -1))
    wanted = spark.createDataFrame([("b.jpg", 14, "x"), ("zz", 1, "y")], "name string, size long, md5 string")
    assert [tuple(r) for r in sources.checked_files(images, wanted).orderBy("name").collect()] == [("b.jpg", 14, False), ("zz", 1, False)]


def test_manifest_and_splits(spark, tmp_path):
    pairs = spark.createDataFrame([("train", "10", "s10", "f10"), ("train", "9", "s9", "f9"), ("train", "1", None, "f"), ("val", "2", "a", "b")], "split string, id string, seis string, fault string")
    sinks.write_manifest(pairs, f"{tmp_path}/m", "train")
    assert [r.id for r in sources.read_manifest(spark, f"{tmp_path}/m").collect()] == ["9", "10"]
    sinks.write_splits(pairs, f"{tmp_path}/s")
    assert (tmp_path / "s" / "split=val").exists()
    assert "0: fault" in sinks.data_yaml("x")


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"answer": a, "image": f"{k}"}) for a in ("No fault is visible.", "Faulting.", "")))
    schema = "image string, answer string, detections " + __import__("lodestack.schemas", fromlist=["x"]).DETECTIONS
    stream = flows.read_jsonl_stream(spark, str(folder), schema)
    flows.verified_stream(stream, "answer", f"{tmp_path}/all", f"{tmp_path}/kept", f"{tmp_path}/cp").awaitTermination()
    batch = claims.verify(spark.read.schema(schema).json(str(folder)), "answer")
    got = spark.read.json(f"{tmp_path}/all")
    assert sorted(got.select("image", "verification.label").collect()) == sorted(batch.select("image", "verification.label").collect())
    assert spark.read.json(f"{tmp_path}/kept").count() == claims.kept(batch).count()


def test_late_events_are_left_out(spark, tmp_path):
    from datetime import datetime

    folder = f"{tmp_path}/ev"
    schema = "ts timestamp, event_type string, value double"
    for k, day in enumerate((10, 20, 1)):
        spark.createDataFrame([(datetime(2024, 1, day), "a", 1.0)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/*")
        query = (
            flows.windowed_counts(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/o")
            .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/o").collect()
    assert [r.start.day for r in out] == [10]
