"""Sections with labels, image files, rounds of model calls, and streams that go on after a restart."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack import providers
from lodestack.schemas import DETECTIONS
from lodestack.sinks import files as sinks
from lodestack.sinks import slices as K
from lodestack.sources import files as sources
from lodestack.sources import images as M
from lodestack.sources import volumes
from lodestack.streaming import flows, listing


def contents(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def test_slices_with_labels(spark, tmp_path):
    draw = np.random.default_rng(1)
    seis, fault = draw.random((3, 8, 9)).astype(np.float32), np.zeros((3, 8, 9), np.float32)
    fault[0, 2:5, 3:7] = 1
    for name, a in (("s.npy", seis), ("f.npy", fault)):
        np.save(tmp_path / name, a)
    spark.dataSource.register(volumes.VolumeSource)
    sides = [spark.read.format("volume").load(f"{tmp_path}/{n}.npy").select(F.lit("v1").alias("id"), "slice_idx", "height", "width", "values") for n in "sf"]
    rows = K.slice_rows(volumes.paired_slices(*sides), F.lit("train"), F.col("id"))
    out = tmp_path / "set"
    for overwrite in (False, True):
        K.write_slices(rows, str(out), overwrite)
        got = contents(out)
        assert sorted(got) == sorted(f"{k}/train/v1_00{i}{e}" for k, e in (("images", ".png"), ("labels", ".txt")) for i in range(3))
        assert got["labels/train/v1_000.txt"].decode() == "0 0.333333 0.250000 0.333333 0.500000 0.666667 0.500000 0.666667 0.250000\n" and got["labels/train/v1_001.txt"] == b""
        low, high = np.quantile(seis[1].astype(float), (0.01, 0.99))
        pixels, bits = M.png_pixels(got["images/train/v1_001.png"])
        assert bits == 8 and np.array_equal(pixels[..., 0], np.floor(np.clip((seis[1].astype(float) - low) / (high - low), 0, 1) * 255))


def test_a_failing_task_leaves_neither_image_nor_label(spark, tmp_path):
    schema = "split string, name string, height int, width int, values array<int>, labels array<string>"
    good = [("train", f"n{k}", 1, 2, [k, 255], ["0 line"]) for k in range(6)]
    out = tmp_path / "set"
    for bad in (("train", "n9", 1, 2, [1], []), ("train", "../up", 1, 1, [1], [])):
        with pytest.raises(Exception):
            K.write_slices(spark.createDataFrame([*good, bad], schema).repartition(3), str(out))
        assert contents(tmp_path) == {} and not list(tmp_path.rglob("_pending*"))
    K.write_slices(spark.createDataFrame(good, schema).repartition(3), str(out))
    first = contents(out)
    K.write_slices(spark.createDataFrame(good, schema).repartition(2), str(out))
    assert contents(out) == first and len(first) == 12
    with pytest.raises(Exception):
        K.write_slices(spark.createDataFrame([*good[:2], bad], schema).repartition(3), str(out), overwrite=True)
    assert contents(out) == first
    K.write_slices(spark.createDataFrame(good[:2], schema), str(out), overwrite=True)
    assert sorted(contents(out)) == ["images/train/n0.png", "images/train/n1.png", "labels/train/n0.txt", "labels/train/n1.txt"]


def filtered(values, height, width, step, kinds):
    """Rows of bytes with filters, one byte at a time."""
    rows = np.frombuffer(values, np.uint8).reshape(height, -1).astype(int)
    out = bytearray()
    for y in range(height):
        kind = kinds[y % len(kinds)]
        out.append(kind)
        for x in range(rows.shape[1]):
            a, b, c = (rows[y, x - step] if x >= step else 0), (rows[y - 1, x] if y else 0), (rows[y - 1, x - step] if y and x >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((rows[y, x] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
    return bytes(out)


def png_file(width, height, depth, colour, lines, interlaced=0, palette=None):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = zlib.compress(lines)
    extra = chunk(b"PLTE", bytes(palette)) if palette else b""
    return M.MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + extra + chunk(b"IDAT", body[:7]) + chunk(b"IDAT", body[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 2), (3, 8), (4, 8), (6, 8), (6, 16)])
@pytest.mark.parametrize("interlaced", [0, 1])
def test_png_of_every_kind(colour, depth, interlaced):
    draw = np.random.default_rng(colour * 20 + depth)
    samples, palette = M.SAMPLES[colour], draw.integers(0, 256, (1 << min(depth, 8)) * 3).tolist() if colour == 3 else None
    for height, width in ((1, 1), (5, 3), (13, 17)):
        values = draw.integers(0, 1 << depth, (height, width, samples))

        def packed(part):
            if part.size == 0:
                return b""
            flat = part.reshape(part.shape[0], -1)
            if depth == 16:
                data = flat.astype(">u2").tobytes()
            elif depth == 8:
                data = flat.astype(np.uint8).tobytes()
            else:
                bits = (flat[..., None] >> np.arange(depth)[::-1] & 1).reshape(part.shape[0], -1)
                data = np.packbits(bits, axis=1).tobytes()
            return filtered(data, part.shape[0], part.shape[1], max(1, samples * depth // 8), [4, 3, 2, 1, 0])

        lines = b"".join(packed(values[y::d, x::r]) for y, x, d, r in M.PASSES) if interlaced else packed(values)
        got, bits = M.png_pixels(png_file(width, height, depth, colour, lines, interlaced, palette))
        want = np.array(palette).reshape(-1, 3)[values[..., 0]] if colour == 3 else values
        assert np.array_equal(got, want) and bits == (8 if colour == 3 else depth)


def test_written_images_come_back(spark, tmp_path):
    rows = [("a", 2, 3, [0, 1, 2, 253, 254, 255]), ("b", 1, 1, [7])]
    sinks.write_grey_images(spark.createDataFrame(rows, "name string, height int, width int, values array<int>"), str(tmp_path)).collect()
    draw = np.random.default_rng(6)
    colours = draw.integers(0, 256, (4, 5, 3))
    (tmp_path / "c.png").write_bytes(png_file(5, 4, 8, 2, filtered(colours.astype(np.uint8).tobytes(), 4, 5, 3, [4, 1])))
    (tmp_path / "d.png").write_bytes(b"no image")
    images = M.decoded_images(sources.read_images(spark, str(tmp_path)))
    got = {r.path[-5]: r for r in images.collect()}
    assert got["a"]["values"] == rows[0][3] and (got["a"].height, got["a"].width, got["a"].channels) == (2, 3, 1) and got["b"]["values"] == [7]
    assert got["d"].error.startswith("ValueError") and got["d"]["values"] is None
    seen = {r.path[-5]: r for r in M.shown_images(images).collect()}
    assert seen["c"]["values"] == colours.ravel().tolist()  # colours of eight bits pass as they are
    grey = np.array(rows[0][3], float)
    low, high = np.quantile(grey, (0.01, 0.99))
    want = (np.clip((grey - low) / (high - low), 0, 1) * 255).astype(int)
    assert seen["a"]["values"] == np.repeat(want, 3).tolist() and seen["d"].error == got["d"].error
    assert M.shown(np.array([[1.0, np.nan], [np.inf, 1.0]])).max() == 0
    with pytest.raises(ValueError):
        M.shown(np.full((2, 2), np.nan))


def counted(log, fails):
    """A model that notes its calls and fails for some images."""

    class Counted:
        def generate(self, image, prompt, max_tokens, temperature):
            with open(log, "a") as f:
                f.write(image + "\n")
            if int(image.split("/")[-1]) % fails == 0:
                raise ValueError("no reply")
            return '{"reasoning": ["r"], "final_answer": "A possible fault."}'

    return Counted


@pytest.mark.parametrize("limit,fails,sent", [(5, 3, 10), (5, 1, 40), (0, 3, 0), (100, 4, 40), (7, 100, 7)])
def test_no_more_images_are_sent_than_wanted(spark, tmp_path, limit, fails, sent):
    names = [f"d{k % 4}/{k}" for k in range(1, 41)]
    random.Random(3).shuffle(names)
    images = spark.createDataFrame([(n, "train", []) for n in names] + [("x", "val", [])], f"image string, split string, detections {DETECTIONS}").repartition(4)
    log = str(tmp_path / "log")
    open(log, "w").close()
    sinks.generate_split(images, lambda rows: providers.generate(rows, counted(log, fails)), str(tmp_path / "out"), "train", limit, least=5)
    order = sorted(names, key=lambda n: n.split("/"))
    good, bad = [], []
    for n in order:
        if len(good) == limit:
            break
        (bad if int(n.split("/")[-1]) % fails == 0 else good).append(n)
    read = lambda end: sorted(r.image for r in spark.read.schema("image string, error string").json(f"{tmp_path}/out/train{end}.jsonl").collect())
    assert (read(""), read("_sft").__len__(), read("_errors")) == (sorted(good), len(good), sorted(bad))
    asked = set(open(log).read().split())
    assert asked == set(order[: len(asked)]) and len(asked) <= sent


def test_paths_of_verified_rows():
    assert sinks.verified_paths("a/train.jsonl") == ("a/train_verified.jsonl", "a/train_verified_filtered.jsonl")


def test_successes_are_counted_over_batches_and_a_restart(spark, tmp_path):
    schema, folder = "split string, image string, error string", tmp_path / "in"
    folder.mkdir()

    def run(k, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/{k}")
        stream = spark.readStream.schema(schema).json(f"{folder}/*")
        query = flows.first_successes_stream(stream, 3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.split or "", r.image, r.error or "") for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect())

    assert run(1, [("a", "p/2", None), ("a", "p/1", None), ("b", "q/9", "bad"), ("a", "p/0", "bad"), (None, "n", None)]) == [("", "n", ""), ("a", "p/0", "bad"), ("a", "p/1", ""), ("a", "p/2", ""), ("b", "q/9", "bad")]
    # each run is a restart from the checkpoint; one place is left for a, two for the rows without a split
    second = run(2, [("a", "p/z", None), ("a", "p-x/1", None), ("a", "p/7", None), ("b", "q/1", None)])
    assert [r for r in second if r[0] == "a" and not r[2]] == [("a", "p/1", ""), ("a", "p/2", ""), ("a", "p/7", "")]
    third = run(3, [("a", "a/0", None), ("b", "q/0", None), ("b", "q/2", None), ("b", "q/3", None)])
    assert [r for r in third if r[0] == "a" and not r[2]] == [r for r in second if r[0] == "a" and not r[2]]
    assert [r[1] for r in third if r[0] == "b" and not r[2]] == ["q/0", "q/1", "q/2"]


def test_a_listing_as_a_stream(spark, tmp_path):
    spark.dataSource.register(listing.ListingSource)
    root = tmp_path / "in"

    def add(*names):
        for n in names:
            (root / n).parent.mkdir(parents=True, exist_ok=True)
            (root / n).write_bytes(n.encode())

    def run():
        stream = spark.readStream.format("listing").option("suffixes", ".png").load(str(root))
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.path.removeprefix(f"{root}/") for r in spark.read.schema("path string").parquet(f"{tmp_path}/out").collect())

    add("b.png", "a/c.PNG", "n.txt")
    assert run() == ["a/c.PNG", "b.png"]
    assert run() == ["a/c.PNG", "b.png"]  # a restart: nothing twice
    add("a/a.png", "z.png")
    assert run() == ["a/a.png", "a/c.PNG", "b.png", "z.png"]
    again = listing.ListingReader({"path": str(root), "suffixes": ".png"})
    assert again.latestOffset() == again.latestOffset() and len(again.partitions(again.initialOffset(), again.latestOffset())[0].rows) == 4


def test_history_of_training(spark, tmp_path):
    log = spark.createDataFrame([(3, 0.5, None), (1, 2.0, None), (2, None, 1.5)], "step int, loss double, eval_loss double").repartition(3)
    for n in (3, 0):
        sinks.write_history(log.limit(n), f"{tmp_path}/out/history.json")
        got = json.loads((tmp_path / "out" / "history.json").read_text())
        assert got == [{"step": 1, "loss": 2.0}, {"step": 2, "eval_loss": 1.5}, {"step": 3, "loss": 0.5}][:n]
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["history.json"]
