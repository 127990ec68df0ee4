import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack import providers
from lodestack.operators import claims as C
from lodestack.operators import imaging as I
from lodestack.operators import learning as L
from lodestack.operators import pairing as P
from lodestack.operators import raster as G
from lodestack.operators import records as R
from lodestack.schemas import DETECTIONS, INSTRUCTION, MESSAGES, SFT, schema

DETECTED = [("fault", 0.1235, [1.0, 2.0, 3.0, 4.0], None, None)]


@pytest.mark.parametrize(
    "present,claim,label,confidence",
    [
        (True, "", "UNCERTAIN", 0.0), (True, "The reflectors are continuous.", "UNCERTAIN", 0.55), (True, "Faults are visible.", "UNCERTAIN", 0.55),
        (True, "No fault is visible.", "CONTRADICT", 0.80), (True, "The section definitely shows a fault.", "OVERCLAIM", 0.70),
        (True, "Faulting offsets the reflectors.", "SUPPORT", 0.82), (True, "A possible fault disrupts continuity.", "SUPPORT", 0.72),
        (False, "Faults are definitely absent, no fault.", "OVERCLAIM", 0.76), (False, "No fault is visible.", "SUPPORT", 0.62),
        (False, "The section definitely shows a fault.", "UNCERTAIN", 0.68),
    ],
)
def test_rules(spark, present, claim, label, confidence):
    df = spark.createDataFrame([(claim, DETECTED if present else [])], f"answer string, detections {DETECTIONS}")
    v = C.verify(df, "answer").first()
    assert (v.verification.label, v.verification.confidence) == (label, confidence)
    assert v.verification.remove == (label in C.REMOVED)
    assert v.nli.variables.fault_present == present
    assert sum(v.verification.scores.values()) == pytest.approx(1 if claim else 0)


def test_summary_and_premise(spark):
    rows = [("No fault.", DETECTED), ("", None), ("Faulting.", DETECTED + [("fault", None, None, None, [[1.0, 2.0]])])]
    v = C.verify(spark.createDataFrame(rows, f"answer string, detections {DETECTIONS}"), "answer")
    s = C.summary(v).first()
    assert (s.total, s.kept, s.removed, s.missing_premise_or_hypothesis, s.labels) == (3, 2, 1, 1, {"SUPPORT": 1, "CONTRADICT": 1, "UNCERTAIN": 1})
    texts = [r.p for r in v.select("nli.premise").toDF("p").collect()]
    assert texts[0].endswith("1 fault detection(s), 1 boxed region(s), and 0 polygon overlay sample(s). The maximum detection confidence is 0.123.")
    assert "2 fault detection(s), 1 boxed region(s), and 1 polygon" in texts[2]
    assert C.kept(v).count() + v.filter("verification.remove").count() == v.count()
    empty = C.summary(v.limit(0)).first()
    assert (empty.total, empty.labels) == (0, {})


def test_files_and_pairs(spark):
    names = ["seismicTrain_1.npz", "fault_Train-1.npy", "faultsval 3.npz", "seistest12.npy", "notes.txt", "other1.npy"]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "pos int, name string")
    got = [tuple(r) for r in df.orderBy("pos").select(P.file_kind(F.col("name")), P.file_key(F.col("name"))).collect()]
    assert got == [("seis", "train1"), ("fault", "train1"), ("fault", "val3"), ("seis", "test12"), (None, None), (None, None)]
    four = spark.createDataFrame([(k, n) for k, n in enumerate(["seistrain1.npy", "seistrain1.npz", "seistrain2.npz", "seistrain2.npy"])], "pos int, name string")
    assert [r.name for r in P.best_files(four).orderBy("first_pos").collect()] == ["seistrain1.npz", "seistrain2.npz"]
    assert [tuple(r) for r in P.pair_manifest(P.best_files(df)).collect()] == [("train", "1", "seismicTrain_1.npz", "fault_Train-1.npy")]


def test_label_paths(spark):
    df = spark.createDataFrame([("a/images/x/images/t/n.png",), ("n.png",), ("images/n",)], "p string")
    assert [r.x for r in df.select(P.label_of_image(F.col("p")).alias("x")).collect()] == ["a/images/x/labels/t/n.txt", None, "labels/n.txt"]
    row = spark.createDataFrame([(1, "d/i.png", "m.npy")], "row_id int, image string, mask_path string")
    listing = spark.createDataFrame([("d/m.npy",)], "path string")
    found = P.first_existing(row, [F.col("mask_path"), P.sibling(F.col("image"), F.col("mask_path"))], listing, "label")
    assert found.first().label == "d/m.npy"
    index = spark.createDataFrame([({"a": "w1.bin", "b": "w2.bin"},)], "weight_map map<string,string>")
    for files, complete in ((["w1.bin"], False), (["x/w1.bin", "x/w2.bin"], True)):
        assert P.weights_complete(index, spark.createDataFrame([(f,) for f in files], "path string")).first().complete == complete
    assert not P.weights_complete(None, listing).first().complete
    assert spark.range(1).select(P.slice_name(F.lit("v"), F.lit(7)).alias("a"), P.slice_name(F.lit("v"), F.lit(1234)).alias("b")).first() == ("v_007", "v_1234")


def test_records(spark):
    df = spark.createDataFrame([("i.png", "q", ["A.", "B.."], "C")], "image string, q string, r array<string>, a string")
    c = F.col
    sft = df.select(*R.sft_record(c("image"), c("q"), c("r"), c("a"), F.lit("merged"), F.lit(None).cast(DETECTIONS)))
    assert [f.name for f in sft.schema] == [f.name for f in schema(SFT)]
    r = sft.first()
    assert r.detections == [] and r.messages[1].content[0].text == "A. B. C" and r.messages[0].content[0].image == "i.png"
    none = F.lit(None)
    full = df.select(
        *R.instruction_record(c("image"), F.lit("train"), c("q"), F.lit(None).cast(DETECTIONS), (none.cast("string"), none.cast("array<string>"), c("a")), (F.lit("raw"), c("r"), F.lit("D")), (none.cast("string"), c("r"), none.cast("string")))
    )
    assert [(f.name, f.dataType) for f in full.schema][4:13] == [(f.name, f.dataType) for f in schema(INSTRUCTION)][4:13]
    r = full.first()
    assert (r.generator_answer_raw, r.generator_reasoning, r.second_answer_raw, r.merged_answer_raw) == ("C", [], "raw", None)
    overlay = df.select(*R.overlay_record(c("image"), F.lit("val"), F.lit("l.txt"), F.lit(" \n"))).first()
    assert overlay.answer == R.OVERLAY_NEGATIVE


def test_messages(spark):
    def text(t):
        return ("text", None, t)

    rows = [
        (1, [("user", [("image", "i", None), text("a"), text("b")]), ("assistant", [("image", "x", None)]), ("assistant", [text("yes"), text("no")])]),
        (2, []), (3, None), (4, [("assistant", [text("only")])]),
    ]
    df = spark.createDataFrame(rows, f"k int, m {MESSAGES}").orderBy("k")
    got = df.select(R.assistant_text(F.col("m")), R.question_text(F.lit(None).cast("string"), F.col("m"), "default")).collect()
    assert [tuple(r) for r in got] == [("yes", "a\nb"), ("", "default"), ("", "default"), ("only", "default")]
    rows = spark.createDataFrame([("real.txt", None), (None, []), (None, None)], f"p string, d {DETECTIONS}")
    for pseudo, want in ((True, (1, 1, 1)), (False, (1, 0, 2))):
        assert tuple(R.label_source_counts(rows.withColumn("label_source", R.label_source(F.col("p"), F.col("d"), pseudo))).first()) == want


def test_rasters(spark):
    one = spark.range(1)
    box = F.array(*map(F.lit, (10.0, 20.0, 30.0, 40.0)))
    cells = one.select(G.box_cells(box, F.lit(100.0), F.lit(100.0)).alias("c")).first().c
    assert len(cells) == 49 and min(c.x for c in cells) == 3 and max(c.y for c in cells) == 12
    points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1, 1), (6, 1), (3, 6))))
    assert len(one.select(G.polygon_cells(points).alias("c")).first().c) == 13
    lines = spark.createDataFrame([("0 0 0 1 0 1",), (" 0 0 0 1 0 1 1 9 ",), ("",)], "line string")
    got = [r.p for r in lines.select(G.points_of_label(F.col("line")).alias("p")).collect()]
    assert got[0] is None and [tuple(p) for p in got[1]] == [(0, 0), (31, 0), (31, 31)] and got[2] is None
    for n, want in ((40, 16), (10, 10)):
        polygon = F.array(*(F.array(F.lit(k + 0.005), F.lit(1.0)) for k in range(n)))
        assert len(one.select(G.sampled_outline(polygon).alias("o")).first().o) == want
    label = G.normalized_label(F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (50.0, 200.0), (25.0, 10.0)))), F.lit(100.0), F.lit(100.0))
    assert one.select(label.alias("l")).first().l == "0 0.000000 0.000000 0.500000 1.000000 0.250000 0.100000"
    df = spark.createDataFrame([(DETECTED,), ([],), (None,)], f"d {DETECTIONS}")
    assert [len(r.c) for r in df.select(G.detection_cells(F.col("d"), F.lit(100.0), F.lit(100.0)).alias("c")).collect()] == [2, 0, 0]
    arrays = [F.array(F.array(F.lit(1.005), F.lit(2.0), F.lit(3.0), F.lit(4.0))), F.array(F.lit(0.33335)), F.array(F.lit(1)), F.create_map(F.lit(0), F.lit("x"))]
    made = one.select(G.detection_rows(*arrays, F.expr("cast(array() as array<double>)"), F.expr("cast(array() as array<array<array<double>>>)")).alias("d")).first().d
    assert made[0].label == "fault" and made[0].box_xyxy[0] == round(1.005, 2) and made[0].mask_coverage is None


def test_images(spark):
    cases = [((3000, 1001), (1280, 427)), ((1281, 3), (1280, 2)), ((5000, 1), (1280, 1)), ((10, 20), (10, 20))]
    trained = [((1000, 333), (512, 170)), ((1024, 3), (512, 2)), ((2048, 2), (512, 1)), ((512, 9), (512, 9))]
    for f, known in ((I.request_size, cases), (I.training_size, trained)):
        df = spark.createDataFrame([s for s, _ in known], "w long, h long")
        assert [tuple(r.s) for r in df.select(f(F.col("w"), F.col("h")).alias("s")).collect()] == [w for _, w in known]
    pixels = spark.createDataFrame([("s", float(i * i)) for i in range(17)] + [("c", 5.0)] * 4 + [("n", float("nan"))] + [("m", v) for v in (1.0, float("inf"), 3.0)], "k string, value double")
    r = {x.k: x for x in I.robust_range(pixels, ["k"]).collect()}
    assert (round(r["s"].low, 6), round(r["s"].high, 6)) == (0.16, 251.04)
    assert {x.byte for x in I.scaled_volume(pixels, ["k"]).filter("k = 'c'").collect()} == {0}
    image = I.scaled_image(pixels, ["k"])
    assert {x.error for x in image.filter("k = 'n'").collect()} == {"no finite pixels"}
    assert image.filter("k = 'm' and error is null").count() == 3
    up = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],)], "t array<double>").select(I.upsampled(F.col("t"), 4).alias("u")).collect()
    assert len(up[0].u) == 16 and up[0].u[0] == 1.0 and set(up[1].u) == {0.0}
    tokens = spark.range(2000).selectExpr("id % 50 as r", "id as p")
    kept = I.token_dropout(tokens, "r", "p", 0.99).groupBy("r").count().collect()
    assert len(kept) == 50


def test_losses_and_vectors(spark):
    cells = spark.createDataFrame([(1, 0.0, t) for t in (1.0, 0.0, 0.0, 0.0)], "s int, x double, t double")
    assert L.dice_loss(cells, "s", "x", "t").first().dice_loss == pytest.approx(0.6666664444)
    two = cells.limit(0).unionAll(spark.createDataFrame([(1, 0.0, 1.0), (1, 0.0, 0.0)], cells.schema))
    assert two.agg(F.avg(L.focal_loss(F.col("x"), F.col("t"))).alias("f")).first().f == pytest.approx(1.8195113490)
    v = spark.createDataFrame([(1, [1000.0, 1000.0], 0), (1, [2.0, 4.0], 0)], "b int, v array<double>, m int")
    assert [r.mean for r in L.masked_mean(v, ["b"], "v", "m").collect()] == [0.0, 0.0]
    s = v.select(L.softmax(F.col("v")).alias("s"), L.argmax(F.col("v")).alias("a")).collect()
    assert s[0].s == [0.5, 0.5] and [r.a for r in s] == [0, 1]
    log = spark.createDataFrame([(1, 0.5, None), (2, None, 0.4), (None, 1.0, None), (3, None, None)], "step long, loss double, eval_loss double")
    assert sorted(map(tuple, L.loss_series(log).collect())) == [(1, "train", 0.5), (2, "eval", 0.4)]


def test_batches(spark):
    rows = spark.createDataFrame([(0, [1, 2, 3, 4, 5], [8, 9]), (0, [1], [7]), (1, [1], [])], "batch int, prompt_ids array<int>, answer_ids array<int>")
    made = L.token_rows(rows, most=6)
    assert made.filter("error is not null").count() == 1
    got = {tuple(r.prompt_ids): r for r in L.padded(made.filter("error is null")).collect()}
    a, b = got[1, 2, 3, 4, 5], got[1,]
    assert (a.ids, a.labels) == ([2, 3, 4, 5, 8, 9], [-100] * 4 + [8, 9])
    assert (b.ids, b.labels, b["mask"]) == ([1, 7, 0, 0, 0, 0], [-100, 7, -100, -100, -100, -100], [1, 1, 0, 0, 0, 0])
    assert len(L.with_prefix(made).first().labels) == 6 + L.PREFIX_TOKENS
    bare = spark.createDataFrame([(1, [-100]), (2, [-100, 3])], "batch int, labels array<int>")
    assert [r.batch for r in L.unsupervised_batches(bare).collect()] == [1]


def test_generation_keeps_failures_apart(spark):
    images = spark.createDataFrame([(f"{k}.png", "train", None) for k in range(10)], f"image string, split string, detections {DETECTIONS}")
    out = providers.generate(images, lambda: providers.Stub(lambda i: i in ("2.png", "0.png")), second=lambda: providers.Stub()).cache()
    assert providers.failed(out).count() == 2 and providers.succeeded(out).count() == 8
    assert [r.image for r in providers.first_successes(out, 3).collect()] == ["1.png", "3.png", "4.png"]
    assert all(r.merged_answer and r.merged_reasoning for r in providers.succeeded(out).collect())
    scanned = spark.createDataFrame([(f"{k}", n) for k, n in enumerate([0, 0, 2, 1])], "image string, n int")
    for most, want in ((3, {(False, "0"), (True, "2")}), (2, {(False, "0")})):
        assert {(r.has, r.image) for r in providers.sample_pair(scanned, F.col("n") > 0, most=most).collect()} == want


def test_upsampled_rows_in_pieces(spark, monkeypatch):
    """The same numbers as the column gives, and no more than a few rows come back at a time."""
    draw = random.Random(4)
    rows = [(k, [draw.gauss(0, 1) for _ in range(draw.choice((0, 1, 3, 16, 64)))]) for k in range(300)] + [(900, None), (901, [1.0, None])]
    df = spark.createDataFrame(rows, "k int, t array<double>").coalesce(1)
    monkeypatch.setattr(I, "PIECE", 7 * 25)
    found = {r.k: r.u for r in I.with_upsampled(df, "t", "u", 5).collect()}
    want = {r.k: r.u for r in df.select("k", I.upsampled(F.col("t"), 5).alias("u")).collect()}
    assert repr(found) == repr(want) and len(found) == 302
    for k, t in rows[:300]:
        side = max(1, math.ceil(math.sqrt(len(t))))
        grid = np.array([*t, *[0.0] * (side * side - len(t))]).reshape(side, side)
        assert found[k] == I.bilinear(grid, 5).ravel().tolist()
