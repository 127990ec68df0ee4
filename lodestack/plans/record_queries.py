"""Records, labels, masks and replies made from the tables: the operators that prepare training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import providers
from lodestack.functions import text as T
from lodestack.operators import claims as C
from lodestack.operators import imaging as I
from lodestack.operators import learning as L
from lodestack.operators import pairing as P
from lodestack.operators import raster as G
from lodestack.operators import records as R
from lodestack.plans.registry import query, table
from lodestack.schemas import DETECTIONS, REPOSITORY_CATALOG
from lodestack.sources.volumes import paired_slices


def _total(values: Column, kind: str = "bigint") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, v: a + v)


@query(
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS k FROM embeddings),
    m AS (SELECT vec_id, (k * 4)::DOUBLE AS p, floor(least(1::DOUBLE, greatest(0::DOUBLE, v + 0.5::DOUBLE)) * 255)::INT AS g FROM e),
    b AS (SELECT vec_id, g, unnest([255::DOUBLE, 40::DOUBLE]) AS c, p, (g / 255::DOUBLE) * 0.45::DOUBLE AS s FROM m),
    o AS (SELECT vec_id, g, p * (1::DOUBLE - s) + c * s AS o, c FROM b)
    SELECT vec_id, sum(floor(least(255::DOUBLE, greatest(0::DOUBLE, CASE WHEN g / 255::DOUBLE >= 0.5::DOUBLE THEN o * 0.65::DOUBLE + c * 0.35::DOUBLE ELSE o END)))::INT)::BIGINT AS pixels,
        (sum(g) / 2)::BIGINT AS grey FROM o GROUP BY vec_id"""
)
def q44_overlay_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a vector as mask probabilities over a ramp of pixels, in a red and a green channel, and the grey mask itself."""
    e = F.transform("embedding", lambda v, k: F.struct((k * 4).cast("double").alias("p"), (v.cast("double") + 0.5).alias("m")))

    def channel(color: float) -> Column:
        return F.transform(e, lambda x: I.overlaid(x["p"], x["m"], F.lit(color)).cast("bigint"))

    grey = F.transform(e, lambda x: I.grey(x["m"]).cast("bigint"))
    return table(spark, sf_dir, "embeddings").select("vec_id", (_total(channel(255.0)) + _total(channel(40.0))).alias("pixels"), _total(grey).alias("grey"))


@query(
    """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS k FROM embeddings),
    l AS (SELECT label, v * 60 AS x, (k % 11) / 10::DOUBLE AS t, 1 / (1 + exp(-v * 60)) AS p FROM e)
    SELECT label, round(avg((greatest(x, 0) - x * t + ln(1 + exp(-abs(x)))) * CASE WHEN t > 0.5 THEN 20 ELSE 1 END * power(greatest(1 - CASE WHEN t > 0.5 THEN p ELSE 1 - p END, 1e-6::DOUBLE), 2)), 6) AS focal_loss,
        round(avg((greatest(x, 0) - x * t + ln(1 + exp(-abs(x)))) * CASE WHEN t > 0.5 THEN 20 ELSE 1 END), 6) AS weighted FROM l GROUP BY label"""
)
def q45_soft_focal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets between 0 and 1, and logits so large that the least doubt counts."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "v"))
    x, t = F.col("v").cast("double") * 60, (F.col("k") % 11) / F.lit(10.0)
    return e.groupBy("label").agg(F.round(F.avg(L.focal_loss(x, t)), 6).alias("focal_loss"), F.round(F.avg(L.focal_loss(x, t, gamma=0.0)), 6).alias("weighted"))


@query(
    """WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '[^a-zA-Z ]+', ' ', 'g')) AS t, turn % 5 AS kind FROM conversations),
    s AS (SELECT *, list_transform(string_split(t, ''), lambda x: unicode(x)) AS all_ids FROM c),
    i AS (SELECT *, CASE WHEN t = '' THEN [] ELSE all_ids END AS ids FROM s),
    v AS (SELECT *, list_filter(ids, lambda x: x NOT IN (32, 101)) AS own FROM i)
    SELECT conv_id, turn, CASE WHEN kind IN (3, 4) OR t = '' THEN '[empty decoded output] raw=''' || CASE WHEN kind = 4 AND t != '' THEN 'Answer:' ELSE '<unk>' END || ''' token_ids=['
            || coalesce(array_to_string(ids[1:64], ', '), '') || ']' WHEN kind = 1 THEN trim('<unk> ' || t) ELSE t END AS text,
        CASE WHEN len(own) > 0 AND len(own) < len(ids) THEN 2 ELSE 1 END AS variants, len(own) AS filtered FROM v"""
)
def q46_decoding_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points as token ids, of which blanks and `e` are special; candidates that begin with unknown tokens, hold an answer mark, or say nothing."""
    plain = F.trim(F.regexp_replace("text", "[^a-zA-Z ]+", " "))
    kind, t, unk = F.col("turn") % 5, F.col("t"), F.lit("<unk>")
    ids = F.transform(F.filter(F.split("t", ""), lambda x: x != ""), F.ascii)
    shown = (
        F.when((t == "") | (kind == 3), F.array(F.lit(" "), unk))
        .when(kind == 4, F.array(F.lit("Answer:"), F.lit("Answer:")))
        .when(kind == 0, F.array(F.lit(""), unk, F.concat(F.lit("<unk> "), t)))
        .when(kind == 1, F.array(F.concat(F.lit("<unk><unk> "), t)))
        .otherwise(F.array(F.concat(F.lit("Answer: no Answer: "), t)))
    )
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", plain.alias("t")).withColumn("ids", ids)
    text = T.chosen_decoding(shown, F.col("ids"))
    variants = L.token_variants(F.col("ids"), (32, 101))
    return c.select("conv_id", "turn", text.alias("text"), F.size(variants).alias("variants"), F.size(L.without_special(F.col("ids"), (32, 101))).cast("bigint").alias("filtered"))


_ARCHIVE_NAMES = "['train.tar.gz', 'validation.tar.gz', 'test.tar.gz', 'train.zip'][(page_id % 4)::INT + 1]"


@query(
    f"""WITH f AS (SELECT page_id, {_ARCHIVE_NAMES} AS name FROM pages)
    SELECT 'some' AS wanted, page_id, name FROM f WHERE name IN ('train.tar.gz', 'test.tar.gz') UNION ALL SELECT 'all', page_id, name FROM f WHERE name LIKE '%.tar.gz'"""
)
def q47_selected_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, (*P.ARCHIVES, "train.zip")))
    f = table(spark, sf_dir, "pages").select("page_id", F.get(names, (F.col("page_id") % 4).cast("int")).alias("name"))
    some = P.selected_archives(f, ["train", "test"]).select(F.lit("some").alias("wanted"), "page_id", "name")
    return some.unionByName(P.selected_archives(f, ["test", "all"]).select(F.lit("all").alias("wanted"), "page_id", "name"))


@query(
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'a/' || doc_id || '.npy' END AS given, 'data/set' AS root FROM documents), l AS (SELECT 'data/a/' || doc_id || '.npy' AS path FROM labels)
    SELECT doc_id, CASE WHEN 'data/' || given IN (SELECT path FROM l) THEN 'data/' || given ELSE given END AS path FROM r"""
)
def q48_first_existing_or_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume's path as it is, else beside the dataset's folder, else as given even if it is nowhere."""
    k = F.col("doc_id").cast("string")
    given = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("a/"), k, F.lit(".npy")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), given.alias("given"))
    listing = table(spark, sf_dir, "labels").select(F.concat(F.lit("data/a/"), k, F.lit(".npy")).alias("path"))
    found = P.first_existing(rows, [F.col("given"), P.beside_dataset(F.lit("data/set"), F.col("given"))], listing, "path", or_first=True)
    return found.select(F.col("row_id").alias("doc_id"), "path")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: some name a mask, some a label beside the image, some only have an image path from which the label's follows."""
    k, s = F.col("doc_id"), F.col("doc_id").cast("string")
    box = F.array(*(v.cast("double") for v in (k % 50, k % 40, k % 50 + 30, k % 40 + 20)))
    one = F.struct(F.lit("fault").alias("label"), F.lit(0.5).alias("confidence"), box.alias("box_xyxy"), F.lit(None).alias("mask_coverage"), F.lit(None).alias("polygon_xy_sample"))
    said = F.array(R.message("assistant", R.text_item(F.when(k % 2 == 0, F.concat(F.lit("said "), s)))))
    return table(spark, sf_dir, "documents").select(
        k.alias("row_id"), F.concat(F.lit("d/images/train/"), s, F.lit(".png")).alias("image"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"),
        F.when(k % 3 == 0, F.concat(F.lit("q "), s)).alias("question"), said.alias("messages"), F.concat(F.lit("chosen "), s).alias("chosen_answer"),
        F.when(k % 3 != 1, F.array(one)).cast(DETECTIONS).alias("detections"),
        F.when(k % 4 == 0, F.concat(F.lit("/masks/"), s, F.lit(".npy"))).alias("mask_path"), F.when(k % 4 == 1, F.concat(s, F.lit(".txt"))).alias("yolo_label_path"),
    )


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files of the labelled documents: masks, labels beside images, and labels in the labels folder."""
    k, s = F.col("doc_id"), F.col("doc_id").cast("string")
    path = F.when(k % 4 == 0, F.concat(F.lit("/masks/"), s, F.lit(".npy"))).when(k % 4 == 1, F.concat(F.lit("d/images/train/"), s, F.lit(".txt")))
    path = path.otherwise(F.concat(F.lit("d/labels/train/"), s, F.lit(".txt")))
    lines = F.when(k % 4 != 0, F.when(k % 5 == 0, F.array(F.lit("0 0 0 1 1"))).otherwise(F.array(F.lit("0 0 0 1 0 1 1 0 1"), F.lit(""))))
    values = F.when(k % 4 == 0, F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda c: (c < k % 7).cast("float")))
    return table(spark, sf_dir, "labels").select(path.alias("path"), lines.alias("lines"), values.alias("values"))


_TARGETS = """
WITH d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS "real", doc_id % 3 != 1 AS detected FROM documents),
g AS (SELECT *, list_transform([doc_id % 50, doc_id % 40, doc_id % 50 + 30, doc_id % 40 + 20], lambda v: least(31, greatest(0, round_even(v / 100::DOUBLE * 31, 0)))::INT) AS b FROM d),
t AS (SELECT doc_id, CASE WHEN "real" THEN 'real' WHEN {pseudo} THEN 'pseudo' ELSE 'missing' END AS source,
    CASE WHEN "real" THEN CASE WHEN doc_id % 4 = 0 THEN doc_id % 7 WHEN doc_id % 5 = 0 THEN 0 ELSE 961 END WHEN {pseudo} AND detected THEN (b[3] - b[1] + 1) * (b[4] - b[2] + 1) ELSE 0 END AS cells FROM g)
"""


@query(
    _TARGETS.format(pseudo="true") + """SELECT doc_id, 'd/images/train/' || doc_id || '.png' AS image, CASE WHEN doc_id % 3 = 0 THEN 'q ' || doc_id ELSE 'default' END AS question,
    CASE WHEN doc_id % 2 = 0 THEN 'said ' ELSE 'chosen ' END || doc_id AS answer, source, cells::DOUBLE AS cells, CASE WHEN cells > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS present, 1::DOUBLE AS valid FROM t"""
)
def q49_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole training rows; detections stand in where no label is."""
    labels = _labels(spark, sf_dir)
    rows = R.training_rows(_records(spark, sf_dir), labels.select("path"), labels, allow_pseudo=True)
    question = F.when(F.col("question") == T.DEFAULT_QUESTION, "default").otherwise(F.col("question"))
    return rows.select(F.col("row_id").alias("doc_id"), "image", question.alias("question"), "answer", "source", _total(F.col("mask"), "double").alias("cells"), "present", "valid")


@query(
    _TARGETS.format(pseudo="false") + """, l AS (SELECT source, cells, (doc_id % 10) / 10::DOUBLE AS x FROM t)
    SELECT round(avg(x) FILTER (source = 'real'), 6) AS focal_loss, round(avg(1 - x) FILTER (source = 'real'), 6) AS dice_loss, round(avg(ln(1 + exp(-abs(x))) + x - x * (cells > 0)::INT) FILTER (source = 'real'), 6) AS presence_loss,
        count(*) FILTER (source = 'real') AS supervised, round(2 + 0.25 * (avg(x) FILTER (source = 'real') + avg(1 - x) FILTER (source = 'real')) + 0.1 * avg(ln(1 + exp(-abs(x))) + x - x * (cells > 0)::INT) FILTER (source = 'real'), 6) AS loss FROM l"""
)
def q50_supervised_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite loss over rows whose mask counts; others add nothing."""
    labels = _labels(spark, sf_dir)
    rows = R.training_rows(_records(spark, sf_dir), labels.select("path"), labels)
    x = (F.col("row_id") % 10) / F.lit(10.0)
    samples = rows.select("valid", x.alias("focal_loss"), (1 - x).alias("dice_loss"), L.cross_entropy(x, F.col("present")).alias("presence_loss"))
    found = L.supervised_losses(samples, "valid")
    loss = L.composite_loss(F.lit(2.0), F.col("focal_loss"), F.col("dice_loss"), F.col("presence_loss"))
    return found.select(*(F.round(c, 6).alias(c) for c in ("focal_loss", "dice_loss", "presence_loss")), "supervised", F.round(loss, 6).alias("loss"))


@query(
    """WITH v AS (SELECT vec_id // 4 AS id, (vec_id % 4)::INT AS k, embedding::DOUBLE[] AS e FROM embeddings), f AS (SELECT * FROM v WHERE NOT (id % 5 = 0 AND k = 3)),
    r AS (SELECT f.*, list_sort(e) AS s FROM f), q AS (SELECT *, s[1] + (s[2] - s[1]) * 0.63 AS low, s[63] + (s[64] - s[63]) * (62.37 - 62) AS high FROM r)
    SELECT id || '_' || lpad(k::VARCHAR, 3, '0') AS name, list_sum(list_transform(e, lambda x: CASE WHEN high <= low THEN 0 ELSE floor(least(1::DOUBLE, greatest(0::DOUBLE, (x - low) / (high - low))) * 255)::INT END))::BIGINT AS bytes,
        len(list_filter(e, lambda x: x > 0)) AS fault FROM q"""
)
def q51_paired_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as the slices of volumes, four a volume; every fifth volume's faults lack the last slice. Sections become bytes without leaving their row."""
    k = F.col("vec_id")
    v = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 4").alias("id"), (k % 4).cast("int").alias("slice_idx"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("embedding", lambda x: x.cast("double")).alias("values")
    )
    pairs = paired_slices(v, v.filter(~((F.col("id") % 5 == 0) & (F.col("slice_idx") == 3))))
    shown = F.transform(I.section_bytes(F.col("seis")), lambda b: b.cast("bigint"))
    return pairs.select(
        P.slice_name(F.col("id").cast("string"), F.col("slice_idx")).alias("name"), _total(shown).alias("bytes"), F.size(F.filter("fault", lambda x: x > 0)).cast("bigint").alias("fault")
    )


class _Spotter:
    """A detector that finds two boxes, of places and scores that follow from the image's number."""

    def detect(self, image: str, confidence: float) -> dict[str, list]:
        n = int(image.rpartition("/")[2])
        if n % 13 == 12:
            raise ValueError(f"cannot read {image}")
        boxes = [[float(n % 60), float(n % 50), float(n % 60 + 20), float(n % 50 + 30)], [1.0, 2.0, 3.0, 4.0]]
        return {"boxes": boxes, "scores": [(n % 100) / 100, 0.2], "classes": [n % 3, 0], "coverages": [0.25], "outlines": [[[1.0, 2.0]] * (n % 40)]}


@query(
    """WITH d AS (SELECT doc_id AS n, n % 100 / 100::DOUBLE AS s, n % 13 = 12 AS bad FROM documents), g AS (SELECT *, NOT bad AND s >= 0.05::DOUBLE AS one FROM d),
    b AS (SELECT *, list_transform([n % 60, n % 50, n % 60 + 20, n % 50 + 30], lambda v: least(31, greatest(0, round_even(v / 100::DOUBLE * 31, 0)))::INT) AS c FROM g)
    SELECT n AS doc_id, CASE WHEN bad THEN 0 ELSE 1 + one::INT END AS detections, CASE WHEN one THEN ['fault', 'horizon', 'fault'][n % 3 + 1] WHEN NOT bad THEN 'fault' END AS first_label,
        CASE WHEN one THEN nullif(least(16, CASE WHEN n % 40 >= 32 THEN (n % 40 + 1) // 2 ELSE n % 40 END), 0) END AS outline, CASE WHEN bad THEN 'ValueError: cannot read img/' || n END AS error,
        CASE WHEN bad THEN 0 WHEN NOT one OR n % 40 >= 3 THEN 2 ELSE (c[3] - c[1] + 1) * (c[4] - c[2] + 1) + 2
            - greatest(0, least(c[3], 1) - greatest(c[1], 0) + 1) * (c[2] <= 1 AND c[4] >= 1)::INT END AS cells FROM b"""
)
def q52_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for images; every thirteenth cannot be read. Outlines of equal points enclose nothing; boxes are filled."""
    n = F.col("doc_id")
    images = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("img/"), n.cast("string")).alias("image"))
    found = providers.detected(images, _Spotter, {0: "fault", 1: "horizon"}, providers.GENERATION_CONFIDENCE)
    first = F.get("detections", F.lit(0))
    outline = F.when(F.size("detections") == 2, F.size(first["polygon_xy_sample"]))
    cells = G.detection_cells(F.col("detections"), F.lit(100.0), F.lit(100.0))
    return found.select("doc_id", F.size("detections").alias("detections"), first["label"].alias("first_label"), F.nullif(F.nullif(outline, F.lit(-1)), F.lit(0)).alias("outline"), "error", F.size(cells).alias("cells"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: printf('%.6f', least(1::DOUBLE, greatest(0::DOUBLE, (v::DOUBLE * 50 + 25) / 50)))) AS t FROM embeddings)
    SELECT vec_id, '0 ' || array_to_string(t, ' ') AS line, len(t) // 2 AS points, list_sum(list_transform(t, lambda x: round_even(x::DOUBLE * 31, 0)::INT))::BIGINT AS total FROM e"""
)
def q53_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines in pixels as label lines, and the lines read again as grid points."""
    n = F.floor(F.size("embedding") / 2).cast("int")
    outline = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array(*(F.get("embedding", 2 * k + j).cast("double") * 50 + 25 for j in (0, 1))))
    lines = table(spark, sf_dir, "embeddings").select("vec_id", G.normalized_label(outline, F.lit(50.0), F.lit(50.0)).alias("line"))
    read = lines.withColumn("p", G.points_of_label(F.col("line")))
    return read.select("vec_id", "line", F.size("p").cast("bigint").alias("points"), _total(F.transform("p", lambda p: (p["x"] + p["y"]).cast("bigint"))).alias("total"))


@query(
    """WITH d AS (SELECT doc_id, lang, regexp_replace(text, '[^a-zA-Z0-9]+', '', 'g') AS w FROM documents)
    SELECT 'i/' || doc_id AS image, 'Q ' || lang AS question, 'step ' || w || '. A ' || doc_id AS said, 1 AS steps, 0 AS detections, CASE WHEN doc_id % 2 = 0 THEN 'raw' ELSE 'A ' || doc_id END AS raw, 'B' AS second,
        'step ' || w || '. A ' || doc_id AS merged FROM d WHERE w != ''"""
)
def q54_chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat rows and instruction rows; a raw answer that is missing is the answer."""
    k, c = F.col("doc_id").cast("string"), F.col
    w = F.regexp_replace("text", "[^a-zA-Z0-9]+", "")
    d = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("i/"), k).alias("image"), F.concat(F.lit("Q "), c("lang")).alias("q"), F.array(F.concat(F.lit("step "), w, F.lit("..")), F.lit(" ")).alias("steps"),
        F.concat(F.lit("A "), k).alias("a"), F.when(c("doc_id") % 2 == 0, "raw").alias("raw"), "text", F.lit(None).cast(DETECTIONS).alias("none"),
    ).filter(F.col("text").rlike("[a-zA-Z0-9]")).drop("text")  # w is not empty
    sft = d.select("a", "raw", "steps", "q", *(x.alias(f"s_{n}") for x, n in zip(R.sft_record(c("image"), c("q"), c("steps"), c("a"), F.lit("merged"), c("none")), ("image", "question", "source", "detections", "steps", "answer", "messages"))))
    empty = F.expr(T.NO_STEPS)
    full = R.instruction_record(c("s_image"), F.lit("train"), c("q"), c("s_detections"), (c("raw"), c("steps"), c("a")), (F.lit(None).cast("string"), empty, F.lit("B")), (c("raw"), c("steps"), c("a")))
    rows = sft.select("s_question", "s_messages", "s_steps", "s_detections", *full)
    return rows.select(
        "image", F.col("s_question").alias("question"), R.assistant_text(c("s_messages")).alias("said"), F.size(F.filter("s_steps", lambda x: T.strip(x) != "")).alias("steps"), F.size("s_detections").alias("detections"),
        F.col("generator_answer_raw").alias("raw"), F.col("second_answer_raw").alias("second"), R.assistant_text(c("messages_merged")).alias("merged"),
    )


@query(
    """WITH d AS (SELECT ['train', 'val', 'held', 'extra'][(doc_id % 4)::INT + 1] AS split, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'no' ELSE 'yes' END AS answer FROM documents)
    SELECT s.split, (SELECT count(*) FROM d WHERE d.split = s.split) AS n, (SELECT count(*) FROM d WHERE d.split = s.split AND answer = 'yes') AS yes FROM (SELECT unnest(['train', 'val', 'test']) AS split) s"""
)
def q55_overlay_rows_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlay records by whether a label has content, and their number per wanted split; a split without rows counts 0."""
    names = F.array(*map(F.lit, ("train", "val", "held", "extra")))
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(k.cast("string").alias("image"), F.get(names, (k % 4).cast("int")).alias("split"), F.when(k % 3 == 0, " \n").otherwise("0 1 2").alias("text"))
    records = d.select(*R.overlay_record(F.col("image"), F.col("split"), P.label_path(F.lit("r"), F.col("split"), F.col("image")), F.col("text")))
    wanted = ("train", "val", "test")
    yes = P.rows_per_split(records.filter(F.col("answer") == R.OVERLAY_POSITIVE), wanted).select(F.col("split").alias("s"), F.col("n").alias("yes"))
    return P.rows_per_split(records, wanted).join(F.broadcast(yes), F.col("split") == F.col("s")).select("split", "n", "yes")


@query(
    """WITH c AS (SELECT conv_id, turn, turn % 5 AS kind, trim(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')) AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN NULL WHEN kind = 1 THEN 'a' || CASE WHEN t = '' THEN '' ELSE chr(10) || t END WHEN t != '' THEN t END AS text,
        CASE WHEN kind = 4 THEN 'no choices' WHEN t = '' AND kind = 0 THEN 'reasoning alone, stopped by length' WHEN t = '' AND kind != 1 THEN 'empty' END AS error,
        CASE WHEN kind = 4 OR (t = '' AND kind != 1) THEN NULL WHEN kind = 0 THEN ['why'] ELSE [] END AS reasoning FROM c"""
)
def q56_chat_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat responses in JSON: content as text, as a list, as the message's text; with reasoning beside it; or without choices."""
    t, kind = F.col("t"), F.col("turn") % 5
    plain = F.trim(F.regexp_replace("text", "[^a-zA-Z]+", " "))

    def message(inner: Column, reason: str = "stop") -> Column:
        return F.concat(F.lit('{"choices": [{"message": '), inner, F.lit(f', "finish_reason": "{reason}"}}]}}'))

    body = (
        F.when(kind == 0, message(F.concat(F.lit('{"content": "'), t, F.lit('", "reasoning_content": " why "}')), "length"))
        .when(kind == 1, message(F.concat(F.lit('{"content": [{"text": " a "}, {"type": "image"}, {"text": "'), t, F.lit('"}]}'))))
        .when(kind == 2, message(F.concat(F.lit('{"content": null, "text": "'), t, F.lit('"}'))))
        .when(kind == 3, message(F.concat(F.lit('{"content": "'), t, F.lit('"}'))))
        .otherwise(F.lit('{"choices": []}'))
    )
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", plain.alias("t"))
    r = c.select("conv_id", "turn", T.reply_text(body).alias("r"), T.reply_text(body, include_reasoning=True).alias("w"))
    alone = F.col("r.error").startswith("response has reasoning and no content (finish_reason=length)")
    why = F.when(F.col("r.error").startswith("response has no choices"), "no choices").when(alone, "reasoning alone, stopped by length").when(F.col("r.error").isNotNull(), "empty")
    steps = F.when(F.col("w.text").isNotNull(), T.split_reasoning(F.col("w.text"))["reasoning"])
    own = F.when(F.col("w.text").startswith("{"), steps).when(F.col("w.text").isNotNull(), F.expr(T.NO_STEPS))
    return r.select("conv_id", "turn", "r.text", why.alias("error"), own.alias("reasoning"))


@query(
    """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'f' || doc_id || '.npy' ELSE 'label ' || doc_id END AS name, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE n_chars END AS size, doc_id % 5 = 0 AS restricted FROM documents"""
)
def q57_repository_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for a file; some have no label, no size, or no flag."""
    k, s = F.col("doc_id"), F.col("doc_id").cast("string")
    file = F.struct(k.alias("id"), F.concat(F.lit("f"), s, F.lit(".npy")).alias("filename"), F.when(k % 4 != 0, F.col("n_chars")).alias("filesize"))
    one = F.struct(F.when(k % 3 != 0, F.concat(F.lit("label "), s)).otherwise("").alias("label"), file.alias("dataFile"), F.when(k % 5 == 0, True).alias("restricted"))
    made = F.struct(F.struct(F.array(one).alias("files")).alias("latestVersion")).alias("data")
    catalog = table(spark, sf_dir, "documents").select(F.struct(made).cast(f"struct<{REPOSITORY_CATALOG.replace('data struct', 'data:struct', 1)}>").alias("c")).select("c.data")
    return P.repository_files(catalog)


_A = T.ANSWER_PROMPT.replace("'", "''").replace("\n", "' || chr(10) || '")


@query(
    f"""SELECT doc_id, 'data:text/plain;base64,' || base64(encode(text)) AS url, replace(replace('{_A}', '{{question}}', 'Is ' || lang || ' {{x}}?'), '{{detections}}', 'none') AS prompt FROM documents"""
)
def q58_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = F.concat(F.lit("Is "), F.col("lang"), F.lit(" {x}?"))
    prompt = T.rendered(T.ANSWER_PROMPT, question=question, detections=T.detections_text(F.expr(f"cast(array() as {DETECTIONS})")))
    return table(spark, sf_dir, "documents").select("doc_id", T.data_url(F.col("text").cast("binary"), "text/plain").alias("url"), prompt.alias("prompt"))


@query(
    """WITH t AS (SELECT conv_id, turn, list_transform(string_split(text, ''), lambda x: unicode(x)) AS ids, conv_id % 10 AS batch, conv_id % 3 = 0 AS bare FROM conversations WHERE text != '')
    SELECT batch, count(*) FILTER (bare) AS refused, count(*) FILTER (NOT bare) AS n, sum(least(len(ids), 15) + 8) FILTER (NOT bare) AS attended, bool_and(bare) AS unsupervised FROM t GROUP BY batch"""
)
def q59_prefix_and_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an answer are refused; the others get room for the visual prefix; a batch of none but refused rows has no supervision."""
    ids = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), F.ascii)
    c = table(spark, sf_dir, "conversations").filter("text != ''").select((F.col("conv_id") % 10).alias("batch"), F.when(F.col("conv_id") % 3 == 0, F.expr("cast(array() as array<int>)")).otherwise(ids).alias("answer_ids"), F.expr("cast(array() as array<int>)").alias("prompt_ids"))
    rows = L.with_prefix(L.token_rows(c, most=16))
    bad = F.col("error").isNotNull()
    attended = F.sum(F.when(~bad, F.aggregate("mask", F.lit(0), lambda a, v: a + v)))
    found = rows.groupBy("batch").agg(F.count_if(bad).alias("refused"), F.count_if(~bad).alias("n"), attended.alias("attended"))
    none = L.unsupervised_batches(rows).select(F.col("batch").alias("_b"), F.lit(True).alias("_none"))
    return found.join(none, F.col("batch") == F.col("_b"), "left").select("batch", "refused", "n", "attended", F.coalesce("_none", F.lit(False)).alias("unsupervised"))


@query(
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS k FROM embeddings),
    p AS (SELECT vec_id, k, CASE WHEN vec_id % 20 = 0 THEN NULL WHEN k % 9 = 0 THEN NULL WHEN vec_id % 12 = 0 THEN 3::DOUBLE ELSE v END AS v FROM e),
    r AS (SELECT vec_id, quantile_cont(v, 0.01) AS low, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.99) AS high, min(v) AS a, max(v) AS z FROM p GROUP BY vec_id),
    n AS (SELECT vec_id, median, CASE WHEN high - low < 1e-6::DOUBLE THEN a ELSE low END AS low, CASE WHEN high - low < 1e-6::DOUBLE THEN z ELSE high END AS high FROM r)
    SELECT vec_id, sum(floor(least(1::DOUBLE, greatest(0::DOUBLE, (coalesce(v, median) - low) / greatest(high - low, 1e-6::DOUBLE))) * 255)::INT)::BIGINT AS bytes, bool_or(median IS NULL) AS failed FROM p JOIN n USING (vec_id) GROUP BY vec_id"""
)
def q60_scaled_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with values that are no finite numbers, with one value only, and with none."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    odd = F.when(F.col("vec_id") % 20 == 0, float("nan")).when(F.col("k") % 9 == 0, F.when(F.col("k") % 2 == 0, float("inf")).otherwise(float("nan")))
    value = odd.when(F.col("vec_id") % 12 == 0, 3.0).otherwise(F.col("v").cast("double"))
    scaled = I.scaled_image(e.select("vec_id", value.alias("value")), ["vec_id"])
    return scaled.groupBy("vec_id").agg(F.sum(F.col("byte").cast("bigint")).alias("bytes"), F.bool_or(F.col("error").isNotNull()).alias("failed"))


_CHECKPOINT = ("head.pt", "adapter/model.bin")


@query(
    """WITH f AS (SELECT doc_id % 50 AS k, ['head.pt', 'adapter/model.bin', 'notes.txt', 'w0.bin'][(doc_id % 4)::INT + 1] AS name FROM documents WHERE doc_id % 3 != 0 OR doc_id % 50 >= 10)
    SELECT 'run/' || k AS folder, bool_or(name IN ('head.pt', 'adapter/model.bin')) AS any_part, bool_or(name = 'head.pt') AND bool_or(name = 'adapter/model.bin') AS whole FROM f GROUP BY k"""
)
def q61_checkpoint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that hold some or all of a checkpoint's files."""
    k = F.col("doc_id")
    names = F.array(*map(F.lit, (*_CHECKPOINT, "notes.txt", "w0.bin")))
    path = F.concat(F.lit("run/"), (k % 50).cast("string"), F.lit("/"), F.get(names, (k % 4).cast("int")))
    listing = table(spark, sf_dir, "documents").filter((k % 3 != 0) | (k % 50 >= 10)).select(path.alias("path"))
    some, every = P.folders_with(listing, _CHECKPOINT), P.folders_with(listing, _CHECKPOINT, every=True)
    return some.select("folder", F.col("complete").alias("any_part")).join(every.select("folder", F.col("complete").alias("whole")), "folder")


@query(
    """WITH w AS (SELECT unnest(range(0, 40)) AS k), t AS (SELECT DISTINCT doc_id % 50 AS k FROM documents WHERE doc_id % 7 != 0) SELECT (SELECT count(*) FROM w WHERE k NOT IN (SELECT k FROM t)) = 0 AS complete"""
)
def q62_weights_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of forty weight files, against a listing."""
    index = spark.range(1).select(F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.struct(k.cast("string"), F.concat(F.lit("w"), k.cast("string"), F.lit(".bin"))))).alias("weight_map"))
    listing = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 7 != 0).select(F.concat(F.lit("m/w"), (F.col("doc_id") % 50).cast("string"), F.lit(".bin")).alias("path"))
    return P.weights_complete(index, listing)


@query(
    """WITH d AS (SELECT doc_id, CASE WHEN n_chars = 0 THEN 'none' WHEN n_chars % 3 = 0 THEN 'bad' END AS error FROM documents)
    SELECT error IS NULL AS ok, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM d GROUP BY 1"""
)
def q63_ok_and_error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that succeeded and rows that failed are complementary."""
    n = F.col("n_chars")
    error = F.when(n == 0, "none").when(n % 3 == 0, "bad")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("image"), F.lit("s").alias("split"), error.alias("error"))
    good = providers.succeeded(d).select(F.lit(True).alias("ok"), F.col("image").cast("bigint").alias("k"))
    bad = providers.failed(d).select(F.lit(False).alias("ok"), F.col("image").cast("bigint").alias("k"))
    return good.unionByName(bad).groupBy("ok").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("ids"))


@query(
    """WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), g AS (SELECT vec_id, e, unnest(range(1024)) AS c FROM a),
    p AS (SELECT vec_id, e, c, least(7::DOUBLE, greatest(0::DOUBLE, (c // 32 + 0.5::DOUBLE) * 8 / 32 - 0.5::DOUBLE)) AS y, least(7::DOUBLE, greatest(0::DOUBLE, (c % 32 + 0.5::DOUBLE) * 8 / 32 - 0.5::DOUBLE)) AS x FROM g),
    q AS (SELECT *, floor(y)::INT AS y0, least(7, floor(y)::INT + 1) AS y1, floor(x)::INT AS x0, least(7, floor(x)::INT + 1) AS x1 FROM p),
    v AS (SELECT vec_id, c, (e[y0 * 8 + x0 + 1] * (1 - (y - y0)) + e[y1 * 8 + x0 + 1] * (y - y0)) * (1 - (x - x0)) + (e[y0 * 8 + x1 + 1] * (1 - (y - y0)) + e[y1 * 8 + x1 + 1] * (y - y0)) * (x - x0) AS v FROM q)
    SELECT vec_id, count(*) AS cells, round(sum(v * (c % 7)), 4) + 0 AS checksum FROM v GROUP BY vec_id"""
)
def q64_upsampled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as token scores on a square, resampled to the mask's size in Arrow batches."""
    up = I.with_upsampled(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", "u")
    total = F.aggregate(F.transform("u", lambda v, k: v * (k % 7)), F.lit(0.0), lambda a, v: a + v)
    return up.select("vec_id", F.size("u").cast("bigint").alias("cells"), (F.round(total, 4) + F.lit(0.0)).alias("checksum"))


_TERMS = {n: "regexp_matches(t, '(?i)(?:^|[^\\p{L}\\p{N}_])(?:" + terms + ")(?:$|[^\\p{L}\\p{N}_])')" for n, terms in (("cf", T.FAULT_TERMS), ("ab", T.ABSENCE_TERMS), ("oc", T.CERTAINTY_TERMS))}


@query(
    f"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS t FROM documents),
    f AS (SELECT doc_id, {", ".join(f"{x} AS {n}" for n, x in _TERMS.items())} FROM d),
    v AS (SELECT doc_id, CASE WHEN NOT cf OR NOT ab THEN 'UNCERTAIN' WHEN oc THEN 'OVERCLAIM' ELSE 'SUPPORT' END AS label FROM f)
    SELECT doc_id % 3 AS k, label, count(*) FILTER (label != 'OVERCLAIM') AS kept, count(*) FILTER (label = 'OVERCLAIM') AS removed, sum(doc_id)::BIGINT AS ids FROM v GROUP BY ALL"""
)
def q65_verdict_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on whole texts without detections: each label's rows are either all kept or all removed. Texts are verified once."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast(DETECTIONS).alias("detections"))
    v = C.verify(d, "text").select("doc_id", "verification.label", "verification.remove")
    return v.groupBy((F.col("doc_id") % 3).alias("k"), "label").agg(F.count_if(~F.col("remove")).alias("kept"), F.count_if("remove").alias("removed"), F.sum("doc_id").alias("ids"))
