"""Pixels, rasters, losses and vectors, made from numeric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack import providers
from lodestack.functions.text import ANSWER_PROMPT, MERGE_PROMPT, QUESTION_PROMPT, rounded
from lodestack.operators import imaging as I
from lodestack.operators import learning as L
from lodestack.operators import raster as G
from lodestack.operators.containment import points_in_polygons
from lodestack.operators.outlines import label_lines, with_outlines
from lodestack.plans.registry import query, table
from lodestack.session import gone_at_the_end, shared_dir


def _six(x: Column) -> Column:
    return F.round(x, 6)


@query(
    """WITH r AS (SELECT l_returnflag AS flag, quantile_cont(l_extendedprice, 0.01) AS low, quantile_cont(l_extendedprice, 0.99) AS high FROM lineitem GROUP BY 1),
    b AS (SELECT flag, CASE WHEN high <= low THEN 0 ELSE floor(least(1::DOUBLE, greatest(0::DOUBLE, (l_extendedprice - low) / (high - low))) * 255)::INT END AS byte
        FROM lineitem JOIN r ON flag = l_returnflag)
    SELECT flag, byte, count(*) AS pixels FROM b GROUP BY ALL"""
)
def q21_percentile_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as pixel values, return flags as sections."""
    pixels = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("value"))
    return I.scaled_volume(pixels, ["flag"]).groupBy("flag", "byte").agg(F.count(F.lit(1)).alias("pixels"))


@query(
    """WITH s AS (SELECT p_partkey, (p_partkey % 3000 + 1)::BIGINT AS w, (p_size * 40)::BIGINT AS h FROM part), m AS (SELECT *, greatest(w, h) AS m FROM s)
    SELECT p_partkey, CASE WHEN m <= 1280 THEN w ELSE greatest(1, floor(w * (1280::DOUBLE / m)))::BIGINT END AS rw, CASE WHEN m <= 1280 THEN h ELSE greatest(1, floor(h * (1280::DOUBLE / m)))::BIGINT END AS rh,
        CASE WHEN m <= 512 THEN w ELSE greatest(1, round_even(w * (512::DOUBLE / m), 0))::BIGINT END AS tw, CASE WHEN m <= 512 THEN h ELSE greatest(1, round_even(h * (512::DOUBLE / m), 0))::BIGINT END AS th FROM m"""
)
def q22_resize_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_partkey") % 3000 + 1, (F.col("p_size") * 40).cast("bigint")
    sizes = table(spark, sf_dir, "part").select("p_partkey", I.request_size(w, h).alias("r"), I.training_size(w, h).alias("t"))
    return sizes.select("p_partkey", F.col("r.width").alias("rw"), F.col("r.height").alias("rh"), F.col("t.width").alias("tw"), F.col("t.height").alias("th"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outline for each vector, of half as many points as it has numbers."""
    n = F.floor(F.size("embedding") / 2).cast("int")

    def at(k: Column) -> Column:
        return G.on_grid(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get("embedding", k).cast("double") + 0.5)), 1.0)

    points = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(at(2 * k).alias("x"), at(2 * k + 1).alias("y")))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", points.alias("points"))


_CELLS = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda v: least(31, greatest(0, round_even(least(1::DOUBLE, greatest(0::DOUBLE, v::DOUBLE + 0.5)) * 31, 0)))::INT) AS c FROM embeddings),
p AS (SELECT vec_id, unnest(range(len(c) // 2)) AS k, c FROM c),
q AS (SELECT vec_id, c[2 * k + 1] AS a_x, c[2 * k + 2] AS a_y, c[2 * ((k + len(c) // 2 - 1) % (len(c) // 2)) + 1] AS b_x, c[2 * ((k + len(c) // 2 - 1) % (len(c) // 2)) + 2] AS b_y FROM p),
span AS (SELECT vec_id, min(a_x) AS x1, max(a_x) AS x2, min(a_y) AS y1, max(a_y) AS y2 FROM q GROUP BY vec_id),
g AS (SELECT vec_id, x1, x2, unnest(range(y1, y2 + 1)) AS y FROM span),
h AS (SELECT vec_id, y, unnest(range(x1, x2 + 1)) AS x FROM g),
cells AS (SELECT h.vec_id, y, x FROM h JOIN q USING (vec_id) GROUP BY ALL HAVING count(*) FILTER (((a_y > y + 0.5::DOUBLE) != (b_y > y + 0.5::DOUBLE))
    AND x + 0.5::DOUBLE < (b_x - a_x)::DOUBLE * (y + 0.5::DOUBLE - a_y) / ((b_y - a_y)::DOUBLE + 1e-6::DOUBLE) + a_x) % 2 = 1)
"""


@query(_CELLS + "SELECT vec_id, count(*) AS cells, sum(y) AS ys, sum(x) AS xs FROM cells GROUP BY vec_id")
def q23_polygon_rasterize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells stay in their row: no shuffle."""
    c = _points(spark, sf_dir).select("vec_id", G.polygon_cells(F.col("points")).alias("c")).filter(F.size("c") > 0)

    def total(axis: str) -> Column:
        return F.aggregate(F.transform("c", lambda v: v[axis].cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a + v)

    return c.select("vec_id", F.size("c").cast("bigint").alias("cells"), total("y").alias("ys"), total("x").alias("xs"))


@query(
    """WITH b AS (SELECT s_suppkey, [s_suppkey % 100, s_nationkey * 3, (s_suppkey * 7) % 100, 90 - s_nationkey * 2]::DOUBLE[] AS b FROM supplier),
    g AS (SELECT s_suppkey, list_transform(b, lambda v: least(31, greatest(0, round_even(v / 100 * 31, 0)))::INT) AS g FROM b)
    SELECT s_suppkey, least(g[1], g[3]) AS x1, greatest(g[1], g[3]) AS x2, least(g[2], g[4]) AS y1, greatest(g[2], g[4]) AS y2, (x2 - x1 + 1) * (y2 - y1 + 1) AS cells FROM g"""
)
def q24_box_rasterize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    box = F.array(*(v.cast("double") for v in (k % 100, n * 3, (k * 7) % 100, 90 - n * 2)))
    c = table(spark, sf_dir, "supplier").select("s_suppkey", G.box_cells(box, F.lit(100.0), F.lit(100.0)).alias("c"))
    xs, ys = F.transform("c", lambda v: v["x"]), F.transform("c", lambda v: v["y"])
    return c.select(
        "s_suppkey", F.array_min(xs).alias("x1"), F.array_max(xs).alias("x2"), F.array_min(ys).alias("y1"), F.array_max(ys).alias("y2"), F.size(F.array_distinct("c")).alias("cells")
    )


@query(_CELLS + "SELECT e.vec_id, count(c.vec_id) > 0 AS present, printf('%.6f', count(c.vec_id) / 1024)::DOUBLE AS coverage FROM embeddings e LEFT JOIN cells c USING (vec_id) GROUP BY e.vec_id")
def q25_mask_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = _points(spark, sf_dir).select("vec_id", G.mask_summary(G.mask(G.polygon_cells(F.col("points")))).alias("m"))
    return masks.select("vec_id", "m.present", rounded(F.col("m.coverage"), 6).alias("coverage"))


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, logit, target): each number of a vector is a logit, and positive ones of even place are true."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "v"))
    target = F.when((F.col("k") % 2 == 0) & (F.col("v") > 0), 1.0).otherwise(0.0)
    return e.select("vec_id", "label", (F.col("v").cast("double") * 4).alias("logit"), target.alias("target"))


_LOGITS = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS k FROM embeddings),
l AS (SELECT vec_id, label, v * 4 AS x, CASE WHEN k % 2 = 0 AND v > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS t, 1 / (1 + exp(-v * 4)) AS p FROM e) """


@query(
    _LOGITS + """, d AS (SELECT vec_id, label, 1 - (2 * sum(p * t) + 1e-6::DOUBLE) / (sum(p) + sum(t) + 1e-6::DOUBLE) AS d FROM l GROUP BY ALL)
    SELECT label, round(avg(d), 6) AS dice_loss FROM d GROUP BY label"""
)
def q26_dice_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.dice_loss(_logits(spark, sf_dir).withColumn("s", F.struct("vec_id", "label")), "s", "logit", "target")
    return d.groupBy(F.col("s.label").alias("label")).agg(_six(F.avg("dice_loss")).alias("dice_loss"))


@query(
    _LOGITS + """SELECT label, round(avg((greatest(x, 0) - x * t + ln(1 + exp(-abs(x)))) * power(1 - (p * t + (1 - p) * (1 - t)), 2) * (1 + 19 * t)), 6) AS focal_loss FROM l GROUP BY label"""
)
def q27_focal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).groupBy("label").agg(_six(F.avg(L.focal_loss(F.col("logit"), F.col("target")))).alias("focal_loss"))


@query(
    """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT vec_id, e, list_transform(e, lambda v: exp(v - list_max(e))) AS r, list_position(e, list_max(e)) AS place FROM s)
    SELECT vec_id, coalesce(['SUPPORT', 'UNCERTAIN', 'CONTRADICT', 'OVERCLAIM'][place], 'LABEL_' || (place - 1)) AS verdict, round(list_max(r) / list_sum(r), 6) AS confidence FROM r"""
)
def q28_softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbers of a vector as logits; classes beyond the known ones are called by their place."""
    from lodestack.operators.claims import LABELS

    e = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", L.class_name(L.argmax(e), LABELS).alias("verdict"), _six(F.array_max(L.softmax(e))).alias("confidence"))


@query(
    """WITH e AS (SELECT label, (vec_id % 3 != 0)::INT AS m, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS dim FROM embeddings)
    SELECT label, dim::INT AS dim, round(sum(v * m) / greatest(sum(m), 1), 6) AS mean FROM e GROUP BY ALL"""
)
def q29_masked_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("m", (F.col("vec_id") % 3 != 0).cast("int"))
    return L.masked_mean(e, ["label"], "embedding", "m").select("label", "dim", _six(F.col("mean")).alias("mean"))


@query(
    """SELECT event_id AS step, CASE event_type WHEN 'view' THEN 'train' ELSE 'eval' END AS series, value FROM events WHERE event_type IN ('view', 'click') AND event_id % 10 != 0 AND value IS NOT NULL"""
)
def q31_loss_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views stand for training losses, clicks for evaluation losses; every tenth item has no step."""
    kind = F.col("event_type")
    step = F.when(F.col("event_id") % 10 != 0, F.col("event_id"))
    log = table(spark, sf_dir, "events").select(step.alias("step"), F.when(kind == "view", F.col("value")).alias("loss"), F.when(kind == "click", F.col("value")).alias("eval_loss"))
    return L.loss_series(log)


@query(
    """WITH s AS (SELECT event_id, value >= 20 AS has FROM events ORDER BY lpad(event_id::VARCHAR, 12, '0') LIMIT 200)
    SELECT has, min(event_id) AS event_id FROM s GROUP BY has"""
)
def q32_first_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("image", F.lpad(F.col("event_id").cast("string"), 12, "0"))
    return providers.sample_pair(e, F.col("value") >= 20).select("has", "event_id")


@query("SELECT doc_id FROM documents WHERE n_chars BETWEEN 1 AND 2000 ORDER BY 'img/' || lpad(doc_id::VARCHAR, 9, '0') LIMIT 100")
def q33_success_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred documents that are neither empty nor too long."""
    image = F.concat(F.lit("img/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    error = F.when(~F.col("n_chars").between(1, 2000), "empty or too long")
    return providers.first_successes(table(spark, sf_dir, "documents").select("doc_id", image.alias("image"), error.alias("error")), 100).select("doc_id")


@query(
    """WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: printf('%.2f', v::DOUBLE)::DOUBLE) AS e, greatest(len(embedding) // 2 // 16, 1) AS step FROM embeddings)
    SELECT vec_id, least(16, len(range(0, len(e) // 2, step))) AS points, round(list_sum(list_transform(range(0, len(e) // 2, step)[1:16], lambda k: e[2 * k + 1] + 2 * e[2 * k + 2])), 4) + 0 AS checksum FROM p"""
)
def q34_polygon_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as outlines of half as many points."""
    n = F.floor(F.size("embedding") / 2).cast("int")
    outline = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array(F.get("embedding", 2 * k).cast("double"), F.get("embedding", 2 * k + 1).cast("double")))
    s = table(spark, sf_dir, "embeddings").select("vec_id", G.sampled_outline(outline).alias("o"))
    total = F.aggregate(F.transform("o", lambda p: p[0] + 2 * p[1]), F.lit(0.0), lambda a, v: a + v)
    return s.select("vec_id", F.size("o").cast("bigint").alias("points"), (F.round(total, 4) + F.lit(0.0)).alias("checksum"))


@query(
    """WITH t AS (SELECT vec_id, unnest(range(len(embedding))) AS k FROM embeddings), s AS (SELECT vec_id, k, ('0x' || left(md5('42|' || vec_id || '|' || k), 8))::BIGINT / 4294967296 AS s FROM t)
    SELECT vec_id, greatest(1, count(*) FILTER (s < 0.25)) AS kept FROM s GROUP BY vec_id"""
)
def q39_token_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "v"))
    return I.token_dropout(tokens, "vec_id", "place").groupBy("vec_id").agg(F.count(F.lit(1)).alias("kept"))


def _sql_text(template: str, **values: str) -> str:
    """A prompt template as an SQL expression."""
    text = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, value in values.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


_REPLY = "left(md5(image || '|' || {}), 8)"
_SAID = "'A possible fault at ' || {} || '.'"


@query(
    f"""WITH d AS (SELECT 'img/' || doc_id AS image, source AS split, doc_id % 10 = 7 AS fails FROM documents),
    q AS (SELECT *, {_REPLY.format(_sql_text(QUESTION_PROMPT))} AS qt FROM d),
    g AS (SELECT *, {_SAID.format("qt")} AS question FROM q),
    a AS (SELECT *, {_REPLY.format(_sql_text(ANSWER_PROMPT, question="question", detections="'none'"))} AS gt FROM g),
    s AS (SELECT *, {_REPLY.format("question")} AS st FROM a),
    m AS (SELECT *, {_REPLY.format(_sql_text(MERGE_PROMPT, question="question", detections="'none'", first_reasoning='\'["seen \' || gt || \'"]\'', first_answer=_SAID.format("gt"),
        second_reasoning='\'["seen \' || st || \'"]\'', second_answer=_SAID.format("st")))} AS mt FROM s)
    SELECT image, split, CASE WHEN fails THEN '' ELSE question END AS question, CASE WHEN fails THEN '' ELSE {_SAID.format("gt")} END AS generator_answer,
        CASE WHEN fails THEN '' ELSE {_SAID.format("st")} END AS second_answer, CASE WHEN NOT fails THEN {_SAID.format("mt")} END AS merged_answer,
        CASE WHEN fails THEN 'ValueError: no reply for ' || image END AS error FROM m"""
)
def q40_stub_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stands for an image, with a second responder; images whose name ends in 7 fail."""
    from lodestack.schemas import DETECTIONS

    d = table(spark, sf_dir, "documents")
    images = d.select(F.concat(F.lit("img/"), F.col("doc_id").cast("string")).alias("image"), F.col("source").alias("split"), F.lit(None).cast(DETECTIONS).alias("detections"))
    out = providers.generate(images, lambda: providers.Stub(lambda image: image.endswith("7")), providers.Stub)
    return out.select("image", "split", "question", "generator_answer", "second_answer", "merged_answer", "error")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q41_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the table, run until all is read; its result is a table in the shared folder."""
    import uuid

    from lodestack.streaming.flows import stream_to_parquet, windowed_counts

    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    base = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    gone_at_the_end(spark, base)
    found = stream_to_parquet(windowed_counts(stream), f"{base}/table", f"{base}/checkpoint")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"""
)
def q42_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    return r.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "quantity")


@query(
    """WITH g AS (SELECT n_name, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY orders DESC, n_name) AS place FROM g"""
)
def q43_join_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins, and a rank over what is left of them. Orders meet customers by a shuffle join unless customers prove small."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.select("o_custkey", "o_orderpriority", "o_totalprice").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy("c_nationkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("t"))
    g = g.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.rank().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("orders"), "n_name"))
    return g.select("n_name", "o_orderpriority", "orders", F.round("t", 2).alias("total"), place.cast("bigint").alias("place"))


#: A star of eight points, in tenths of its size.
_STAR = ((-10, -10), (0, -4), (10, -10), (4, 0), (10, 10), (0, 4), (-10, 10), (-4, 0))


@query(
    f"""WITH p AS (SELECT o_orderkey, (o_orderkey * 37 % 1009)::DOUBLE AS x, (o_orderkey * 91 % 997)::DOUBLE AS y FROM orders),
    v AS (SELECT s_suppkey, s_suppkey * 53 % 1009 AS cx, s_suppkey * 71 % 997 AS cy, s_suppkey % 4 + 1 AS r, [{", ".join(f"[{x}, {y}]" for x, y in _STAR)}] AS star FROM supplier),
    e AS (SELECT s_suppkey, (cx + star[k + 1][1] * r + 0.5)::DOUBLE AS x, (cy + star[k + 1][2] * r + 0.5)::DOUBLE AS y, (cx + star[(k + 7) % 8 + 1][1] * r + 0.5)::DOUBLE AS px,
        (cy + star[(k + 7) % 8 + 1][2] * r + 0.5)::DOUBLE AS py FROM (SELECT *, unnest(range(8)) AS k FROM v))
    SELECT s_suppkey, o_orderkey FROM p JOIN e ON (e.y > p.y) != (e.py > p.y) AND p.x < (e.px - e.x) * (p.y - e.y) / (e.py - e.y + 0.000001::DOUBLE) + e.x
    GROUP BY ALL HAVING count(*) % 2 = 1"""
)
def q66_points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points and suppliers as stars, met by grid cells."""
    k = F.col("o_orderkey")
    points = table(spark, sf_dir, "orders").select("o_orderkey", (k * 37 % 1009).cast("double").alias("x"), (k * 91 % 997).cast("double").alias("y"))
    s = F.col("s_suppkey")
    corner = lambda x, y: F.struct(*((s * m % n + v * (s % 4 + 1) + 0.5).alias(c) for m, n, v, c in ((53, 1009, x, "x"), (71, 997, y, "y"))))
    stars = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(*(corner(x, y) for x, y in _STAR)).alias("outline"))
    return points_in_polygons(points, stars, cell=16.0).select("s_suppkey", "o_orderkey")


@query(
    """WITH b AS (SELECT c_custkey AS k, k % 11 AS x0, k % 7 AS y0, k % 11 + k % 5 AS x1, k % 7 + k % 3 AS y1, 18 + k % 9 AS u0, k % 13 AS v0, 18 + k % 9 + k % 4 AS u1, k % 13 + k % 6 AS v1 FROM customer),
    t AS (SELECT k, 1 AS side, y0 AS top, x0 AS a, y0 AS b, x1 AS c, y1 AS d FROM b UNION ALL SELECT k, 2, v0, u0, v0, u1, v1 FROM b),
    l AS (SELECT k, side, top, '0 ' || array_to_string(list_transform([a, b, a, d, c, d, c, b], lambda v: printf('%.6f', v / 32::DOUBLE)), ' ') AS line FROM t WHERE a < c AND b < d)
    SELECT c_custkey, coalesce(string_agg(line, '|' ORDER BY top, side), '') AS lines, count(line) AS regions FROM customer LEFT JOIN l ON k = c_custkey GROUP BY c_custkey"""
)
def q67_labels_of_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of two boxes for each customer, and the label lines of their outlines; a box of one row or column has none."""
    k = F.col("c_custkey")

    def cells(x: Column, y: Column, right: Column, down: Column) -> Column:
        rows = F.transform(F.sequence(y, y + down), lambda v: F.transform(F.sequence(x, x + right), lambda u: F.struct(v.cast("int").alias("y"), u.cast("int").alias("x"))))
        return F.flatten(rows)

    both = F.concat(cells(k % 11, k % 7, k % 5, k % 3), cells(k % 9 + 18, k % 13, k % 4, k % 6))
    masks = table(spark, sf_dir, "customer").select("c_custkey", F.lit(32).alias("height"), F.lit(32).alias("width"), G.mask(both).alias("values"))
    lines = with_outlines(masks, keep_values=False).select("c_custkey", label_lines(F.col("outlines"), F.col("height"), F.col("width")).alias("l"))
    return lines.select("c_custkey", F.array_join("l", "|").alias("lines"), F.size("l").cast("bigint").alias("regions"))
