"""Tensors, detections and poses, from the embeddings table: 64 numbers as scores, an 8 x 8 image, or 12 boxes of 5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import detections, geometry, tensors
from strandline.queries import query, table

DOUBLES = "WITH t AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
BOX_TYPE = "struct<box:array<double>,score:double>"


def doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def rounded(a: Column, digits: int = 6) -> Column:
    return F.transform(a, lambda x: tensors.rounded(x, digits))


@query(f"{DOUBLES} SELECT vec_id, list_transform(v, lambda x: round(x / 255, 9)) AS scaled, list_transform(v, lambda x: round(greatest(least(x, 0.1), -0.1), 6)) AS clipped FROM t")
def normalize_and_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(spark, sf_dir).select("vec_id", rounded(tensors.normalize(F.col("v")), 9).alias("scaled"), rounded(tensors.clip(F.col("v"), -0.1, 0.1)).alias("clipped"))


@query("SELECT vec_id, list_transform(range(48), lambda i: embedding[CAST((i % 16) * 3 + i // 16 + 1 AS INTEGER)]) AS chw, list_transform(range(64), lambda i: embedding[CAST((i % 8) * 8 + i // 8 + 1 AS INTEGER)]) AS turned FROM embeddings")
def hwc_to_chw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", tensors.hwc_to_chw(F.slice(e, 1, 48), 4, 4, 3).alias("chw"), tensors.transpose(e, 8, 8).alias("turned"))


@query(f"{DOUBLES} SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS class, round(list_max(v), 6) AS score FROM t WHERE list_max(v) >= 0.25 AND NOT list_contains(v, 1.0)")
def argmax_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    best = detections.best_class(v)
    return doubles(spark, sf_dir).where(detections.usable_scores(v)).select("vec_id", best["class"].alias("class"), best["score"].alias("score")).where("score >= 0.25").select("vec_id", "class", F.round("score", 6).alias("score"))


@query(f"""{DOUBLES} SELECT vec_id, CAST(list_position(v[5:], list_max(v[5:])) - 1 AS INTEGER) AS class, round(list_max(v[5:]), 6) AS score, round(v[1], 6) AS x FROM t WHERE list_max(v[5:]) >= 0.2""")
def detection_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doubles(spark, sf_dir).select("vec_id", detections.decode(F.col("v"), 0.2).alias("d")).where("d is not null")
    return rows.select("vec_id", F.col("d.class").alias("class"), tensors.rounded(F.col("d.score"), 6).alias("score"), tensors.rounded(F.get("d.box", 0), 6).alias("x"))


SIZED = "SELECT vec_id, 200 + vec_id % 1000 AS w, 200 + (vec_id * 7) % 1000 AS h, list_transform(v[1:4], lambda x: (x + 0.5) * 640) AS b FROM t"


@query(f"""{DOUBLES}, s AS ({SIZED}), f AS (SELECT *, CASE WHEN h > w THEN h / 640.0 ELSE w / 640.0 END AS f FROM s),
  p AS (SELECT *, CASE WHEN h > w THEN floor((640 - w / f) / 2) ELSE floor((640 - h / f) / 2) END AS p FROM f)
  SELECT vec_id, [CAST(trunc((CASE WHEN h > w THEN b[1] - p ELSE b[1] END) * f) AS INTEGER), CAST(trunc((CASE WHEN h > w THEN b[2] ELSE b[2] - p END) * f) AS INTEGER),
  CAST(trunc(b[3] * f) AS INTEGER), CAST(trunc(b[4] * f) AS INTEGER)] AS box FROM p""")
def inverse_letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    box = F.transform(F.slice("v", 1, 4), lambda x: (x + 0.5) * 640)
    rows = doubles(spark, sf_dir).select("vec_id", box.alias("b"))
    return rows.select("vec_id", geometry.unletterbox(F.col("b"), 200 + i % 1000, 200 + (i * 7) % 1000).alias("box"))


@query(f"""{DOUBLES}, b AS (SELECT vec_id, list_transform(v[1:4], lambda x: CAST(trunc(x * 900) AS INTEGER)) AS b FROM t),
  c AS (SELECT vec_id, [greatest(least(b[1], 300), 0), greatest(least(b[2], 200), 0), greatest(least(b[3], 300), 0), greatest(least(b[4], 200), 0)] AS b FROM b),
  x AS (SELECT vec_id, b, CAST(trunc(b[1] - b[3] / 2) AS INTEGER) AS x1, CAST(trunc(b[2] - b[4] / 2) AS INTEGER) AS y1 FROM c)
  SELECT vec_id, [x1, y1, x1 + b[3], y1 + b[4]] AS corners, [CAST(trunc(b[1] * 1.5) AS INTEGER), CAST(trunc(b[2] * 2.5) AS INTEGER), CAST(trunc(b[3] * 1.5) AS INTEGER), CAST(trunc(b[4] * 2.5) AS INTEGER)] AS rescaled FROM x""")
def xywh_to_xyxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.transform(F.slice("v", 1, 4), lambda x: (x * 900).cast("int"))
    rows = doubles(spark, sf_dir).select("vec_id", geometry.clip_box(box, F.lit(300), F.lit(200)).alias("b"))
    return rows.select("vec_id", geometry.corners(F.col("b")).alias("corners"), geometry.rescale(F.col("b"), F.lit(1.5), F.lit(2.5)).alias("rescaled"))


def boxes() -> Column:
    """12 boxes by corners, from 5 numbers each: place, size and score."""
    at = lambda i, k: F.get(F.col("v"), i * 5 + k)
    one = lambda i: F.struct(
        F.array(F.floor(at(i, 0) * 100), F.floor(at(i, 1) * 100), F.floor(at(i, 0) * 100) + 10 + F.floor(F.abs(at(i, 2)) * 100), F.floor(at(i, 1) * 100) + 10 + F.floor(F.abs(at(i, 3)) * 100)).cast("array<double>").alias("box"),
        F.abs(at(i, 4)).alias("score"))
    return F.transform(F.sequence(F.lit(0), F.lit(11)), one)


BOXES = f"""{DOUBLES}, d AS (SELECT vec_id, unnest(range(12)) AS i, v FROM t),
  e AS (SELECT vec_id, i, floor(v[i * 5 + 1] * 100) AS x1, floor(v[i * 5 + 2] * 100) AS y1, floor(v[i * 5 + 1] * 100) + 10 + floor(abs(v[i * 5 + 3]) * 100) AS x2,
  floor(v[i * 5 + 2] * 100) + 10 + floor(abs(v[i * 5 + 4]) * 100) AS y2, abs(v[i * 5 + 5]) AS score FROM d),
  g AS (SELECT vec_id, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score}} ORDER BY score DESC, i) AS l FROM e GROUP BY 1)"""


@query(BOXES + """, k AS (SELECT vec_id, list_reduce(list_prepend(NULL, list_transform(l, lambda c: [c])), lambda acc, c: CASE WHEN acc IS NULL THEN c
  WHEN len(list_filter(acc, lambda a: greatest(least(a.x2, c[1].x2) - greatest(a.x1, c[1].x1), 0) * greatest(least(a.y2, c[1].y2) - greatest(a.y1, c[1].y1), 0) >
  0.5 * ((a.x2 - a.x1) * (a.y2 - a.y1) + (c[1].x2 - c[1].x1) * (c[1].y2 - c[1].y1) - greatest(least(a.x2, c[1].x2) - greatest(a.x1, c[1].x1), 0) * greatest(least(a.y2, c[1].y2) - greatest(a.y1, c[1].y1), 0)))) > 0
  THEN acc ELSE list_concat(acc, c) END) AS kept FROM g) SELECT vec_id, CAST(len(kept) AS INTEGER) AS n, list_transform(kept, lambda a: round(a.score, 6)) AS scores FROM k""")
def nms_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doubles(spark, sf_dir).select("vec_id", detections.suppress(boxes(), BOX_TYPE).alias("kept"))
    return rows.select("vec_id", F.size("kept").alias("n"), F.transform("kept", lambda d: F.round(d["score"], 6)).alias("scores"))


@query(BOXES.replace("abs(v[i * 5 + 5])", "v[i * 5 + 5]") + """, f AS (SELECT vec_id, list_filter(l, lambda c: c.score >= 0.05 AND c.score < 1) AS f FROM g) SELECT vec_id, len(f) AS n, round(list_sum(list_transform(f, lambda c: c.score)), 6) AS total FROM f WHERE len(f) > 0""")
def openvocab_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct(i.alias("class"), F.get(F.col("v"), i * 5 + 4).alias("score")))
    rows = doubles(spark, sf_dir).select("vec_id", F.array_sort(F.transform(detections.open_vocabulary(found), lambda d: F.struct((-d["score"]).alias("k"), d["class"].alias("c")))).alias("f"))
    total = F.aggregate("f", F.lit(0.0), lambda s, d: s - d["k"])
    return rows.where(F.size("f") > 0).select("vec_id", F.size("f").cast("long").alias("n"), F.round(total, 6).alias("total"))


@query(f"""{DOUBLES}, d AS (SELECT vec_id, 200 + vec_id % 1000 AS w, 200 + (vec_id * 7) % 1000 AS h, unnest(range(8)) AS i, v FROM t),
  p AS (SELECT vec_id, w, h, i, (v[i + 1] + 0.5) * 640 AS x, (v[i + 9] + 0.5) * 640 AS y, (v[i + 17] + 0.5) * 300 AS bw, (v[i + 25] + 0.5) * 300 AS bh,
  [abs(v[i + 33]) * 3, abs(v[i + 41]) * 3, abs(v[i + 49]) * 3, abs(v[i + 57]) * 3] AS s, CASE WHEN h > w THEN h / 640::DOUBLE ELSE w / 640::DOUBLE END AS f FROM d),
  u AS (SELECT *, list_max(s) AS score, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS class, CASE WHEN h > w THEN floor((640 - w / f) / 2) ELSE 0 END AS px, CASE WHEN h > w THEN 0 ELSE floor((640 - h / f) / 2) END AS py
  FROM p WHERE list_max(s) >= 0.45 AND NOT list_contains(s, 1.0)),
  c AS (SELECT vec_id, i, class, score, greatest(least(trunc((x - px) * f), w), 0) AS x, greatest(least(trunc((y - py) * f), h), 0) AS y, greatest(least(trunc(bw * f), w), 0) AS bw, greatest(least(trunc(bh * f), h), 0) AS bh FROM u),
  b AS (SELECT vec_id, i, class, score, trunc(x - bw / 2) AS x1, trunc(y - bh / 2) AS y1, bw, bh FROM c WHERE score > 0.45),
  g AS (SELECT vec_id, list({{'x': x1, 'y': y1, 'w': x1 + bw, 'h': y1 + bh, 'score': score, 'class': class}} ORDER BY score DESC, i) AS l FROM b GROUP BY 1),
  k AS (SELECT vec_id, list_reduce(list_prepend(NULL, list_transform(l, lambda c: [c])), lambda acc, c: CASE WHEN acc IS NULL THEN c WHEN len(list_filter(acc, lambda a: CASE WHEN a.w * a.h + c[1].w * c[1].h > 0 THEN
  greatest(least(a.x + a.w, c[1].x + c[1].w) - greatest(a.x, c[1].x), 0) * greatest(least(a.y + a.h, c[1].y + c[1].h) - greatest(a.y, c[1].y), 0) >
  0.5 * (a.w * a.h + c[1].w * c[1].h - greatest(least(a.x + a.w, c[1].x + c[1].w) - greatest(a.x, c[1].x), 0) * greatest(least(a.y + a.h, c[1].y + c[1].h) - greatest(a.y, c[1].y), 0)) ELSE true END)) > 0
  THEN acc ELSE list_concat(acc, c) END) AS kept FROM g)
  SELECT vec_id, list_transform(kept, lambda a: [CAST(a.x AS INTEGER), CAST(a.y AS INTEGER), CAST(a.w AS INTEGER), CAST(a.h AS INTEGER)]) AS boxes, list_transform(kept, lambda a: a.class) AS classes, list_transform(kept, lambda a: round(a.score, 6)) AS scores FROM k""")
def detector_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector's whole post-processing: 8 predictions of a box and 4 class scores, channel by channel, to boxes in the frame."""
    i, part = F.col("vec_id"), lambda a, by: F.transform(F.slice("v", a, 16), by)
    output = F.concat(part(1, lambda x: (x + 0.5) * 640), part(17, lambda x: (x + 0.5) * 300), part(33, lambda x: F.abs(x) * 3), part(49, lambda x: F.abs(x) * 3))
    rows = doubles(spark, sf_dir).select("vec_id", detections.predictions(output, 8, 8).alias("p"))
    found = rows.select("vec_id", detections.detected(F.col("p"), 200 + i % 1000, 200 + (i * 7) % 1000).alias("d")).where(F.size("d") > 0)
    return found.select("vec_id", F.col("d.box").alias("boxes"), F.col("d.class").alias("classes"), rounded(F.col("d.score")).alias("scores"))


@query(f"""{DOUBLES}, d AS (SELECT vec_id, 200 + vec_id % 1000 AS w, 200 + (vec_id * 7) % 1000 AS h, unnest(range(12)) AS i, v FROM t),
  f AS (SELECT *, CASE WHEN h > w THEN h / 640::DOUBLE ELSE w / 640::DOUBLE END AS f FROM d WHERE i >= 2 AND v[i * 5 + 5] >= 0.05 AND v[i * 5 + 5] < 1),
  p AS (SELECT *, CASE WHEN h > w THEN floor((640 - w / f) / 2) ELSE 0 END AS px, CASE WHEN h > w THEN 0 ELSE floor((640 - h / f) / 2) END AS py FROM f)
  SELECT vec_id, list([CAST(trunc(((v[i * 5 + 1] + 0.5) * 640 - px) * f) AS INTEGER), CAST(trunc(((v[i * 5 + 2] + 0.5) * 640 - py) * f) AS INTEGER), CAST(trunc(((v[i * 5 + 3] + 0.5) * 640 - px) * f) AS INTEGER),
  CAST(trunc(((v[i * 5 + 4] + 0.5) * 640 - py) * f) AS INTEGER)] ORDER BY i) AS boxes, list(CAST(i - 2 AS INTEGER) ORDER BY i) AS classes FROM p GROUP BY 1""")
def openvocab_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of open-vocabulary detections, back in the frame; the first two have no class."""
    i, at = F.col("vec_id"), lambda k, n: F.get(F.col("v"), k * 5 + n)
    one = lambda k: F.struct(F.array(*[(at(k, n) + 0.5) * 640 for n in range(4)]).alias("box"), (k - 2).alias("class"), at(k, 4).alias("score"))
    found = F.transform(F.sequence(F.lit(0), F.lit(11)), one)
    rows = doubles(spark, sf_dir).select("vec_id", detections.open_vocabulary_boxes(found, 200 + i % 1000, 200 + (i * 7) % 1000).alias("d")).where(F.size("d") > 0)
    return rows.select("vec_id", F.col("d.box").alias("boxes"), F.col("d.class").alias("classes"))


@query(f"""{DOUBLES} SELECT vec_id, [3, 7, 7] AS shape, list_transform(range(147), lambda i: CASE WHEN i % 49 // 7 BETWEEN 1 AND 4 AND i % 7 BETWEEN 1 AND 4
  THEN round(CAST(CAST(v[CAST(((i % 49 // 7 - 1) * 4 + i % 7 - 1) * 3 + i // 49 + 1 AS INTEGER)] / 255 AS FLOAT) AS DOUBLE), 7) ELSE round(CAST(CAST(128 / 255::DOUBLE AS FLOAT) AS DOUBLE), 7) END) AS data FROM t""")
def letterbox_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 4 x 4 image of three channels in the middle of a 7 x 7 one, as a model's input."""
    rows = doubles(spark, sf_dir).select("vec_id", tensors.input_tensor(F.slice("v", 1, 48), 4, 4, 3, 7, 7).alias("x"))
    return rows.select("vec_id", F.col("x.shape").alias("shape"), rounded(F.col("x.data").cast("array<double>"), 7).alias("data"))


_LABELS_SQL = "[" + ", ".join(f"'{x}'" for x in detections.LABELS) + "]"


@query(f"SELECT vec_id, CASE WHEN (label * 9) % 90 < 80 THEN {_LABELS_SQL}[(label * 9) % 90 + 1] END AS name FROM embeddings")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", detections.label((F.col("label") * 9) % 90).alias("name"))


@query(f"""{DOUBLES} SELECT vec_id, list_transform(range(10), lambda i: round(v[i * 6 + 1], 6)) AS first_x, list_transform(range(10), lambda i: round(v[i * 6 + 5], 6)) AS scores,
  list_transform(range(10), lambda i: {_LABELS_SQL}[CAST(trunc(abs(v[i * 6 + 6]) * 100) AS INTEGER) + 1]) AS labels FROM t""")
def user_data_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i, k: F.get(F.col("v"), i * 6 + k)
    rows = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.array(at(i, 0), at(i, 1), at(i, 2), at(i, 3), at(i, 4), F.abs(at(i, 5)) * 100))
    out = doubles(spark, sf_dir).select("vec_id", detections.packed(rows).alias("p"))
    return out.select("vec_id", F.transform("p.bboxes", lambda b: tensors.rounded(b[0], 6)).alias("first_x"), rounded(F.col("p.scores")).alias("scores"), F.col("p.labels").alias("labels"))


@query(f"""{DOUBLES} SELECT vec_id, round(v[56], 6) AS score, list_transform(range(17), lambda i: round(v[i * 3 + 2] * 640, 4)) AS xs, list_transform(range(17), lambda i: round(v[i * 3 + 1] * 480, 4)) AS ys,
  round(v[53] * 640, 4) AS xmin FROM t WHERE v[56] > 0.05""")
def pose_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doubles(spark, sf_dir).select("vec_id", detections.pose(F.col("v"), F.lit(640), F.lit(480)).alias("p")).where("p.score > 0.05")
    return rows.select("vec_id", tensors.rounded(F.col("p.score"), 6).alias("score"), rounded(F.col("p.points.x"), 4).alias("xs"), rounded(F.col("p.points.y"), 4).alias("ys"), tensors.rounded(F.get("p.box", 1), 4).alias("xmin"))


@query(f"{DOUBLES} SELECT vec_id, round(v[1], 6) AS x1, round(v[4], 6) AS y2, [round(v[5], 6), round(v[5], 6)] AS scores FROM t")
def trackable_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.get(F.col("v"), k)
    rows = doubles(spark, sf_dir).select("vec_id", detections.trackable(F.slice("v", 1, 4), at(4)).alias("d"))
    return rows.select("vec_id", tensors.rounded(F.get(F.get("d.points", 0), 0), 6).alias("x1"), tensors.rounded(F.get(F.get("d.points", 1), 1), 6).alias("y2"), rounded(F.col("d.scores")).alias("scores"))
