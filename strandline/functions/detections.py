"""Post-processing of detections: thresholds, suppression, labels, packing, poses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import geometry, tensors

CONFIDENCE, IOU = 0.45, 0.5
# The labels of the detector's classes, by number.
LABELS = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light",
    "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat", "dog", "horse", "sheep", "cow",
    "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee",
    "skis", "snowboard", "sports ball", "kite", "baseball bat", "baseball glove", "skateboard", "surfboard",
    "tennis racket", "bottle", "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple",
    "sandwich", "orange", "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch",
    "potted plant", "bed", "dining table", "toilet", "tv", "laptop", "mouse", "remote", "keyboard",
    "cell phone", "microwave", "oven", "toaster", "sink", "refrigerator", "book", "clock", "vase",
    "scissors", "teddy bear", "hair drier", "toothbrush",
)


def usable_scores(scores: Column) -> Column:
    """No NaN, no exact 1."""
    return ~tensors.has_nan(scores) & ~tensors.has_one(scores)


def best_class(scores: Column) -> Column:
    """class, score of the first maximum."""
    return F.struct(tensors.argmax(scores).alias("class"), F.array_max(scores).alias("score"))


def decode(row: Column, least: float = CONFIDENCE) -> Column:
    """(x, y, w, h, class scores...) as box, class, score; null if the scores are unusable or all below `least`."""
    scores = F.slice(row, 5, F.size(row) - 4)
    best = best_class(scores)
    found = F.struct(F.slice(row, 1, 4).alias("box"), best["class"].alias("class"), best["score"].alias("score"))
    return F.when(usable_scores(scores) & (best["score"] >= least), found)


def iou(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two boxes given by corners; `empty` if both are empty."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(empty))


def as_sized(box: Column) -> Column:
    """Corners read as (x, y, w, h), as the suppression of the detection example reads them."""
    return F.array(box[0], box[1], box[0] + box[2], box[1] + box[3])


def suppress(found: Column, kind: str, overlap: float = IOU, least: float | None = None, sized: bool = False) -> Column:
    """Greedy non-maximum suppression of array<struct<box, score, ...>>: by falling score, ties by place.

    kind: Spark's type of one element. sized: see as_sized(); two empty boxes then count as one.
    """
    box = (lambda d: as_sized(d["box"])) if sized else (lambda d: d["box"])
    order = F.transform(found, lambda d, i: F.struct((-d["score"]).alias("k"), i.alias("i"), d.alias("d")))
    ranked = F.transform(F.array_sort(order), lambda s: s["d"])
    if least is not None:
        ranked = F.filter(ranked, lambda d: d["score"] > least)
    keep = lambda kept, d: F.when(F.exists(kept, lambda q: iou(box(q), box(d), float(sized)) > overlap), kept).otherwise(F.array_append(kept, d))
    return F.aggregate(ranked, F.array().cast(f"array<{kind}>"), keep)


FOUND = "struct<box:array<int>,class:int,score:double>"


def predictions(output: Column, channels: int, count: int) -> Column:
    """Rows of (x, y, w, h, class scores...) from a flat output whose channels come one after another."""
    row = lambda i: F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.get(output, (c * count + i).cast("int")).cast("double"))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), row)


def detected(rows: Column, width: Column, height: Column, size: int = 640, least: float = CONFIDENCE, overlap: float = IOU) -> Column:
    """What a detector found in a frame, array<FOUND>, from its predictions on the padded square input: boxes of usable
    scores, moved into the frame, clipped to it, as corners, best first, those that overlap a better one left out."""
    found = F.filter(F.transform(rows, lambda r: decode(r, least)), lambda d: d.isNotNull())
    place = lambda d: geometry.corners(geometry.clip_box(geometry.unletterbox(d["box"], width, height, size, size), width.cast("int"), height.cast("int")))
    placed = F.transform(found, lambda d: F.struct(place(d).alias("box"), d["class"].alias("class"), d["score"].alias("score")))
    return suppress(placed, FOUND, overlap, least, sized=True)


def open_vocabulary(found: Column) -> Column:
    """Of array<struct<box, class, score>>: classes and scores that aren't negative, scores from 0.05 to below 1."""
    return F.filter(found, lambda d: (d["class"] >= 0) & (d["score"] >= 0.05) & (d["score"] < 1))


def open_vocabulary_boxes(found: Column, width: Column, height: Column, size: int = 640) -> Column:
    """open_vocabulary(), boxes (two corners) moved from the padded square input into the frame."""
    place = lambda d: geometry.unletterbox(d["box"], width, height, size, size, corners=True)
    return F.transform(open_vocabulary(found), lambda d: F.struct(place(d).alias("box"), d["class"].alias("class"), d["score"].alias("score")))


def label(number: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """Null outside the list."""
    return F.get(F.array(*[F.lit(x) for x in labels]), number)


def packed(rows: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """Rows of (x1, y1, x2, y2, score, class) as bboxes, scores, labels."""
    return F.struct(
        F.transform(rows, lambda r: F.slice(r, 1, 4)).alias("bboxes"),
        F.transform(rows, lambda r: r[4]).alias("scores"),
        F.transform(rows, lambda r: label(r[5].cast("int"), labels)).alias("labels"),
    )


def trackable(box: Column, score: Column) -> Column:
    """points and scores of a box, one score for each corner."""
    return F.struct(F.array(F.array(box[0], box[1]), F.array(box[2], box[3])).alias("points"), F.array(score, score).alias("scores"))


def pose(row: Column, width: Column, height: Column, points: int = 17) -> Column:
    """3 numbers (y, x, score) for each point, then ymin, xmin, ymax, xmax, score: in pixels of the frame."""
    at = lambda i: F.get(row, i).cast("double")
    point = lambda i: F.struct((at(i * 3) * height).alias("y"), (at(i * 3 + 1) * width).alias("x"), at(i * 3 + 2).alias("score"))
    n = points * 3
    box = F.array(at(F.lit(n)) * height, at(F.lit(n + 1)) * width, at(F.lit(n + 2)) * height, at(F.lit(n + 3)) * width)
    return F.struct(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), point).alias("points"), box.alias("box"), at(F.lit(n + 4)).alias("score"))
