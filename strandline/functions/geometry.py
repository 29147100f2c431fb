"""Arithmetic of frame sizes, points and boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(x: Column) -> Column:
    """Cut off towards zero."""
    return x.cast("int")


def letterbox(width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """scale, width, height, left, top of a frame fitted into a target; odd padding loses a pixel."""
    scale = F.least(to_width / width.cast("double"), to_height / height.cast("double"))
    w, h = _int(width * scale), _int(height * scale)
    return F.struct(scale.alias("scale"), w.alias("width"), h.alias("height"), _int(F.floor((to_width - w) / 2)).alias("left"), _int(F.floor((to_height - h) / 2)).alias("top"))


def fit_width(width: Column, height: Column, to_width: int = 600) -> Column:
    """width, height at a fixed width and the same aspect."""
    return F.struct(F.lit(to_width).alias("width"), _int(to_width / (width / height)).alias("height"))


def centre_pad(width: Column, height: Column, to: int = 224) -> Column:
    """Padding around a smaller frame; the odd pixel goes to the bottom and the right."""
    top, left = _int(F.floor((to - height) / 2)), _int(F.floor((to - width) / 2))
    return F.struct(top.alias("top"), (to - height - top).cast("int").alias("bottom"), left.alias("left"), (to - width - left).cast("int").alias("right"))


def ceil_to(value: Column, step: int = 32) -> Column:
    return (F.ceil(value / step) * step).cast("int")


def fit_longer(width: Column, height: Column, to: int = 256, step: int = 32) -> Column:
    """Frame scaled until its longer side is `to` (the other rounded up), and the input size padded to a multiple of step."""
    tall = height > width
    w = F.when(tall, F.ceil(width * (F.lit(float(to)) / height))).otherwise(to).cast("int")
    h = F.when(tall, to).otherwise(F.ceil(height * (F.lit(float(to)) / width))).cast("int")
    padded = lambda v: ceil_to(v, step)
    return F.struct(w.alias("width"), h.alias("height"), F.when(tall, padded(w)).otherwise(to).alias("input_width"), F.when(tall, to).otherwise(padded(h)).alias("input_height"))


def unletterbox(box: Column, width: Column, height: Column, from_width: int = 640, from_height: int = 640, corners: bool = False) -> Column:
    """A box of a padded square input in the frame: (x, y, w, h) as left, top, width, height, or two corners as two corners."""
    tall = height > width
    factor = F.when(tall, height / F.lit(float(from_height))).otherwise(width / F.lit(float(from_width)))
    pad = F.when(tall, F.floor((from_width - width / factor) / 2)).otherwise(F.floor((from_height - height / factor) / 2))
    x_pad, y_pad = F.when(tall, pad).otherwise(0), F.when(tall, 0).otherwise(pad)
    second = (box[2] - x_pad, box[3] - y_pad) if corners else (box[2], box[3])
    return F.array(*[_int(v * factor) for v in (box[0] - x_pad, box[1] - y_pad, *second)])


def rescale(box: Column, fx: Column, fy: Column) -> Column:
    """A box in a reduced frame, in the original."""
    return F.array(_int(box[0] * fx), _int(box[1] * fy), _int(box[2] * fx), _int(box[3] * fy))


def clip_box(box: Column, width: Column, height: Column) -> Column:
    """All four numbers limited to the frame: of a box with a width and a height, these too."""
    limit = lambda v, most: F.greatest(F.least(v, most), F.lit(0))
    return F.array(limit(box[0], width), limit(box[1], height), limit(box[2], width), limit(box[3], height))


def corners(box: Column) -> Column:
    """(x, y, w, h) as two corners: the first is moved back by half the size, the second stands a size from the first."""
    x, y = _int(box[0] - box[2] / 2), _int(box[1] - box[3] / 2)
    return F.array(x, y, _int(x + box[2]), _int(y + box[3]))


def angle(dx: Column, dy: Column) -> Column:
    """Of a direction, from 0 to 2 pi."""
    a = F.atan2(dy, dx)
    return F.when(a < 0, a + 2 * math.pi).otherwise(a)


def sector(a: Column) -> Column:
    """1 to 7 for the eighths around pi/4, pi/2, ... 7 pi/4; null on bounds and around 0, which no test holds for."""
    out = F.lit(None).cast("int")
    for k in range(7, 0, -1):
        out = F.when((a > (2 * k - 1) * math.pi / 8) & (a < (2 * k + 1) * math.pi / 8), F.lit(k)).otherwise(out)
    return out


def outside_circle(x: Column, y: Column, cx: Column, cy: Column, radius: float = 20.0) -> Column:
    return F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) > radius


def mirror(x: Column, width: Column) -> Column:
    return width - x - 1


def pixel(u: Column, v: Column, width: Column, height: Column) -> Column:
    """Normalised coordinates in pixels."""
    return F.struct(_int(u * width).alias("x"), _int(v * height).alias("y"))


def rays(cx: Column, cy: Column, length: Column) -> Column:
    """Ends of eight rays, from pi/8 in steps of pi/4."""
    return F.array(*[F.struct(_int(cx + length * math.cos(math.pi / 8 + k * math.pi / 4)).alias("x"), _int(cy + length * math.sin(math.pi / 8 + k * math.pi / 4)).alias("y")) for k in range(8)])


def tone(frequency: Column, rate: Column, fps: Column) -> Column:
    """Samples (16 bits) of a sine at half volume over one frame; a part of a sample counts as one."""
    n = F.ceil(rate / fps).cast("int")
    wave = lambda i: (F.sin(frequency * i / rate * (2 * math.pi)) * 0.5 * 32767).cast("smallint")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), wave)).otherwise(F.array().cast("array<smallint>"))


def line_width(width: Column, height: Column, channels: int = 3) -> Column:
    """Of a drawn box; half rounds to even."""
    return F.greatest(F.bround((height + width + channels) / 2 * 0.003, 0).cast("int"), F.lit(2))
