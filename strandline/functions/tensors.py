"""Dense arrays within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(a: Column, by: float = 255.0) -> Column:
    return F.transform(a, lambda x: x.cast("double") / by)


def clip(a: Column, low: float, high: float) -> Column:
    return F.transform(a, lambda x: F.greatest(F.least(x.cast("double"), F.lit(high)), F.lit(low)))


def hwc_to_chw(a: Column, height: int, width: int, channels: int) -> Column:
    """Index permutation of a flat array."""
    plane = height * width
    return F.transform(F.sequence(F.lit(0), F.lit(plane * channels - 1)), lambda i: F.get(a, ((i % plane) * channels + F.floor(i / plane)).cast("int")))


def chw_to_hwc(a: Column, channels: int, height: int, width: int) -> Column:
    plane = height * width
    return F.transform(F.sequence(F.lit(0), F.lit(plane * channels - 1)), lambda i: F.get(a, ((i % channels) * plane + F.floor(i / channels)).cast("int")))


def transpose(a: Column, rows: int, columns: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), lambda i: F.get(a, ((i % rows) * columns + F.floor(i / rows)).cast("int")))


def padded(a: Column, height: int, width: int, channels: int, to_height: int, to_width: int, fill: float = 128) -> Column:
    """A flat image in the middle of a larger one; the odd row and column of the padding go to the bottom and the right."""
    top, left = (to_height - height) // 2, (to_width - width) // 2

    def at(i: Column) -> Column:
        y, x = F.floor(i / (to_width * channels)) - top, F.floor(i / channels) % to_width - left
        inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
        return F.when(inside, F.get(a, ((y * width + x) * channels + i % channels).cast("int")).cast("double")).otherwise(float(fill))

    return F.transform(F.sequence(F.lit(0), F.lit(to_height * to_width * channels - 1)), at)


def input_tensor(a: Column, height: int, width: int, channels: int, to_height: int, to_width: int, fill: float = 128, by: float = 255.0) -> Column:
    """A flat image as a model's input: padded, scaled, channels first."""
    whole = normalize(padded(a, height, width, channels, to_height, to_width, fill), by)
    return F.get(F.transform(F.array(whole), lambda x: tensor(hwc_to_chw(x, to_height, to_width, channels), channels, to_height, to_width)), F.lit(0))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as SQL engines do: the double x * 10^digits to the nearest whole number, halves away from zero.

    Spark's round() works on the decimal digits of x instead and gives 0.0 for small negative numbers, here -0.0.
    """
    by = F.lit(10.0**digits)
    size = F.round(F.abs(x) * by) / by
    return F.when(size < float("inf"), F.signum(x) * size).otherwise(x)


def argmax(a: Column) -> Column:
    """Place of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def has_nan(a: Column) -> Column:
    return F.exists(a, lambda x: F.isnan(x))


def has_one(a: Column) -> Column:
    """A score of exactly 1 marks a bad prediction."""
    return F.exists(a, lambda x: x == 1)


def bgr_to_rgb(a: Column) -> Column:
    """Swap the outer channels of a flat array of pixels."""
    return F.transform(a, lambda x, i: F.get(a, (i + F.when(i % 3 == 0, 2).when(i % 3 == 2, -2).otherwise(0)).cast("int")))


def tensor(data: Column, *shape: int) -> Column:
    return F.struct(F.array(*[F.lit(n) for n in shape]).alias("shape"), data.cast("array<float>").alias("data"))
