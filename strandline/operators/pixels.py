"""Pixel work that no column function can do, on RGB bytes in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Paint = Callable[[np.ndarray, dict], np.ndarray | None]


def paint(df: DataFrame, change: Paint, source: str = "modified") -> DataFrame:
    """Apply change(pixels, row) to height x width x 3 pixels of each row; it may return an array of another size.

    Only `modified` and its shape change, never `original`. Rows without pixels stay.
    """
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.to_dict("records")
            for row in rows:
                if row.get(source) is None:
                    continue
                shape = row.get("modified_shape") if source == "modified" else None
                shape = (row["height"], row["width"], 3) if shape is None or not len(shape) else tuple(int(n) for n in shape)
                pixels = np.frombuffer(row[source], np.uint8).reshape(shape).copy()
                out = change(pixels, row)
                out = pixels if out is None else out
                row["modified"], row["modified_shape"] = out.astype(np.uint8).tobytes(), list(out.shape)
            yield pd.DataFrame([[r[n] for n in names] for r in rows], columns=names, dtype=object)

    return df.mapInPandas(run, df.schema)


def rectangle(pixels: np.ndarray, box: tuple[int, int, int, int], colour: tuple[int, int, int], width: int = 2) -> None:
    """The outline of a box given by corners; what lies outside the frame isn't drawn."""
    h, w = pixels.shape[:2]
    x1, y1, x2, y2 = box
    half = width // 2
    for low, high, vertical in ((x1, x1, True), (x2, x2, True), (y1, y1, False), (y2, y2, False)):
        a, b = low - half, high - half + width
        if vertical:
            pixels[max(0, y1 - half) : max(0, min(h, y2 + half + 1)), max(0, a) : max(0, min(w, b))] = colour
        else:
            pixels[max(0, a) : max(0, min(h, b)), max(0, x1 - half) : max(0, min(w, x2 + half + 1))] = colour


def line(pixels: np.ndarray, a: tuple[int, int], b: tuple[int, int], colour: tuple[int, int, int]) -> None:
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1])) + 1
    xs, ys = np.linspace(a[0], b[0], n).round().astype(int), np.linspace(a[1], b[1], n).round().astype(int)
    ok = (xs >= 0) & (ys >= 0) & (xs < pixels.shape[1]) & (ys < pixels.shape[0])
    pixels[ys[ok], xs[ok]] = colour


def point(pixels: np.ndarray, at: tuple[int, int], colour: tuple[int, int, int], radius: int = 2) -> None:
    h, w = pixels.shape[:2]
    y, x = np.ogrid[:h, :w]
    pixels[(x - at[0]) ** 2 + (y - at[1]) ** 2 <= radius * radius] = colour


def stamp(mark: np.ndarray, at: tuple[int, int] = (800, 600)) -> Paint:
    """A watermark: the pixels of mark put at a fixed place (x, y), as far as they fit."""

    def change(pixels: np.ndarray, row: dict) -> None:
        x, y = at
        part = mark[: max(0, pixels.shape[0] - y), : max(0, pixels.shape[1] - x)]
        if part.size:
            pixels[y : y + part.shape[0], x : x + part.shape[1]] = part

    return change


def draw_boxes(field: str = "bboxes", colour: tuple[int, int, int] = (255, 0, 255)) -> Paint:
    """Outlines of the boxes in a column; the line is as wide as functions.geometry.line_width says."""

    def change(pixels: np.ndarray, row: dict) -> None:
        width = max(round(sum(pixels.shape) / 2 * 0.003), 2)
        for box in row[field] if row[field] is not None else ():
            rectangle(pixels, tuple(int(v) for v in box[:4]), colour, width)

    return change
