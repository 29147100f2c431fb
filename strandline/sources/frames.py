"""A Python data source of frames: synthetic streams, or folders of raw RGB frames, in batch and streaming."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from strandline.schemas import FRAME


class Range(InputPartition):
    """Frames first..last of a stream."""

    def __init__(self, stream: int, first: int, last: int) -> None:
        super().__init__((stream, first, last))
        self.stream, self.first, self.last = stream, first, last


def synthetic(stream: int, number: int, width: int, height: int) -> bytes:
    """Pixels that follow from the stream and the frame number alone."""
    y, x, c = np.ogrid[:height, :width, :3]
    return ((x * 7 + y * 13 + c * 29 + number * 3 + stream * 11) % 256).astype(np.uint8).tobytes()


class _Frames:
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.streams, self.count = int(options.get("streams", 1)), int(options.get("frames", 10))
        self.width, self.height = int(options.get("width", 4)), int(options.get("height", 3))
        self.num, self.den = (int(v) for v in options.get("framerate", "30/1").split("/"))
        self.folder = options.get("path")
        self.chunk = int(options.get("framesPerPartition", 1000))
        if options.get("device", "").count(":") > 1:
            raise ValueError("more than one device")

    def rows(self, part: Range) -> Iterator[tuple]:
        step = 1000 * self.den / self.num
        for n in range(part.first, part.last + 1):
            if self.folder:
                with open(os.path.join(self.folder, str(part.stream), f"{n}.rgb"), "rb") as file:
                    pixels = file.read()
            else:
                pixels = synthetic(part.stream, n, self.width, self.height)
            pipeline = str(uuid.uuid5(uuid.NAMESPACE_OID, f"stream {part.stream}"))
            pts = int((n - 1) * step)
            yield (str(uuid.uuid5(uuid.NAMESPACE_OID, f"{pipeline} {n}")), pixels, pixels, [self.height, self.width, 3], self.width, self.height, pts, 0, int(step),
                   self.num // self.den % 256, pts / 1000, None, None, pipeline, None, n)

    def ranges(self, first: int, last: int) -> list[Range]:
        return [Range(s, a, min(a + self.chunk - 1, last)) for s in range(self.streams) for a in range(first, last + 1, self.chunk)]


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.frames = _Frames(options)

    def partitions(self) -> list[Range]:
        return self.frames.ranges(1, self.frames.count)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.frames.rows(partition)


class _Stream(DataSourceStreamReader):
    """Each trigger reads up to maxFramesPerTrigger frames of every stream: back-pressure without loss."""

    def __init__(self, options: dict[str, str]) -> None:
        self.frames = _Frames(options)
        self.most = int(options.get("maxFramesPerTrigger", 240))
        self.at = 0

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.frames.count, self.at + self.most)
        return {"frame": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = max(self.at, end["frame"])
        return self.frames.ranges(start["frame"] + 1, end["frame"])

    def commit(self, end: dict) -> None:
        """Nothing to free."""

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.frames.rows(partition)


class FrameSource(DataSource):
    """format("frames"): options streams, frames, width, height, framerate, path, framesPerPartition, maxFramesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> StructType:
        return FRAME

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(dict(self.options))
