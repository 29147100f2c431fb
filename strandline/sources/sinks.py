"""Sinks: by a stream's output URI, and exporters of lifecycle events."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from strandline import schemas
from strandline.functions.media import size_error

log = logging.getLogger(__name__)
Writer = Callable[[DataFrame, int], None]
#: Writers of network outputs by protocol: register(protocol, writer of a micro-batch).
_network: dict[str, Writer] = {}


def register(protocol: str, writer: Writer) -> None:
    _network[protocol] = writer


def emittable(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames that fit their stream's buffer, in columns for output; and error rows for those that don't."""
    error = size_error(F.length("modified"), F.col("width"), F.col("height"))
    good = frames.where(error.isNull()).select("pipeline_id", "frame_number", "pts", "dts", "duration", "width", "height", "modified")
    bad = frames.where(error.isNotNull()).select("pipeline_id", "frame_number", F.lit(schemas.OUTPUT_ERROR).alias("kind"), error.alias("message"))
    return good, bad


def write_frames(frames: DataFrame, path: str, batch: int = 0) -> None:
    """Parquet of raw frames, laid out by micro-batch and stream and sorted by frame number within files. A batch that is
    run again takes the place of its first run."""
    good = emittable(frames)[0].repartition("pipeline_id").sortWithinPartitions("pipeline_id", "frame_number")
    good.write.mode("overwrite").partitionBy("pipeline_id").parquet(f"{path}/batch={batch}")


def stream_to(frames: DataFrame, output_uri: str | None) -> DataStreamWriter:
    """The writer for an output: none (noop), screen (console), a file's folder (Parquet), or a registered protocol."""
    if not output_uri:
        return frames.writeStream.format("noop")
    protocol, _, rest = output_uri.partition("://")
    if output_uri == "screen":
        return frames.drop("original", "modified").writeStream.format("console")
    if protocol == "file":
        if not output_uri.endswith(".mp4"):
            raise ValueError(f"unsupported file type: {output_uri}")
        return frames.writeStream.foreachBatch(lambda d, i: write_frames(d, rest, i))
    if protocol in _network:
        return frames.writeStream.foreachBatch(_network[protocol])
    raise ValueError(f"unsupported output: {output_uri}")


def exporter(send: Callable[[str], None] | None) -> Callable[[dict], None]:
    """Events as JSON text to send(); a failure is only logged. Without send, nothing happens."""

    def export(event: dict) -> None:
        if send is None:
            return
        try:
            send(json.dumps(event))
        except Exception as e:
            log.warning("event not exported: %s", e)

    return export
