"""Ordered and keyed state, in Structured Streaming and in batch.

A streaming query gets a stream's rows in any order and keeps its state between batches. A batch query lets Spark sort the
rows, and a task reads them one Arrow batch at a time with the state of one stream, however long that stream is.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from heapq import heapify, heappop
from math import nan

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandline.operators.tracking import Tracker

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Frames of a stream in the order of their numbers, whatever the order they come in.

    Frames that come early wait in state until their predecessors are there; once `patience` of them wait, the gap in
    front counts as lost and is skipped. A frame that comes after its number was passed is dropped. The running count and
    sum of released frames are the state that a hook would keep.
    """

    def __init__(self, patience: int = 240) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next long, n long, total double")
        self.waiting = handle.getMapState("waiting", "frame_number long", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        following, n, total = self.at.get() or (1, 0, 0.0)
        waiting = {k[0]: v[0] for k, v in self.waiting.iterator()}
        before = set(waiting)
        for batch in rows:
            waiting.update({int(k): float(v) for k, v in zip(batch["frame_number"], batch["value"], strict=True) if k >= following})
        out, numbers = [], list(waiting)
        heapify(numbers)
        while numbers and (numbers[0] == following or len(numbers) > self.patience):
            following = heappop(numbers)
            total += waiting.pop(following)
            n += 1
            out.append((key[0], following, n, total))
            following += 1
        for number in before - waiting.keys():
            self.waiting.removeKey((number,))
        for number in waiting.keys() - before:
            self.waiting.updateValue((number,), (waiting[number],))
        self.at.update((following, n, total))
        yield pd.DataFrame(out, columns=["pipeline_id", "frame_number", "n", "total"])

    def close(self) -> None:
        """Nothing is open."""


class KeyValue(StatefulProcessor):
    """Rows (pipeline_id, op, key, value): set keeps a value, get answers the last one ("" if none), end clears the stream's keys."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "key string", "value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        out = []
        whole = pd.concat(list(rows)).sort_values("seq")  # a stream's rows come in several chunks, in any order
        for seq, op, name, value in whole[["seq", "op", "key", "value"]].itertuples(index=False):
            if op == "set":
                self.values.updateValue((name,), (str(value),))
            elif op == "get":
                found = self.values.getValue((name,)) if self.values.containsKey((name,)) else None
                out.append((key[0], int(seq), name, found[0] if found else ""))
            elif op == "end":
                self.values.clear()
        yield pd.DataFrame(out, columns=["pipeline_id", "seq", "key", "value"])

    def close(self) -> None:
        """Nothing is open."""


class Tracks(StatefulProcessor):
    """Track numbers for the points of each frame, from a tracker kept for each stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tracks", "following long, ids array<long>, xs array<double>, ys array<double>, ages array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        tracker = Tracker()
        if known:
            tracker = Tracker(tracks={i: [x, y, a] for i, x, y, a in zip(*known[1:], strict=True)}, following=known[0])
        frames = pd.concat(list(rows)).sort_values("frame_number")
        out = [(key[0], int(n), tracker.update([(float(p[0]), float(p[1])) for p in points])) for n, points in zip(frames["frame_number"], frames["points"], strict=True)]
        items = sorted(tracker.tracks.items())
        self.state.update((tracker.following, [k for k, _ in items], [t[0] for _, t in items], [t[1] for _, t in items], [t[2] for _, t in items]))
        yield pd.DataFrame(out, columns=["pipeline_id", "frame_number", "track_ids"])

    def close(self) -> None:
        """Nothing is open."""


def _totals(patience: int) -> Callable[[dict], list[dict]]:
    """What Ordered does, for rows of one stream in order: at most patience + 1 of them wait."""
    queue: deque[tuple[int, float]] = deque()
    following, n, total = 1, 0, 0.0

    def step(row: dict) -> list[dict]:
        nonlocal following, n, total
        number, value, out = row["frame_number"], nan if row["value"] is None else float(row["value"]), []
        if number < following:
            return out
        if queue and queue[-1][0] == number:
            queue.pop()
        queue.append((number, value))
        while queue and (queue[0][0] == following or len(queue) > patience):
            at, value = queue.popleft()
            following, n, total = at + 1, n + 1, total + value
            out.append({"pipeline_id": row["pipeline_id"], "frame_number": at, "n": n, "total": total})
        return out

    return step


def _answers() -> Callable[[dict], list[dict]]:
    """What KeyValue does, for rows of one stream in order."""
    values: dict[str, str] = {}

    def step(row: dict) -> list[dict]:
        if row["op"] == "set":
            values[row["key"]] = str(row["value"])
        elif row["op"] == "end":
            values.clear()
        return [{**row, "value": values.get(row["key"], "")}] if row["op"] == "get" else []

    return step


def _track_ids() -> Callable[[dict], list[dict]]:
    """What Tracks does, for rows of one stream in order."""
    tracker = Tracker()
    return lambda row: [{**row, "track_ids": tracker.update([(float(p[0]), float(p[1])) for p in row["points"] or []])}]


def _in_order(df: DataFrame, order: str, start: Callable[[], Callable[[dict], list[dict]]], columns: dict[str, pa.DataType], schema: str) -> DataFrame:
    """start() gives each stream its step, which is called with the stream's rows in order and returns rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, step = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if step is None or row["pipeline_id"] != stream:
                    stream, step = row["pipeline_id"], start()
                out += step(row)
            kinds = [("pipeline_id", batch.schema.field("pipeline_id").type), *columns.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[name] for r in out], kind) for name, kind in kinds], [name for name, _ in kinds])

    return df.repartition("pipeline_id").sortWithinPartitions("pipeline_id", order).mapInArrow(run, schema)


def _with_state(df: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    """Needs the RocksDB state store."""
    df.sparkSession.conf.set(STATE_STORE, ROCKS)
    return df.groupBy("pipeline_id").transformWithStateInPandas(processor, outputStructType=schema, outputMode="append", timeMode="none")


def ordered_totals(frames: DataFrame, patience: int = 240) -> DataFrame:
    """pipeline_id, frame_number, n, total from rows (pipeline_id, frame_number, value) in any order."""
    rows = frames.select("pipeline_id", "frame_number", "value")
    schema = f"pipeline_id {rows.schema['pipeline_id'].dataType.simpleString()}, frame_number long, n long, total double"
    if frames.isStreaming:
        return _with_state(rows, Ordered(patience), schema)
    return _in_order(rows, "frame_number", lambda: _totals(patience), {"frame_number": pa.int64(), "n": pa.int64(), "total": pa.float64()}, schema)


def key_values(requests: DataFrame) -> DataFrame:
    """Answers to the get rows of (pipeline_id, seq, op, key, value)."""
    rows = requests.select("pipeline_id", "seq", "op", "key", "value")
    schema = f"pipeline_id {rows.schema['pipeline_id'].dataType.simpleString()}, seq long, key string, value string"
    if requests.isStreaming:
        return _with_state(rows, KeyValue(), schema)
    return _in_order(rows, "seq", _answers, {"seq": pa.int64(), "key": pa.string(), "value": pa.string()}, schema)


def tracks(frames: DataFrame) -> DataFrame:
    """pipeline_id, frame_number, track_ids from rows (pipeline_id, frame_number, points array<array<double>>)."""
    rows = frames.select("pipeline_id", "frame_number", "points")
    schema = f"pipeline_id {rows.schema['pipeline_id'].dataType.simpleString()}, frame_number long, track_ids array<long>"
    if frames.isStreaming:
        return _with_state(rows, Tracks(), schema)
    return _in_order(rows, "frame_number", _track_ids, {"frame_number": pa.int64(), "track_ids": pa.list_(pa.int64())}, schema)


def windowed_counts(frames: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Frames a window and stream, with a watermark: rows later than `late` are dropped."""
    timed = frames.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", length), "pipeline_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "pipeline_id", "n")
