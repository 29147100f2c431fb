"""Per-stream sequence operators in batch form: numbering, durations, gaps, shedding, latches, key-value state.

A stream's frames are a sequence. They are sorted within stretches of a stream, by time or by BLOCK frame numbers, that run
apart; what the rest of the stream has to say about a stretch comes from one aggregated row a stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import schemas
from strandline.functions.media import millis

# What an event type of the sample table stands for on the bus.
BUS_KIND = {"view": schemas.FRAME_KIND, "click": schemas.FRAME_KIND, "signup": schemas.CAPS, "purchase": schemas.END_OF_INPUT, "error": schemas.INPUT_ERROR}
BLOCK = 1 << 16  # frame numbers of a stretch; it changes the work, not the result
ACTIONS = {
    schemas.FRAME_KIND: "process_frame", schemas.TAGS: "update_tags", schemas.CAPS: "create_output", schemas.END_OF_INPUT: "drain",
    schemas.END_OF_OUTPUT: "finish_completed", schemas.INPUT_ERROR: "finish_error", schemas.OUTPUT_ERROR: "finish_error",
}


def lookup(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def from_events(events: DataFrame) -> DataFrame:
    """Bus rows of an event table: a stream for each user, numbered from 1 in order of time, kind by event type."""
    numbered = spread_fold(events.select("user_id", "event_id", "ts", "event_type", "value", "props"), "user_id", ["ts", "event_id"], F.to_date("ts"), {"frame_number": F.lit(1)})
    return numbered.select(F.col("user_id").alias("pipeline_id"), "frame_number", "event_id", "ts", millis(F.col("ts")).alias("pts"), lookup(F.col("event_type"), BUS_KIND).alias("kind"), "event_type", "value", F.col("props").alias("user_data"))


def block() -> Column:
    return F.expr(f"frame_number div {BLOCK}")


def in_block() -> Window:
    return Window.partitionBy("pipeline_id", "_bucket").orderBy("frame_number")


def with_neighbours(rows: DataFrame, key: str, bucket: Column, of_bucket: dict[str, Column], of_stream: dict[str, Column]) -> DataFrame:
    """Rows with their _bucket and what other buckets of the stream tell them.

    of_bucket: aggregates of a bucket; of_stream: window expressions over a stream's buckets, one row each. Rows without a
    key are a stream too, and rows without a bucket its first bucket.
    """
    cut = rows.withColumn("_bucket", bucket)
    told = cut.groupBy(key, "_bucket").agg(*[v.alias(n) for n, v in of_bucket.items()]).select(F.col(key).alias("_key"), F.col("_bucket").alias("_of"), *[v.alias(n) for n, v in of_stream.items()])
    joined = cut.join(told, cut[key].eqNullSafe(F.col("_key")) & cut["_bucket"].eqNullSafe(F.col("_of")))
    return joined.drop("_key", "_of")


def with_duration(frames: DataFrame) -> DataFrame:
    """duration_us to the next frame of the stream; null for the last."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    later = F.lead("_start").over(Window.partitionBy("pipeline_id").orderBy("_bucket"))
    cut = with_neighbours(frames, "pipeline_id", block(), {"_start": F.min_by(F.struct(micros.alias("at")), "frame_number")}, {"_later": later})
    following = F.coalesce(F.lead(F.struct(micros.alias("at"))).over(in_block()), F.col("_later"))["at"]
    return cut.withColumn("duration_us", following - micros).drop("_bucket", "_later")


def shed(rows: DataFrame, capacity: int, bucket: Column) -> DataFrame:
    """What a buffer of `capacity` frames lets through of each stream and bucket: the newest frames are dropped, control rows never."""
    is_frame = (F.col("kind") == schemas.FRAME_KIND).cast("int")
    slot = Window.partitionBy("pipeline_id", bucket).orderBy("frame_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumn("_slot", F.sum(is_frame).over(slot))
    return held.where((F.col("kind") != schemas.FRAME_KIND) | (F.col("_slot") <= capacity)).drop("_slot")


def gaps(rows: DataFrame) -> DataFrame:
    """missing: how many numbers were dropped just before each row."""
    before = Window.partitionBy("pipeline_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = with_neighbours(rows, "pipeline_id", block(), {"_last": F.max("frame_number")}, {"_before": F.max("_last").over(before)})
    previous = F.coalesce(F.lag("frame_number").over(in_block()), "_before", F.lit(0))
    return cut.withColumn("missing", F.col("frame_number") - previous - 1).drop("_bucket", "_before")


def frontier(rows: DataFrame) -> DataFrame:
    """Rows whose predecessors are all there."""
    counted = spread_fold(rows, "pipeline_id", ["frame_number"], block(), {"_n": F.lit(1)})
    return counted.where(F.col("_n") == F.col("frame_number")).drop("_n")


def latched(rows: DataFrame) -> DataFrame:
    """Frames of each stream that stand after its first capabilities row."""
    first = rows.where(F.col("kind") == schemas.CAPS).groupBy(F.col("pipeline_id").alias("_key")).agg(F.min("frame_number").alias("_first"))
    frames = rows.where(F.col("kind") == schemas.FRAME_KIND)
    return frames.join(first, frames["pipeline_id"].eqNullSafe(F.col("_key")) & (frames["frame_number"] > F.col("_first"))).drop("_key", "_first")


def running(rows: DataFrame, folds: dict[str, Column]) -> DataFrame:
    """Ordered folds of each stream: running sums (name: value)."""
    return spread_fold(rows, "pipeline_id", ["frame_number"], block(), folds)


def last_write(rows: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """The last value of each key: what a key-value store holds in the end. Partial maxima before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def store_key(pipeline: Column, stage: Column, key: Column) -> Column:
    """Keys are scoped to a stream and a stage."""
    return F.concat_ws(":", pipeline.cast("string"), stage, key)


def without_streams(store: DataFrame, finished: DataFrame) -> DataFrame:
    """A store (key, value) without the keys of finished streams (pipeline_id)."""
    scope = F.substring_index("key", ":", 1)
    gone = finished.select(F.col("pipeline_id").cast("string").alias("_gone")).distinct()
    return store.join(gone, scope == F.col("_gone"), "left_anti")


def first_caps(rows: DataFrame) -> DataFrame:
    """The first capabilities row of each stream."""
    return rows.where(F.col("kind") == schemas.CAPS).groupBy("pipeline_id").agg(F.min_by("frame_number", "frame_number").alias("frame_number"), F.min_by("value", "frame_number").alias("value"))


def spread_fold(rows: DataFrame, key: str, order: list[str], bucket: Column, folds: dict[str, Column]) -> DataFrame:
    """Running sums (name: value) of each stream for streams too large for one task; null before a stream's first value.

    bucket rises with the order, so a stream is a sequence of buckets: sums run within a bucket, and start from the total
    of the stream's earlier buckets. The totals are one row a stream and bucket, added up before they are shuffled.
    """
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = with_neighbours(rows, key, bucket, {f"_total_{n}": F.sum(v) for n, v in folds.items()}, {f"_from_{n}": F.sum(f"_total_{n}").over(earlier) for n in folds})
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns({f"_sum_{n}": F.sum(v).over(inside) for n, v in folds.items()})
    start, here = ({n: F.col(f"_{part}_{n}") for n in folds} for part in ("from", "sum"))
    return local.select(*rows.columns, *[F.coalesce(start[n] + here[n], here[n], start[n]).alias(n) for n in folds])
