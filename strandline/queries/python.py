"""Queries that need Python workers, models, pixels or streaming state."""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import detections, tensors
from strandline.operators import inference, pixels, tracking
from strandline.plans.path import PROCESS, Hook, Registry, Stage, execute
from strandline.queries import query, table
from strandline.queries.sequences import FRAMES, SHED, bus, kept
from strandline.sources.frames import FrameSource
from strandline.streaming import ordered

CLASSES = 10


def weights() -> np.ndarray:
    """64 x 10: class c sums the components whose number ends in c."""
    return (np.arange(64)[:, None] % CLASSES == np.arange(CLASSES)).astype(np.float32)


@query(f"""SELECT vec_id, list_transform(range({CLASSES}), lambda c: round(list_sum(list_transform(list_filter(range(64), lambda i: i % {CLASSES} = c), lambda i: CAST(embedding[CAST(i + 1 AS INTEGER)] AS DOUBLE))), 3) + 0.0) AS scores FROM embeddings""")
def onnx_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear model of 64 numbers to 10 scores, run by onnxruntime in batches, in doubles as the SQL's sums."""
    path = os.path.join(tempfile.mkdtemp(), "strandline-linear.onnx")
    with open(path, "wb") as file:
        file.write(inference.linear_model(weights().astype(np.float64)))
    spec = inference.publish(spark, inference.InferenceSpec.parse({"runtime": "onnx", "model_uri": "file://" + path, "inference_params": {"execution_provider": "cpu", "output_type": "double"}}))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", tensors.tensor(F.col("embedding"), 64).alias("inference_input"))
    scores = F.transform(F.element_at("inference_output", F.lit("y"))["data"], lambda x: tensors.rounded(x, 3) + 0.0)
    return inference.infer(rows, spec).select("vec_id", scores.alias("scores"))


@query(f"""SELECT vec_id AS frame_number, list_transform(range({CLASSES}), lambda c: round(list_sum(list_transform(list_filter(range(64), lambda i: i % {CLASSES} = c), lambda i: CAST(embedding[CAST(i + 1 AS INTEGER)] AS DOUBLE))), 3) + 0.0) AS scores,
  [1, {CLASSES}] AS shape FROM embeddings WHERE vec_id % 3 > 0""")
def declared_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage folder that declares its model in JSON, run from its path: frames without input get no output."""
    folder = tempfile.mkdtemp()
    os.mkdir(os.path.join(folder, "score"))
    model = os.path.join(folder, "strandline-declared.onnx")
    with open(model, "wb") as file:
        file.write(inference.linear_model(weights().astype(np.float64)))
    with open(os.path.join(folder, "score", "process.json"), "w") as file:
        json.dump({"runtime": "onnx", "model_uri": "file://" + model, "inference_params": {"execution_provider": "cpu", "output_type": "double"}, "make_stateful": True}, file)
    stages = Registry.from_dir(folder)
    tensor = F.when(F.col("vec_id") % 3 > 0, tensors.tensor(F.col("embedding"), 64))
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 7).alias("pipeline_id"), F.col("vec_id").alias("frame_number"), tensor.alias("inference_input"))
    y = F.element_at("inference_output", F.lit("y"))
    return execute(rows, stages.path("score"), stages).where("inference_output IS NOT NULL").select("frame_number", F.transform(y["data"], lambda x: tensors.rounded(x, 3) + 0.0).alias("scores"), y["shape"].alias("shape"))


@query(f"{SHED} SELECT pipeline_id, frame_number, CAST(count(*) OVER w AS BIGINT) AS n, round(sum(value) OVER w, 4) AS total FROM kept WINDOW w AS (PARTITION BY pipeline_id ORDER BY frame_number ROWS UNBOUNDED PRECEDING)")
def ordered_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming processor in batch: the state of each stream over the frames that came through, gaps skipped."""
    rows = kept(spark, sf_dir).select("pipeline_id", "frame_number", "value")
    return ordered.ordered_totals(rows, patience=0).select("pipeline_id", "frame_number", "n", F.round("total", 4).alias("total"))


@query(f"{FRAMES} SELECT pipeline_id, frame_number AS seq, event_type AS key, coalesce(CAST(lag(event_id) OVER (PARTITION BY pipeline_id, event_type ORDER BY frame_number) AS VARCHAR), '') AS value FROM frames")
def key_value_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame asks for the last event of its type, then stores its own."""
    rows = bus(spark, sf_dir)
    two = F.explode(F.array(F.struct((F.col("frame_number") * 2).alias("seq"), F.lit("get").alias("op")), F.struct((F.col("frame_number") * 2 + 1).alias("seq"), F.lit("set").alias("op"))))
    asked = rows.select("pipeline_id", two.alias("r"), F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value")).select("pipeline_id", "r.seq", "r.op", "key", "value")
    return ordered.key_values(asked).select("pipeline_id", (F.col("seq") / 2).cast("long").alias("seq"), "key", "value")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two points a frame: one that drifts with the frame number, one at the event's value."""
    n = F.col("frame_number").cast("double")
    return bus(spark, sf_dir).select("pipeline_id", "frame_number", F.array(F.array(n * 3, n), F.array(F.col("value") * 10, F.lit(500.0))).alias("points"))


@query()
def object_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Registry(Stage("track").add(Hook(PROCESS, frame=tracking.hook, writes={"track_ids": T.ArrayType(T.LongType())}, stateful=True)))
    return execute(_points(spark, sf_dir), ["track"], stages).select("pipeline_id", "frame_number", "track_ids")


@query()
def object_tracks_streaming_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.tracks(_points(spark, sf_dir))


def frame_source(spark: SparkSession, **options: int | str) -> DataFrame:
    spark.dataSource.register(FrameSource)
    return spark.read.format("frames").options(**options).load()


@query("SELECT CAST(s AS INTEGER) AS frame_size, count(*) AS n FROM (SELECT 4 * 3 * 3 AS s FROM range(300)) GROUP BY 1")
def frames_datasource(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_source(spark, streams=3, frames=100).groupBy(F.length("modified").alias("frame_size")).agg(F.count("*").alias("n"))


@query()
def pixel_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box, and a mark stamped in the corner, on synthetic frames; the checksum is of the changed pixels."""
    rows = frame_source(spark, streams=2, frames=50, width=32, height=24)
    boxed = pixels.paint(rows, lambda p, r: pixels.rectangle(p, (4, 4, 20, 16), (255, 0, 255)))
    marked = pixels.paint(boxed, pixels.stamp(np.full((4, 4, 3), 9, np.uint8), (28, 20)))
    return marked.select("pipeline_id", "frame_number", F.crc32("original").alias("original_crc"), F.crc32("modified").alias("modified_crc"))


@query(f"SELECT vec_id, label, name FROM (SELECT vec_id, label, ['{"', '".join(detections.LABELS[:CLASSES])}'][label + 1] AS name FROM embeddings)")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class numbers to names by a join with the fixed list of labels."""
    names = spark.createDataFrame(list(enumerate(detections.LABELS)), "label int, name string")
    return table(spark, sf_dir, "embeddings").join(F.broadcast(names), "label").select("vec_id", "label", "name")
