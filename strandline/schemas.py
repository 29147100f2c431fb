"""Fixed schemas of frames, streams and bus events."""

from __future__ import annotations

from pyspark.sql import types as T

TENSOR = T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(T.FloatType()))])
#: A tensor of a model that computes in doubles.
DOUBLE_TENSOR = T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(T.DoubleType()))])

#: One frame of a stream. Times are milliseconds; pixels are rows of RGB bytes, of width x height or of modified_shape.
FRAME = T.StructType([
    T.StructField("uuid", T.StringType()),
    T.StructField("original", T.BinaryType()),
    T.StructField("modified", T.BinaryType()),
    T.StructField("modified_shape", T.ArrayType(T.IntegerType())),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("pts", T.LongType()),
    T.StructField("dts", T.LongType()),
    T.StructField("duration", T.LongType()),
    T.StructField("fps", T.ShortType()),
    T.StructField("input_ts", T.DoubleType()),
    T.StructField("inference_input", TENSOR),
    T.StructField("inference_output", T.MapType(T.StringType(), TENSOR)),
    T.StructField("pipeline_id", T.StringType()),
    T.StructField("user_data", T.StringType()),
    T.StructField("frame_number", T.LongType()),
])

#: One row of the control table.
STREAM = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("input_uri", T.StringType(), False),
    T.StructField("output_uri", T.StringType()),
    T.StructField("frame_path", T.ArrayType(T.StringType()), False),
    T.StructField("pipeline_id", T.StringType()),
    T.StructField("hash", T.LongType()),
    T.StructField("target_state", T.StringType(), False),
    T.StructField("restart_policy", T.StringType(), False),
])

#: Kinds of rows on a stream's bus.
FRAME_KIND, TAGS, CAPS, END_OF_INPUT, END_OF_OUTPUT, INPUT_ERROR, OUTPUT_ERROR = KINDS = ("frame", "tags", "caps", "end_of_input", "end_of_output", "input_error", "output_error")
STATES = ("running", "completed", "error")
POLICIES = ("never", "always", "on_error", "on_eos")
REASONS = ("completed", "error", "updated")
