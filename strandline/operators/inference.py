"""Model inference as a hook: a tensor in, named tensors out, in real batches."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandline.plans.path import PROCESS, Hook
from strandline.schemas import DOUBLE_TENSOR, TENSOR

log = logging.getLogger(__name__)
PROVIDERS = {"cpu": "CPUExecutionProvider", "cuda": "CUDAExecutionProvider", "tensorrt": "TensorrtExecutionProvider", "openvino": "OpenVINOExecutionProvider", "coreml": "CoreMLExecutionProvider"}


@dataclass(frozen=True)
class InferenceSpec:
    """A declared inference: runtime onnx, a model, and its parameters."""

    runtime: str
    model_uri: str
    params: dict = field(default_factory=dict)
    stateful: bool = False

    @staticmethod
    def parse(data: dict) -> InferenceSpec:
        for name in ("runtime", "model_uri"):
            if not isinstance(data.get(name), str):
                raise TypeError(f"{name} must be a string")
        params = data.get("inference_params") or {}
        if not isinstance(params, dict):
            raise TypeError("inference_params must be an object")
        if not isinstance(data.get("make_stateful") or False, bool):
            raise TypeError("make_stateful must be a boolean")
        if data["runtime"] != "onnx":
            raise NotImplementedError(f"runtime {data['runtime']}")
        if params.get("execution_provider", "cpu").lower() not in PROVIDERS:
            raise ValueError(f"execution provider {params['execution_provider']}")
        if params.get("execution_mode", "sequential") not in ("sequential", "parallel"):
            raise ValueError(f"execution mode {params['execution_mode']}")
        if params.get("output_type", "float") not in ("float", "double"):
            raise ValueError(f"output type {params['output_type']}")
        return InferenceSpec(data["runtime"], data["model_uri"], params, data.get("make_stateful") or False)


def publish(spark: SparkSession, spec: InferenceSpec) -> InferenceSpec:
    """Send a model file to every executor; the returned spec names it there."""
    scheme, _, rest = spec.model_uri.rpartition("://")
    if scheme not in ("", "file", "http", "https", "hdfs", "s3a"):
        raise ValueError(f"can't fetch {spec.model_uri}")
    spark.sparkContext.addFile(rest if scheme == "file" else spec.model_uri)
    return replace(spec, model_uri="shipped://" + spec.model_uri.rsplit("/", 1)[-1])


@cache
def _session(path: str, params: tuple):
    """One for each worker process and model."""
    import onnxruntime as ort

    known = dict(params)
    options = ort.SessionOptions()
    options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
    options.intra_op_num_threads = int(known.get("intra_threads", 1))
    if known.get("execution_mode") == "parallel":
        options.execution_mode = ort.ExecutionMode.ORT_PARALLEL
        options.inter_op_num_threads = int(known.get("inter_threads", 1))
    if known.get("custom_op_lib_path"):
        options.register_custom_ops_library(known["custom_op_lib_path"])
    wanted = PROVIDERS[known.get("execution_provider", "cpu").lower()]
    session = ort.InferenceSession(path, options, providers=[p for p in dict.fromkeys((wanted, PROVIDERS["cpu"])) if p in ort.get_available_providers()])
    _warm(session)
    return session


def _warm(session) -> None:
    """A first call on zeros, where the model says the size of its input: frames don't wait for what it sets up."""
    first, *others = session.get_inputs()
    if not others and first.type == "tensor(float)" and all(isinstance(n, int) for n in first.shape[1:]):
        try:
            session.run(None, {first.name: np.zeros((1, *first.shape[1:]), np.float32)})
        except Exception as e:
            log.warning("warm-up failed: %s", e)


def _path(uri: str) -> str:
    return SparkFiles.get(uri.removeprefix("shipped://")) if uri.startswith("shipped://") else uri.removeprefix("file://")


def infer(df: DataFrame, spec: InferenceSpec, source: str = "inference_input", target: str = "inference_output", most: int = 256) -> DataFrame:
    """Run the model's first input on `source` (struct of shape and data); `target` maps output names to tensors.

    Frames of equal shape share a call; outputs keep the batch axis, of length 1. Rows without input, with data that doesn't
    fit its shape, or whose own call fails keep a null or their old target: a call of many rows that fails is made again
    row by row. A stateful spec gets each stream's frames in order, one a call. Outputs are floats, or doubles if the spec's
    output_type says so.
    """
    if spec.stateful:
        df, most = df.repartition("pipeline_id").sortWithinPartitions("pipeline_id", "frame_number"), 1
    kind, dtype = (DOUBLE_TENSOR, np.float64) if spec.params.get("output_type") == "double" else (TENSOR, np.float32)
    schema = T.StructType([f for f in df.schema.fields if f.name != target] + [T.StructField(target, T.MapType(T.StringType(), kind))])
    names = schema.names
    uri, params, in_order = spec.model_uri, tuple(sorted(spec.params.items())), spec.stateful

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = _session(_path(uri), params)
        into = session.get_inputs()[0].name
        outputs = [o.name for o in session.get_outputs()]

        def call(inputs: list[np.ndarray]) -> list[dict | None]:
            try:
                results = session.run(None, {into: np.stack(inputs)})
            except Exception:
                return [r for x in inputs for r in call([x])] if len(inputs) > 1 else [None]
            known = [(n, r) for n, r in zip(outputs, results, strict=True) if r.dtype.kind in "fi" and len(r) == len(inputs)]
            return [{n: {"shape": [1, *r.shape[1:]], "data": r[k].astype(dtype).ravel().tolist()} for n, r in known} for k in range(len(inputs))]

        for batch in batches:
            found: list[dict | None] = list(batch[target]) if target in batch else [None] * len(batch)
            groups: dict[tuple, list[tuple[int, np.ndarray]]] = {}
            for i, x in enumerate(batch[source]):
                data = None if x is None or x["data"] is None or x["shape"] is None else np.asarray(x["data"], np.float32)
                shape = () if data is None else tuple(int(n) for n in x["shape"])
                if data is not None and len(data) and min(shape, default=1) >= 0 and len(data) == np.prod(shape, dtype=np.int64):
                    groups.setdefault((shape, i if in_order else 0), []).append((i, data.reshape(shape)))
            for rows in groups.values():
                for at in range(0, len(rows), most):
                    part = rows[at : at + most]
                    for (i, _), result in zip(part, call([x for _, x in part]), strict=True):
                        found[i] = result if result is not None else found[i]
            out = batch.drop(columns=[target], errors="ignore").copy()
            out[target] = pd.Series(found, index=batch.index, dtype=object)
            yield out[names]

    return df.mapInPandas(run, schema)


class Model:
    """A model in three steps, for any runtime: subclasses say how a frame becomes an input and an output a result."""

    def open(self) -> None:
        """Load what a worker needs; once a task."""

    def prepare(self, row: dict) -> np.ndarray | None:
        """The input of a frame; None leaves the frame out."""
        raise NotImplementedError

    def run(self, inputs: np.ndarray) -> np.ndarray:
        """Outputs of a batch of inputs of one shape."""
        raise NotImplementedError

    def finish(self, output: np.ndarray, row: dict) -> dict:
        """Columns of the result."""
        raise NotImplementedError


def apply_model(df: DataFrame, model: Model, writes: dict[str, T.DataType], most: int = 64) -> DataFrame:
    """Add the columns that the model writes; inputs of equal shape run together, frames left out get nulls."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in writes] + [T.StructField(n, t) for n, t in writes.items()])
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model.open()
        for batch in batches:
            rows = batch.to_dict("records")
            groups: dict[tuple, list[tuple[dict, np.ndarray]]] = {}
            for row in rows:
                row.update(dict.fromkeys(writes))
                x = model.prepare(row)
                if x is not None:
                    groups.setdefault((x.shape, x.dtype.str), []).append((row, x))
            for members in groups.values():
                for at in range(0, len(members), most):
                    part = members[at : at + most]
                    for (row, _), output in zip(part, model.run(np.stack([x for _, x in part])), strict=True):
                        row.update(model.finish(output, row))
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    return df.mapInPandas(run, schema)


def inference_hook(spec: InferenceSpec, kind: str = PROCESS) -> Hook:
    """A hook that ships its model when a path runs."""
    return Hook(kind, rows=lambda d: infer(d, spec if spec.model_uri.startswith("shipped://") else publish(d.sparkSession, spec)), stateful=spec.stateful)


def linear_model(weights: np.ndarray) -> bytes:
    """An ONNX model y = x @ weights for batches of rows of floats, written without the onnx package.

    Weights of doubles make it compute and answer in doubles.
    """

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def tagged(number: int, x: bytes | str | int) -> bytes:
        if isinstance(x, int):
            return varint(number << 3) + varint(x)
        x = x.encode() if isinstance(x, str) else x
        return varint(number << 3 | 2) + varint(len(x)) + x

    def value(name: str, n: int, kind: int) -> bytes:
        dims = tagged(1, tagged(2, "n")) + tagged(1, tagged(1, n))
        return tagged(1, name) + tagged(2, tagged(1, tagged(1, kind) + tagged(2, dims)))

    rows, columns = weights.shape
    floats, doubles = 1, 11  # of the format's list of types
    kind = doubles if weights.dtype == np.float64 else floats
    matrix = tagged(1, rows) + tagged(1, columns) + tagged(2, kind) + tagged(8, "w") + tagged(9, weights.astype("<f8" if kind == doubles else "<f4").tobytes())
    cast = tagged(1, "x") + tagged(2, "c") + tagged(4, "Cast") + tagged(5, tagged(1, "to") + tagged(3, kind) + tagged(20, 2))
    node = tagged(1, "c" if kind == doubles else "x") + tagged(1, "w") + tagged(2, "y") + tagged(4, "MatMul")
    nodes = (tagged(1, cast) if kind == doubles else b"") + tagged(1, node)
    graph = nodes + tagged(2, "g") + tagged(5, matrix) + tagged(11, value("x", rows, floats)) + tagged(12, value("y", columns, kind))
    return tagged(1, 8) + tagged(7, graph) + tagged(8, tagged(1, "") + tagged(2, 13))
