"""Paths, hooks, control table, state, sources and sinks."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.control import decisions
from strandline.control.decisions import TRANSITIONS
from strandline.control.streams import Entry, NotFound, Streams, Supervisor
from strandline.functions import detections, geometry, media, tensors, userdata
from strandline.operators import frames as ops
from strandline.operators import inference, pixels
from strandline.operators.tracking import Tracker
from strandline.plans.path import POST, PRE, PROCESS, Hook, Registry, Stage, StageNotFound, execute
from strandline.queries.python import frame_source, weights
from strandline.sources import sinks
from strandline.sources.frames import FrameSource, synthetic
from strandline.streaming import ordered


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("policy,reason,state", [(p, r, s) for p, by in TRANSITIONS.items() for r, s in by.items()])
def test_finish(policy, reason, state):
    streams = Streams()
    entry = streams.add("rtsp://h/p", ["a"], None, policy)
    streams.assign(entry.id, "p")
    assert streams.finish("p", reason).target_state == state
    assert streams.get(entry.id).pipeline_id is None


def test_streams_table(spark):
    calls = []
    streams = Streams(lambda: calls.append(1))
    a = streams.add("rtsp://1", ["s-1", "s2"])
    b = streams.add("rtsp://1", ["s1"])  # equal inputs are allowed
    assert a.frame_path == ("s_1", "s2") and len(calls) == 2
    streams.assign(a.id, "p1")
    with pytest.raises(ValueError):
        streams.assign(b.id, "p1")
    assert streams.by_pipeline("p1").id == a.id and streams.by_pipeline("p2") is None
    assert streams.update(a.id, output_uri="screen", frame_path=[]).frame_path == ("s_1", "s2")
    assert streams.get(a.id).pipeline_id is None
    assert streams.remove(a.id).id == a.id
    with pytest.raises(NotFound):
        streams.remove(a.id)
    with pytest.raises(ValueError):
        streams.add("", ["a"])
    assert Entry("file:///a", ("s",), restart_policy="always").restart_policy == "never"
    assert streams.frame(spark).count() == 1


class FakeQuery:
    def __init__(self):
        self.isActive, self.error = True, None

    def stop(self):
        self.isActive = False

    def exception(self):
        return self.error


def test_supervisor():
    started, events = [], []
    streams = Streams()

    def start(entry, pipeline):
        if entry.input_uri == "bad":
            raise RuntimeError
        started.append((entry.id, q := FakeQuery()))
        return q

    supervisor = Supervisor(streams, Registry(Stage("a")), start, events.append)
    a = streams.add("rtsp://x", ["a"], None, "on_error")
    streams.add("rtsp://y", ["missing"])
    streams.add("bad", ["a"])
    supervisor.poll()
    assert [i for i, _ in started] == [a.id] and len(streams.list()) == 1
    assert events == [{"type": "StreamStartError", "stream_uuid": events[0]["stream_uuid"]}]
    query = started[0][1]
    query.isActive, query.error = False, ValueError()
    supervisor.poll()  # an error restarts it
    assert len(started) == 2 and events[-1]["end_state"] == "error"
    streams.update(a.id, frame_path=["a"])
    supervisor.poll()  # a changed entry gets a new pipeline, the old one stops
    assert len(started) == 3 and not started[1][1].isActive
    streams.remove(a.id)
    supervisor.poll()
    assert not supervisor.running and not started[2][1].isActive


def test_path_errors():
    stages = Registry(Stage("a"), Stage("b-c"))
    assert stages.path(" a/b_c ") == ["a", "b_c"]
    with pytest.raises(StageNotFound, match="`x` stage does not exist"):
        stages.path("a/x/y")
    with pytest.raises(StageNotFound):
        stages.path("")
    with pytest.raises(ValueError):
        Hook("other")


def test_hooks(spark):
    def fails(row, context):
        if row["frame_number"] == 2:
            raise ValueError("no")
        row["original"], row["note"] = b"lost", context["word"]

    stage = Stage("s", init=lambda: {"word": "hi"})
    stage.add(Hook(PRE, where=F.col("frame_number") > 0)).add(Hook(PROCESS, frame=fails, writes={"note": T.StringType()})).add(Hook(PROCESS, frame=print))
    rows = spark.createDataFrame([("p", i, bytearray(b"x")) for i in range(4)], "pipeline_id string, frame_number long, original binary")
    out = {r.frame_number: r for r in execute(rows, ["s", "gone"], Registry(stage)).collect()}
    assert sorted(out) == [1, 3] and bytes(out[1].original) == b"x" and out[1].note == "hi"
    kept = {r.frame_number: r.hook_error for r in execute(rows, ["s"], Registry(stage), errors="keep").collect()}
    assert kept == {1: None, 2: "s: no", 3: None}


def test_python_hooks_are_fused_and_pushed_past(spark, tmp_path):
    spark.range(10).select(F.lit("p").alias("pipeline_id"), F.col("id").alias("frame_number")).write.parquet(str(tmp_path / "f"))
    hook = Hook(PROCESS, frame=lambda row, context: None)
    stages = Registry(Stage("f").add(Hook(PRE, where=F.col("frame_number") > 5)), Stage("a").add(hook), Stage("b").add(hook))
    plan = execute(spark.read.parquet(str(tmp_path / "f")), ["f", "a", "b"], stages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "GreaterThan(frame_number,5)" in plan


def test_registry_from_dir(spark, tmp_path):
    stage = tmp_path / "my-stage"
    stage.mkdir()
    (tmp_path / "readme.md").write_text("ignored")
    (stage / "init.py").write_text("def init():\n    return {'add': 5}\n")
    (stage / "process.py").write_text("# make stateful\ndef hook(frame, context):\n    s = context['state']\n    s['n'] = frame['n'] = s.get('n', 0) + context['add']\n")
    (stage / "post-process.json").write_text(json.dumps({"runtime": "onnx", "model_uri": "file:///m"}))
    stages = Registry.from_dir(tmp_path, {"n": T.LongType()})
    assert list(stages.stages) == ["my_stage"] and stages.stages["my_stage"].hooks[PROCESS].stateful
    del stages.stages["my_stage"].hooks[POST]
    rows = spark.createDataFrame([(p, i) for p in "ab" for i in (3, 1, 2)], "pipeline_id string, frame_number long")
    assert sorted(tuple(r) for r in execute(rows, ["my_stage"], stages).collect()) == [(p, i, 5 * i) for p in "ab" for i in (1, 2, 3)]


def test_inference_spec():
    with pytest.raises(TypeError):
        inference.InferenceSpec.parse({"runtime": "onnx"})
    with pytest.raises(NotImplementedError):
        inference.InferenceSpec.parse({"runtime": "openvino", "model_uri": "m"})
    with pytest.raises(ValueError):
        inference.InferenceSpec.parse({"runtime": "onnx", "model_uri": "m", "inference_params": {"execution_provider": "abacus"}})


def test_inference(spark, tmp_path):
    path = tmp_path / "m.onnx"
    path.write_bytes(inference.linear_model(weights()))
    x = np.random.default_rng(0).normal(size=(3, 64)).astype(np.float32)
    rows = spark.createDataFrame([(0, ([64], x[0].tolist())), (1, None), (2, ([64], x[2].tolist())), (3, ([3], [1.0, 2.0, 3.0]))], "i int, inference_input struct<shape:array<int>,data:array<float>>")
    out = {r.i: r.inference_output for r in inference.infer(rows, inference.InferenceSpec("onnx", f"file://{path}")).collect()}
    assert out[1] is None and out[3] is None and np.allclose(out[2]["y"]["data"], x[2] @ weights(), atol=1e-4)


def test_uris(spark):
    rows = spark.createDataFrame([("file://rel.mp4",), ("v4l2:a:b",), ("noscheme",), ("rtsp://h/p",)], "u string")
    assert [r.e for r in rows.select(media.uri_error(F.col("u")).alias("e")).collect()] == ["relative file path", "more than one device", "no protocol", None]
    with pytest.raises(Exception, match="relative file path|more than one device|no protocol"):
        rows.select(media.checked_uri(F.col("u"))).collect()
    assert one(spark, media.sink_kind(F.lit(""))) == "none" and one(spark, media.caps_int(F.lit("width=(int)5"), "height")) is None


def test_payloads(spark):
    rows = spark.createDataFrame([("2147483647", "integer"), ("2147483648", "float"), ("-2.5", "float"), ("false", "integer"), ("[]", "array"), ("{}", "dictionary"), (None, "empty"), ("{", None)], "j string, kind string")
    assert all(r.kind == r.k for r in rows.withColumn("k", userdata.kind(F.col("j"))).collect())
    assert json.loads(one(spark, userdata.with_field(F.lit('{"a":"1"}'), "b", F.lit(2)))) == {"a": "1", "b": "2"}
    assert one(spark, userdata.as_number(F.lit(3.0))).i == 3 and one(spark, userdata.as_number(F.lit(3e10))).f == 3e10


def test_scores(spark):
    nan = [float("nan"), 0.2]
    rows = spark.createDataFrame([([0.0, 0.0, 2.0, 2.0, *nan],), ([0.0, 0.0, 2.0, 2.0, 1.0, 0.3],), ([0.0, 0.0, 2.0, 2.0, 0.5, 0.5],), ([0.0, 0.0, 2.0, 2.0, 0.1, 0.2],)], "v array<double>")
    assert [r.d and r.d["class"] for r in rows.select(detections.decode(F.col("v")).alias("d")).collect()] == [None, None, 0, None]
    empty = F.array().cast("array<struct<box:array<double>,score:double>>")
    assert one(spark, detections.suppress(empty, "struct<box:array<double>,score:double>")) == []
    assert one(spark, detections.label(F.lit(80))) is None and one(spark, detections.label(F.lit(0))) == "person"


def test_tensors(spark):
    x = np.arange(24)
    assert one(spark, tensors.hwc_to_chw(F.lit(x.tolist()), 2, 4, 3)) == x.reshape(2, 4, 3).transpose(2, 0, 1).ravel().tolist()
    assert one(spark, tensors.chw_to_hwc(F.lit(x.tolist()), 3, 2, 4)) == x.reshape(3, 2, 4).transpose(1, 2, 0).ravel().tolist()
    assert one(spark, tensors.bgr_to_rgb(F.lit([1, 2, 3, 4, 5, 6]))) == [3, 2, 1, 6, 5, 4]
    assert one(spark, geometry.corners(F.array(F.lit(1), F.lit(1), F.lit(5), F.lit(5)))) == [-1, -1, 4, 4]


def test_pixels(spark):
    rows = frame_source(spark, streams=1, frames=2, width=8, height=8)
    out = pixels.paint(rows, lambda p, r: p[::2, ::2]).orderBy("frame_number").collect()
    assert list(out[1].modified_shape) == [4, 4, 3] and bytes(out[1].original) == synthetic(0, 2, 8, 8)
    canvas = np.zeros((10, 10, 3), np.uint8)
    pixels.rectangle(canvas, (-3, 2, 20, 7), (1, 1, 1))
    pixels.line(canvas, (0, 0), (9, 9), (2, 2, 2))
    pixels.point(canvas, (5, 5), (3, 3, 3))
    pixels.stamp(np.ones((3, 3, 3), np.uint8))(canvas, {})
    assert canvas[5, 5, 0] == 3 and canvas[0, 0, 0] == 2


def test_tracker():
    tracker = Tracker(patience=1)
    assert tracker.update([(0, 0), (100, 100)]) == [1, 2]
    assert tracker.update([(101, 100), (1, 1), (300, 0)]) == [2, 1, 3]
    assert tracker.update([]) == [] and tracker.update([]) == [] and tracker.update([(0, 0)]) == [4]


@pytest.mark.parametrize("seed", range(3))
def test_order_does_not_matter(spark, seed):
    """Permuted and thinned frames give the state of the ordered sequence, in batch and in streaming."""
    rng = random.Random(seed)
    rows = [(p, n, float(n * p)) for p in (1, 2, 3) for n in range(1, 30) if rng.random() > 0.2]
    expected = set()
    for p in (1, 2, 3):
        total = 0.0
        for i, (_, n, v) in enumerate([r for r in rows if r[0] == p]):
            total += v
            expected.add((p, n, i + 1, total))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "pipeline_id long, frame_number long, value double")
    assert {tuple(r) for r in ordered.ordered_totals(df, patience=0).collect()} == expected


def test_streaming_equals_batch(spark, tmp_path):
    """The same rows, file by file out of order, through Structured Streaming: all but frames that wait for a gap."""
    rows = [(p, n, float(n)) for p in (1, 2) for n in range(1, 21)]
    schema = "pipeline_id long, frame_number long, value double"
    random.Random(1).shuffle(rows)
    for i in range(4):
        spark.createDataFrame(rows[i * 10 : i * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in ordered.ordered_totals(spark.read.parquet(str(tmp_path / "in"))).collect()}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ordered.ordered_totals(stream).writeStream.format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("ordered").collect()} == batch and len(batch) == 40


def test_streamed_answers_equal_batch(spark, tmp_path):
    """Key-value answers of two micro-batches against those of one sorted reading."""
    rows = [(p, n, ("set", "get", "end")[n % 3 if n % 4 else 0], f"k{n // 3 % 2}", f"v{n}") for p in (1, 2) for n in range(1, 31)]
    schema, path = "pipeline_id long, seq long, op string, key string, value string", str(tmp_path / "in")
    for half in (lambda r: r[1] <= 9, lambda r: r[1] > 9):
        part = [r for r in rows if half(r)]
        random.Random(3).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    batch = sorted(map(str, ordered.key_values(spark.read.parquet(path)).collect()))
    stream = ordered.key_values(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    stream.writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").start().awaitTermination(120)
    assert sorted(map(str, spark.table("answers").collect())) == batch and sum("value='v" in r for r in batch) > 10


def test_rows_without_a_stream(spark):
    """Null is a stream as any other, and a null value leaves no number."""
    rows = spark.createDataFrame([(None, 2, 1.0), (None, 1, 2.0), (2**60 + 1, 1, None), (2**60 + 1, 3, 1.0)], "pipeline_id long, frame_number long, value double")
    got = {(r.pipeline_id, r.frame_number): (r.n, str(r.total)) for r in ordered.ordered_totals(rows, patience=0).collect()}
    assert got == {(None, 1): (1, "2.0"), (None, 2): (2, "3.0"), (2**60 + 1, 1): (1, "nan"), (2**60 + 1, 3): (2, "nan")}
    assert ordered.ordered_totals(rows.limit(0)).count() == 0
    assert {r.frame_number for r in ordered.ordered_totals(rows, patience=1).where("pipeline_id > 0").collect()} == {1}


def test_frame_stream_to_files(spark, tmp_path):
    spark.dataSource.register(FrameSource)
    stream = spark.readStream.format("frames").options(streams=2, frames=5, maxFramesPerTrigger=2).load()
    query = sinks.stream_to(stream, f"file://{tmp_path}/out.mp4").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    for _ in range(100):
        query.processAllAvailable()
        if query.lastProgress and (tmp_path / "out.mp4").exists() and spark.read.parquet(str(tmp_path / "out.mp4")).count() == 10:
            break
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out.mp4")).count() == 10


def test_sinks(spark):
    with pytest.raises(ValueError):
        sinks.stream_to(None, "ftp://x")
    rows = frame_source(spark, frames=3).withColumn("width", F.when(F.col("frame_number") == 2, 1).otherwise(F.col("width")))
    good, bad = sinks.emittable(rows)
    assert good.count() == 2 and [r.message for r in bad.collect()] == ["size changed"]
    seen = []
    sinks.exporter(seen.append)({"type": "StreamFinished"})
    sinks.exporter(None)({})
    sinks.exporter(lambda e: 1 / 0)({})
    assert seen == ['{"type": "StreamFinished"}']


def test_shed_keeps_control_rows(spark):
    rows = spark.createDataFrame([(1, n, k) for n, k in enumerate(["frame", "frame", "caps", "frame", "end_of_input"], 1)], "pipeline_id int, frame_number long, kind string")
    left = ops.gaps(ops.shed(rows, 1, F.lit(0))).orderBy("frame_number").collect()
    assert [(r.frame_number, r.missing) for r in left] == [(1, 0), (3, 1), (5, 1)]


def test_windows_with_watermark(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("pipeline_id"), "ts")
    assert ordered.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_key_values_of_several_chunks(spark):
    """One stream, shuffled, in many Arrow chunks."""
    data = [(1, 2 * i + k, "set" if k == 0 else "get", f"k{i % 3}", str(i)) for i in range(200) for k in range(2)]
    random.Random(2).shuffle(data)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = ordered.key_values(spark.createDataFrame(data, "pipeline_id long, seq long, op string, key string, value string")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.seq: r.value for r in got} == {2 * i + 1: str(i) for i in range(200)}


def test_key_values(spark):
    rows = [(1, 1, "get", "a", ""), (1, 2, "set", "a", "x"), (1, 3, "get", "a", ""), (2, 1, "get", "a", ""), (1, 4, "end", "", ""), (1, 5, "get", "a", "")]
    df = spark.createDataFrame(rows, "pipeline_id long, seq long, op string, key string, value string")
    assert {(r.pipeline_id, r.seq, r.value) for r in ordered.key_values(df).collect()} == {(1, 1, ""), (1, 3, "x"), (2, 1, ""), (1, 5, "")}


class Sum(inference.Model):
    """Adds up the pixels of frames with an even number."""

    def prepare(self, row):
        return np.frombuffer(row["modified"], np.uint8).astype(np.int64) if row["frame_number"] % 2 == 0 else None

    def run(self, inputs):
        return inputs.sum(1)

    def finish(self, output, row):
        return {"total": int(output)}


def test_model_steps(spark):
    rows = inference.apply_model(frame_source(spark, frames=4).select("frame_number", "modified"), Sum(), {"total": T.LongType()}).collect()
    assert {r.frame_number: r.total for r in rows} == {n: sum(synthetic(0, n, 4, 3)) if n % 2 == 0 else None for n in range(1, 5)}


def test_spread_fold_keeps_rows_without_a_key(spark):
    rows = spark.createDataFrame([(None, 1, 1, 2.0), (1, None, 1, 3.0), (1, 1, 1, 4.0), (1, 2, 2, 5.0), (None, 2, 2, 6.0)], "k int, b int, n int, v double")
    got = ops.spread_fold(rows, "k", ["n"], F.col("b"), {"total": F.col("v"), "number": F.lit(1)})
    assert got.columns == ["k", "b", "n", "v", "total", "number"]
    assert sorted(((r.k, r.b, r.total, r.number) for r in got.collect()), key=str) == sorted([(None, 1, 2.0, 1), (None, 2, 8.0, 2), (1, None, 3.0, 1), (1, 1, 7.0, 2), (1, 2, 12.0, 3)], key=str)


def test_streams_in_blocks(spark, monkeypatch):
    """Each operator over blocks of 3 numbers against one pass over the whole stream."""
    monkeypatch.setattr(ops, "BLOCK", 3)
    drawn = random.Random(4)
    whole = [(p, n, f"2024-01-01 00:{n:02d}:{drawn.randrange(60):02d}", drawn.choice(["frame", "frame", "caps"]), drawn.choice([None, 1.0, 2.0])) for p in (None, 1, 2) for n in range(1, 30)]
    whole = [r for r in whole if r[1] < 8 or drawn.random() < 0.6]
    rows = spark.createDataFrame(drawn.sample(whole, len(whole)), "pipeline_id int, frame_number long, ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    missing, length, latched, frontier, totals = {}, {}, set(), set(), {}
    for p in (None, 1, 2):
        before, seen, total = None, False, None
        for i, (_, n, ts, kind, value) in enumerate(r for r in whole if r[0] == p):
            at = datetime.fromisoformat(ts)
            missing[p, n] = n - (before[0] if before else 0) - 1
            length[p, n] = None
            if before:
                length[p, before[0]] = (at - before[1]) // timedelta(microseconds=1)
            seen = seen or kind == "caps"
            if seen and kind == "frame":
                latched.add((p, n))
            if n == i + 1:
                frontier.add((p, n))
            total = total if value is None else (total or 0.0) + value
            totals[p, n] = (i + 1, total)
            before = n, at
    assert {(r.pipeline_id, r.frame_number): r.missing for r in ops.gaps(rows).collect()} == missing
    assert {(r.pipeline_id, r.frame_number): r.duration_us for r in ops.with_duration(rows).collect()} == length
    assert {(r.pipeline_id, r.frame_number) for r in ops.latched(rows).collect()} == latched
    assert {(r.pipeline_id, r.frame_number) for r in ops.frontier(rows).collect()} == frontier
    assert {(r.pipeline_id, r.frame_number): (r.n, r.total) for r in ops.running(rows, {"n": F.lit(1), "total": F.col("value")}).collect()} == totals


def test_tensors_that_do_not_fit(spark, tmp_path):
    """One bad frame costs neither the job nor the frames that share its call."""
    model = tmp_path / "sum.onnx"
    model.write_bytes(inference.linear_model(np.ones((3, 1), np.float32)))
    spec = inference.InferenceSpec("onnx", str(model))
    data = [(0, ([3], [1.0, 2.0, 3.0])), (1, ([3], [1.0])), (2, ([2], [1.0, 2.0])), (3, (None, [1.0])), (4, ([-1], [1.0])), (5, ([3], [4.0, 5.0, 6.0])), (6, ([], [7.0]))]
    rows = spark.createDataFrame(data, "i int, inference_input struct<shape:array<int>,data:array<float>>").coalesce(1)
    got = {r.i: r.inference_output for r in inference.infer(rows, spec).collect()}
    assert {i: (list(v["y"].shape), list(v["y"].data)) for i, v in got.items() if v} == {0: ([1, 1], [6.0]), 5: ([1, 1], [15.0])} and len(got) == 7


def test_a_batch_that_is_written_again(spark, tmp_path):
    rows = frame_source(spark, frames=3)
    for batch, n in ((0, 2), (1, 3), (1, 3)):
        sinks.write_frames(rows.where(F.col("frame_number") <= n), str(tmp_path / "f"), batch)
    assert spark.read.parquet(str(tmp_path / "f")).count() == 5


def test_source_after_a_restart(spark, tmp_path):
    """A query that stops and starts again from its checkpoint reads no frame twice and leaves none out."""
    spark.dataSource.register(FrameSource)
    for seconds in (3, 12):
        stream = spark.readStream.format("frames").options(streams=2, frames=6, maxFramesPerTrigger=2).load()
        query = sinks.stream_to(stream, f"file://{tmp_path}/o.mp4").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
        query.awaitTermination(seconds)
        query.stop()
    got = [(r.pipeline_id, r.frame_number) for r in spark.read.parquet(str(tmp_path / "o.mp4")).collect()]
    assert len(got) == len(set(got)) == 12


def test_a_long_stream_in_order(spark):
    """One stream of many frames, shuffled: gaps and all in one go."""
    n = 100_000
    rows = spark.range(1, n).where("id % 10 > 0").select(F.lit(1).alias("pipeline_id"), F.col("id").alias("frame_number"), F.lit(1.0).alias("value")).orderBy(F.xxhash64("id"))
    got = ordered.ordered_totals(rows, patience=0).agg(F.count("*"), F.max("n"), F.max("frame_number")).first()
    assert tuple(got) == (n * 9 // 10, n * 9 // 10, n - 1)


def test_entries_differ_by_any_part(spark):
    parts = [("x", "y|", "a", "p"), ("x|y", "", "a", "p"), ("x", None, "a", "p"), ("x", "", "a", "p"), ("", "x", "a", "p")]
    rows = spark.createDataFrame(parts, "i string, o string, p string, r string")
    assert rows.select(decisions.entry_hash(F.col("i"), F.col("o"), F.array("p"), F.col("r")).alias("h")).distinct().count() == len(parts)
