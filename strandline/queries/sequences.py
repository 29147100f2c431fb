"""Frame sequences, bus events, paths, payloads and media descriptions, from the events table.

A user is a stream; views and clicks are frames, a signup announces capabilities, a purchase ends the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import geometry, media, userdata
from strandline.operators import frames as ops
from strandline.plans.path import POST, PRE, PROCESS, Hook, Registry, Stage, execute
from strandline.queries import query, table

KIND = """CASE event_type WHEN 'view' THEN 'frame' WHEN 'click' THEN 'frame' WHEN 'signup' THEN 'caps' WHEN 'purchase' THEN 'end_of_input' WHEN 'error' THEN 'input_error' END"""
FRAMES = f"""WITH frames AS (SELECT user_id AS pipeline_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS frame_number,
  event_id, ts, epoch_us(ts) // 1000 AS pts, {KIND} AS kind, event_type, value, props AS user_data FROM events)"""
SHED = FRAMES + """, slots AS (SELECT *, sum(CASE WHEN kind = 'frame' THEN 1 ELSE 0 END) OVER (PARTITION BY pipeline_id, date_trunc('day', ts) ORDER BY frame_number
  ROWS UNBOUNDED PRECEDING) AS slot FROM frames), kept AS (SELECT * EXCLUDE (slot) FROM slots WHERE kind <> 'frame' OR slot <= 1)"""


def bus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.from_events(table(spark, sf_dir, "events"))


def day() -> Column:
    return F.date_trunc("day", "ts")


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.shed(bus(spark, sf_dir), 1, day())


@query(f"{FRAMES} SELECT pipeline_id, frame_number, event_id, pts FROM frames")
def frame_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bus(spark, sf_dir).select("pipeline_id", "frame_number", "event_id", "pts")


@query("""SELECT event_id, user_id AS pipeline_id, CAST(row_number() OVER w AS BIGINT) AS frame_number, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS total FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def frame_numbering_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and running totals where one stream may hold a large part of all rows: its days are numbered apart."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("pipeline_id"), "ts", "value")
    out = ops.spread_fold(rows, "pipeline_id", ["ts", "event_id"], day(), {"frame_number": F.lit(1), "total": F.col("value")})
    return out.select("event_id", "pipeline_id", F.col("frame_number").cast("long").alias("frame_number"), F.round("total", 4).alias("total"))


@query(f"{FRAMES} SELECT pipeline_id, frame_number, epoch_us(lead(ts) OVER (PARTITION BY pipeline_id ORDER BY frame_number)) - epoch_us(ts) AS duration_us FROM frames")
def frame_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_duration(bus(spark, sf_dir)).select("pipeline_id", "frame_number", "duration_us")


@query("SELECT event_id, epoch_us(ts) // 1000 AS pts FROM events")
def pts_ms_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", media.millis(F.col("ts")).alias("pts"))


@query("SELECT event_id, CAST((1000 + event_id % 60000) // (1 + event_id % 1001) % 256 AS SMALLINT) AS fps FROM events")
def fps_integer_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    num, den = 1000 + F.col("event_id") % 60000, 1 + F.col("event_id") % 1001
    return table(spark, sf_dir, "events").select("event_id", media.whole_fps(num, den).alias("fps"))


@query("""WITH c AS (SELECT event_id, printf('video/x-raw, format=(string)RGB, width=(int)%d, height=(int)%d, framerate=(fraction)%d/%d',
  320 + event_id % 1600, 240 + event_id % 840, 24 + event_id % 37, 1 + event_id % 2) AS caps FROM events)
  SELECT event_id, CAST(regexp_extract(caps, 'width=\\(int\\)(\\d+)', 1) AS INTEGER) AS width, CAST(regexp_extract(caps, 'height=\\(int\\)(\\d+)', 1) AS INTEGER) AS height,
  CAST(regexp_extract(caps, 'framerate=\\(fraction\\)(\\d+)/(\\d+)', 1) AS INTEGER) AS num, CAST(regexp_extract(caps, 'framerate=\\(fraction\\)(\\d+)/(\\d+)', 2) AS INTEGER) AS den FROM c""")
def caps_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    caps = table(spark, sf_dir, "events").select("event_id", media.caps_text(320 + i % 1600, 240 + i % 840, 24 + i % 37, 1 + i % 2).alias("caps"))
    rate = media.caps_fraction(F.col("caps"), "framerate")
    return caps.select("event_id", media.caps_int(F.col("caps"), "width").alias("width"), media.caps_int(F.col("caps"), "height").alias("height"), rate["num"].alias("num"), rate["den"].alias("den"))


URIS = ["file:///a/b.mp4", "file://rel.mp4", "rtsp://h/p", "rtmp://h/p", "https://h/v.mp4", "screen", "v4l2", "v4l2:/dev/video0", "noscheme", "file:///a/b.avi"]
URI_SQL = "[" + ", ".join(f"'{u}'" for u in URIS) + f"][CAST(event_id % {len(URIS)} AS INTEGER) + 1]"


@query(f"""WITH u AS (SELECT event_id, {URI_SQL} AS uri FROM events), p AS (SELECT *, CASE WHEN uri = 'screen' THEN 'screen' WHEN uri LIKE 'v4l2%' THEN 'v4l2'
  WHEN contains(uri, '://') THEN split_part(uri, '://', 1) END AS protocol, CASE WHEN uri = 'screen' THEN 'screen' WHEN uri LIKE 'v4l2%' THEN 'v4l2'
  WHEN contains(uri, '://') THEN split_part(uri, '://', 2) END AS location FROM u)
  SELECT event_id, uri, protocol, location, CASE WHEN protocol IS NULL THEN 'no protocol' WHEN protocol = 'file' AND location NOT LIKE '/%' THEN 'relative file path' END AS problem,
  CASE WHEN protocol = 'file' AND uri NOT LIKE '%.mp4' THEN 'unsupported' WHEN protocol IN ('file', 'rtmp', 'rtsp', 'screen') THEN protocol ELSE 'unsupported' END AS sink FROM p""")
def uri_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.get(F.array(*[F.lit(u) for u in URIS]), (F.col("event_id") % len(URIS)).cast("int"))
    u = F.col("uri")
    return table(spark, sf_dir, "events").select("event_id", uri.alias("uri")).select(
        "event_id", "uri", media.uri_protocol(u).alias("protocol"), media.uri_location(u).alias("location"), media.uri_error(u).alias("problem"), media.sink_kind(u).alias("sink"))


@query(f"""{FRAMES} SELECT kind, CASE kind WHEN 'frame' THEN 'process_frame' WHEN 'caps' THEN 'create_output' WHEN 'end_of_input' THEN 'drain' WHEN 'input_error' THEN 'finish_error' END AS action,
  count(*) AS n FROM frames GROUP BY 1, 2""")
def event_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = ops.lookup(F.col("event_type"), ops.BUS_KIND)
    rows = table(spark, sf_dir, "events").select(kind.alias("kind"))
    return rows.groupBy("kind", ops.lookup(F.col("kind"), ops.ACTIONS).alias("action")).agg(F.count("*").alias("n"))


@query(f"""{FRAMES}, l AS (SELECT *, max(CASE WHEN kind = 'caps' THEN 1 ELSE 0 END) OVER (PARTITION BY pipeline_id ORDER BY frame_number ROWS UNBOUNDED PRECEDING) AS seen FROM frames)
  SELECT pipeline_id, frame_number, event_id FROM l WHERE seen = 1 AND kind = 'frame'""")
def output_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latched(bus(spark, sf_dir)).select("pipeline_id", "frame_number", "event_id")


@query(f"{SHED} SELECT pipeline_id, frame_number, event_id, kind FROM kept")
def bounded_buffer_shed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).select("pipeline_id", "frame_number", "event_id", "kind")


@query(f"{SHED} SELECT pipeline_id, frame_number, frame_number - lag(frame_number, 1, 0) OVER (PARTITION BY pipeline_id ORDER BY frame_number) - 1 AS missing FROM kept")
def frame_gaps_after_shed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.gaps(kept(spark, sf_dir)).select("pipeline_id", "frame_number", "missing")


@query(f"{SHED}, r AS (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY frame_number) AS n FROM kept) SELECT pipeline_id, frame_number FROM r WHERE n = frame_number")
def inorder_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.frontier(kept(spark, sf_dir)).select("pipeline_id", "frame_number")


@query(f"""{SHED} SELECT pipeline_id, frame_number, CAST(count(*) OVER w AS BIGINT) AS n, round(sum(value) OVER w, 4) AS total FROM kept
  WINDOW w AS (PARTITION BY pipeline_id ORDER BY frame_number ROWS UNBOUNDED PRECEDING)""")
def stateful_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.running(kept(spark, sf_dir), {"n": F.lit(1), "total": F.col("value")})
    return rows.select("pipeline_id", "frame_number", F.col("n").cast("long").alias("n"), F.round("total", 4).alias("total"))


@query("""SELECT pipeline_id, max(frame_number) AS last_frame, count(*) AS frames FROM (SELECT user_id AS pipeline_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_number
  FROM events) GROUP BY 1""")
def last_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are numbered without gaps, so a count is also the last number: no stream is sorted."""
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("pipeline_id")).agg(F.count("*").alias("frames"))
    return counts.select("pipeline_id", F.col("frames").alias("last_frame"), "frames")


@query("SELECT event_id, CASE WHEN 3 * (100 + event_id % 50) > 3 * (10 + event_id % 5) * 12 THEN 'size changed' END AS problem FROM events")
def oversize_frame_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", media.size_error(3 * (100 + i % 50), 10 + i % 5, F.lit(12)).alias("problem"))


PATHS = ["detect/annotate", "detect/pre-draw", " detect/track/annotate ", "", "missing", "annotate/other/more"]
PATH_SQL = "[" + ", ".join(f"'{p}'" for p in PATHS) + f"][CAST(event_id % {len(PATHS)} AS INTEGER) + 1]"
KNOWN = ["detect", "annotate", "pre_draw", "track"]


@query(f"""WITH p AS (SELECT event_id, list_transform(string_split(trim({PATH_SQL}), '/'), lambda s: replace(s, '-', '_')) AS path FROM events),
  m AS (SELECT event_id, path, list_filter(path, lambda s: NOT list_contains({KNOWN}, s))[1] AS missing FROM p)
  SELECT event_id, array_to_string(path, ' -> ') AS shown, len(path) AS stages, CASE WHEN missing IS NOT NULL THEN '`' || missing || '` stage does not exist' END AS problem FROM m""")
def path_parse_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*[F.lit(p) for p in PATHS]), (F.col("event_id") % len(PATHS)).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", media.sanitized(media.path_parts(text)).alias("path"))
    return rows.select("event_id", F.array_join("path", " -> ").alias("shown"), F.size("path").cast("long").alias("stages"), media.path_error(F.col("path"), KNOWN).alias("problem"))


def detect_and_annotate() -> Registry:
    """Three stages of expressions: read the payload, drop what fails, pack the result."""
    detect = Stage("detect").add(Hook(PRE, columns={"k": userdata.field(F.col("user_data"), "$.k")})).add(Hook(PROCESS, where=F.col("k").isNotNull() & (F.col("value") > 0)))
    score = Stage("score").add(Hook(PROCESS, columns={"score": F.round(F.col("value") * F.col("k"), 4)}))
    annotate = Stage("annotate").add(Hook(PROCESS, where=F.col("score") >= 10)).add(Hook(POST, columns={"packed": F.concat_ws("|", F.col("k").cast("string"), F.col("event_type"))}))
    return Registry(detect, score, annotate)


@query("""SELECT event_id, user_id AS pipeline_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, round(value * CAST(json_extract(props, '$.k') AS BIGINT), 4) AS score,
  CAST(json_extract(props, '$.k') AS VARCHAR) || '|' || event_type AS packed FROM events
  WHERE json_extract(props, '$.k') IS NOT NULL AND value > 0 AND round(value * CAST(json_extract(props, '$.k') AS BIGINT), 4) >= 10""")
def path_execute_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No stage of this path needs a stream's order, so frames aren't numbered and nothing is shuffled."""
    stages = detect_and_annotate()
    frames = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("pipeline_id"), F.col("props").alias("user_data"), "value", "event_type")
    return execute(frames, stages.path("detect/score/annotate"), stages).select("event_id", "pipeline_id", "k", "score", "packed")


@query("""SELECT event_id, CAST(TRY_CAST(substr(event_type, 1, 1) || CAST(event_id % 7 AS VARCHAR) AS INTEGER) AS INTEGER) AS v FROM events WHERE false
  UNION ALL SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id % 7 AS VARCHAR) END AS INTEGER) + 1 FROM events WHERE event_id % 3 <> 0""")
def hook_drop_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failing cast gives null, which drops the row before the next hook."""
    text = F.when(F.col("event_id") % 3 == 0, "x").otherwise((F.col("event_id") % 7).cast("string"))
    stage = Stage("s").add(Hook(PRE, columns={"v": text.try_cast("int")})).add(Hook(PROCESS, where=F.col("v").isNotNull())).add(Hook(POST, columns={"v": F.col("v") + 1}))
    return execute(table(spark, sf_dir, "events"), ["s"], Registry(stage)).select("event_id", "v")


@query("SELECT event_id, event_type AS original, upper(event_type) AS modified FROM events")
def original_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage("s").add(Hook(PROCESS, columns={"original": F.lit("lost"), "modified": F.upper("event_type")}))
    rows = table(spark, sf_dir, "events").withColumn("original", F.col("event_type"))
    return execute(rows, ["s"], Registry(stage)).select("event_id", "original", "modified")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def user_data_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", userdata.field(F.col("props"), "$.k").alias("k"))


PAYLOADS = ["", "null", "3", "2147483648", "2.5", "true", '"Hello!"', '[1,"3"]', '{"key1":0,"key3":{"inner1":"hola"}}', "not json"]
PAYLOAD_KINDS = ["empty", "empty", "integer", "float", "float", "integer", "string", "array", "dictionary", None]
_KINDS_SQL = "[" + ", ".join("NULL" if k is None else f"'{k}'" for k in PAYLOAD_KINDS) + "]"


@query(f"SELECT event_id, {_KINDS_SQL}[CAST(event_id % {len(PAYLOADS)} AS INTEGER) + 1] AS payload_kind FROM events")
def user_data_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*[F.lit(p) for p in PAYLOADS]), (F.col("event_id") % len(PAYLOADS)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("j")).select("event_id", userdata.kind(F.col("j")).alias("payload_kind"))


@query("SELECT user_id AS pipeline_id, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS key, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1, 2")
def kv_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("pipeline_id"), (userdata.field(F.col("props"), "$.k") % 5).alias("key"), "event_type", "ts", "event_id")
    return ops.last_write(rows, ["pipeline_id", "key"], "event_type", F.struct("ts", "event_id"))


@query("""WITH s AS (SELECT user_id, CAST(user_id AS VARCHAR) || ':detect:' || event_type AS key, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY ALL),
  f AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 90) SELECT key, value FROM s WHERE user_id NOT IN (SELECT user_id FROM f)""")
def kv_prefix_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    store = events.groupBy(ops.store_key(F.col("user_id"), F.lit("detect"), F.col("event_type")).alias("key")).agg(F.count("*").cast("string").alias("value"))
    return ops.without_streams(store, events.where("event_type = 'purchase' AND value > 90").select(F.col("user_id").alias("pipeline_id")))


@query("""SELECT user_id AS pipeline_id, arg_max(event_type || '=' || CAST(event_id % 9 AS VARCHAR), (ts, event_id)) AS tags FROM events GROUP BY 1""")
def tags_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat_ws("=", F.col("event_type"), (F.col("event_id") % 9).cast("string"))
    return ops.last_write(table(spark, sf_dir, "events").select(F.col("user_id").alias("pipeline_id"), tag.alias("tags"), "ts", "event_id"), ["pipeline_id"], "tags", F.struct("ts", "event_id"))


@query("""SELECT event_id, 'title=' || event_type || ', artist=' || CAST(user_id AS VARCHAR) || ',' || CAST(event_id % 9 AS VARCHAR) || ', date=' || strftime(ts, '%Y-%m-%dT%H:%M:%S') AS tags FROM events""")
def tags_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.create_map(
        F.lit("taglist"), F.array(F.lit("x")), F.lit("title"), F.array("event_type"), F.lit("artist"),
        F.array(F.col("user_id").cast("string"), (F.col("event_id") % 9).cast("string")), F.lit("date"), F.array(media.tag_date(F.col("ts"))))
    return table(spark, sf_dir, "events").select("event_id", media.format_tags(values).alias("tags"))


@query("""WITH s AS (SELECT event_id, 1 + event_id % 1920 AS w, 1 + (event_id * 7) % 1080 AS h FROM events), r AS (SELECT *, least(640 / CAST(w AS DOUBLE), 640 / CAST(h AS DOUBLE)) AS scale FROM s)
  SELECT event_id, round(scale, 6) AS scale, CAST(trunc(w * scale) AS INTEGER) AS width, CAST(trunc(h * scale) AS INTEGER) AS height,
  CAST(floor((640 - trunc(w * scale)) / 2) AS INTEGER) AS pad_left, CAST(floor((640 - trunc(h * scale)) / 2) AS INTEGER) AS pad_top FROM r""")
def letterbox_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = geometry.letterbox(1 + F.col("event_id") % 1920, 1 + (F.col("event_id") * 7) % 1080, 640, 640)
    rows = table(spark, sf_dir, "events").select("event_id", box.alias("b"))
    return rows.select("event_id", F.round("b.scale", 6).alias("scale"), F.col("b.width").alias("width"), F.col("b.height").alias("height"), F.col("b.left").alias("pad_left"), F.col("b.top").alias("pad_top"))


@query("""WITH s AS (SELECT event_id, 1 + event_id % 1920 AS w, 1 + (event_id * 7) % 1080 AS h FROM events)
  SELECT event_id, CAST(trunc(600 / (w / h)) AS INTEGER) AS fitted, CAST(floor((224 - h % 225) / 2.0) AS INTEGER) AS pad_top, CAST(224 - h % 225 - floor((224 - h % 225) / 2.0) AS INTEGER) AS pad_bottom,
  CAST(ceil(w / 32.0) * 32 AS INTEGER) AS padded, CAST(greatest(round_even((h + w + 3) / 2.0 * 0.003, 0), 2) AS INTEGER) AS line_width FROM s""")
def aspect_and_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = 1 + F.col("event_id") % 1920, 1 + (F.col("event_id") * 7) % 1080
    pad = geometry.centre_pad(F.lit(100), h % 225)
    return table(spark, sf_dir, "events").select("event_id", geometry.fit_width(w, h)["height"].alias("fitted"), pad["top"].alias("pad_top"), pad["bottom"].alias("pad_bottom"), geometry.ceil_to(w).alias("padded"), geometry.line_width(w, h).alias("line_width"))


@query("""WITH s AS (SELECT event_id, 1 + event_id % 1920 AS w, 1 + (event_id * 7) % 1080 AS h FROM events),
  r AS (SELECT event_id, w, h, CASE WHEN h > w THEN ceil(w * (256.0::DOUBLE / h)) ELSE 256 END AS sw, CASE WHEN h > w THEN 256 ELSE ceil(h * (256.0::DOUBLE / w)) END AS sh FROM s)
  SELECT event_id, CAST(sw AS INTEGER) AS width, CAST(sh AS INTEGER) AS height, CAST(CASE WHEN h > w THEN ceil(sw / 32) * 32 ELSE 256 END AS INTEGER) AS input_width,
  CAST(CASE WHEN h > w THEN 256 ELSE ceil(sh / 32) * 32 END AS INTEGER) AS input_height FROM r""")
def pose_input_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = geometry.fit_longer(1 + F.col("event_id") % 1920, 1 + (F.col("event_id") * 7) % 1080)
    return table(spark, sf_dir, "events").select("event_id", size.alias("s")).select("event_id", "s.*")


ANGLE = "CASE WHEN atan2(value - 50, CAST(event_id % 101 AS DOUBLE) - 50) < 0 THEN atan2(value - 50, CAST(event_id % 101 AS DOUBLE) - 50) + 2 * pi() ELSE atan2(value - 50, CAST(event_id % 101 AS DOUBLE) - 50) END"


def _angle() -> Column:
    return geometry.angle((F.col("event_id") % 101).cast("double") - 50, F.col("value") - 50)


@query(f"SELECT event_id, round({ANGLE}, 6) AS angle FROM events")
def gaze_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(_angle(), 6).alias("angle"))


@query(f"WITH a AS (SELECT event_id, {ANGLE} AS a FROM events) SELECT event_id, CASE " + " ".join(f"WHEN a > {2 * k - 1} * pi() / 8 AND a < {2 * k + 1} * pi() / 8 THEN {k}" for k in range(1, 8)) + " END AS sector FROM a")
def gaze_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", _angle().alias("a")).select("event_id", geometry.sector(F.col("a")).alias("sector"))


@query("""SELECT event_id, sqrt((value - 50) * (value - 50) + (event_id % 101 - 50.0) * (event_id % 101 - 50.0)) > 20 AS outside, 640 - event_id % 640 - 1 AS mirrored,
  CAST(trunc(value / 100 * 640) AS INTEGER) AS px, CAST(trunc((event_id % 97) / 97.0 * 480) AS INTEGER) AS py FROM events""")
def circle_mirror_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    at = geometry.pixel(v / 100, (i % 97) / 97.0, F.lit(640), F.lit(480))
    return table(spark, sf_dir, "events").select("event_id", geometry.outside_circle(v, (i % 101).cast("double"), F.lit(50.0), F.lit(50.0)).alias("outside"), geometry.mirror(i % 640, F.lit(640)).alias("mirrored"), at["x"].alias("px"), at["y"].alias("py"))


@query("""SELECT event_id, list_transform(range(8), lambda k: CAST(trunc(320 + (event_id % 50) * cos(pi() / 8 + k * pi() / 4)) AS INTEGER)) AS xs,
  list_transform(range(CAST(ceil(800 / (10 + event_id % 50)) AS BIGINT)), lambda i: CAST(trunc(sin(440 * i / CAST(800 AS DOUBLE) * (2 * pi())) * 0.5 * 32767) AS SMALLINT)) AS wave FROM events""")
def rays_and_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    ends = geometry.rays(F.lit(320), F.lit(240), i % 50)
    return table(spark, sf_dir, "events").select("event_id", F.transform(ends, lambda p: p["x"]).alias("xs"), geometry.tone(F.lit(440), F.lit(800), 10 + i % 50).alias("wave"))


@query(f"""{FRAMES}, c AS (SELECT pipeline_id, min(frame_number) AS frame_number, round(arg_min(value, frame_number), 6) AS value FROM frames WHERE kind = 'caps' GROUP BY 1) SELECT * FROM c""")
def first_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_caps(bus(spark, sf_dir)).select("pipeline_id", "frame_number", F.round("value", 6).alias("value"))


@query(f"{FRAMES} SELECT pipeline_id, frame_number, upper(event_type) AS label, 'caps|' || CAST(frame_number AS VARCHAR) AS note FROM frames WHERE event_type <> 'error'")
def python_hook_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Python hooks in one pass; the first fails for errors, which drops those rows."""

    def first(row: dict, context: dict) -> None:
        if row["event_type"] == "error":
            raise ValueError("no frame")
        row["label"] = row["event_type"].upper()

    def second(row: dict, context: dict) -> None:
        row["note"] = f"caps|{row['frame_number']}"

    text = T.StringType()
    stages = Registry(Stage("a").add(Hook(PROCESS, frame=first, writes={"label": text})), Stage("b").add(Hook(PROCESS, frame=second, writes={"note": text})))
    rows = bus(spark, sf_dir).select("pipeline_id", "frame_number", "event_type")
    return execute(rows, stages.path("a/b"), stages).select("pipeline_id", "frame_number", "label", "note")


@query(f"{FRAMES} SELECT pipeline_id, frame_number, CAST(count(*) OVER w AS BIGINT) AS n FROM frames WINDOW w AS (PARTITION BY pipeline_id ORDER BY frame_number ROWS UNBOUNDED PRECEDING)")
def python_hook_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stateful Python hook counts the frames of its stream."""

    def count(row: dict, context: dict) -> None:
        context["state"]["n"] = row["n"] = context["state"].get("n", 0) + 1

    stages = Registry(Stage("count").add(Hook(PROCESS, frame=count, writes={"n": T.LongType()}, stateful=True)))
    return execute(bus(spark, sf_dir).select("pipeline_id", "frame_number"), ["count"], stages)
