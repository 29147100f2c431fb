"""URIs, capabilities, tags and times of streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTPUTS = ("file", "rtmp", "rtsp", "screen")


def uri_protocol(uri: Column) -> Column:
    """screen and v4l2 stand for themselves; else what stands before ://, null without one."""
    return F.when(uri == "screen", "screen").when(uri.startswith("v4l2"), "v4l2").when(F.instr(uri, "://") > 0, F.substring_index(uri, "://", 1))


def uri_location(uri: Column) -> Column:
    """What stands between the first :// and the next; null without one."""
    return F.when(uri == "screen", "screen").when(uri.startswith("v4l2"), "v4l2").when(F.instr(uri, "://") > 0, F.split_part(uri, F.lit("://"), F.lit(2)))


def uri_error(uri: Column) -> Column:
    """Why a URI can't be used; null if it can."""
    relative = (uri_protocol(uri) == "file") & ~uri_location(uri).startswith("/")
    devices = uri.startswith("v4l2") & (F.length(uri) - F.length(F.replace(uri, F.lit(":"))) > 1)
    return F.when(uri_protocol(uri).isNull(), "no protocol").when(relative, "relative file path").when(devices, "more than one device")


def checked_uri(uri: Column) -> Column:
    """The URI; an unusable one fails the query."""
    return F.when(uri_error(uri).isNotNull(), F.raise_error(F.concat(uri_error(uri), F.lit(": "), uri))).otherwise(uri)


def sink_kind(output_uri: Column) -> Column:
    """Which sink a stream's output needs: none, file (.mp4 only), rtmp, rtsp, screen or unsupported."""
    protocol = uri_protocol(output_uri)
    return (
        F.when(output_uri.isNull() | (output_uri == ""), "none")
        .when((protocol == "file") & ~output_uri.endswith(".mp4"), "unsupported")
        .when(protocol.isin(*OUTPUTS), protocol)
        .otherwise("unsupported")
    )


def caps_text(width: Column, height: Column, num: Column, den: Column) -> Column:
    """Capabilities of an output that equals its input."""
    return F.format_string("video/x-raw, format=(string)RGB, width=(int)%d, height=(int)%d, framerate=(fraction)%d/%d", width, height, num, den)


def caps_int(caps: Column, field: str) -> Column:
    """An integer field; null if it isn't there."""
    return F.regexp_extract(caps, rf"(?:^|[\s,]){field}=(?:\(int\))?(-?\d+)", 1).try_cast("int")


def caps_fraction(caps: Column, field: str) -> Column:
    """A fraction field as (num, den); null parts if it isn't there."""
    part = lambda i: F.regexp_extract(caps, rf"(?:^|[\s,]){field}=(?:\(fraction\))?(-?\d+)/(\d+)", i).try_cast("int")
    return F.struct(part(1).alias("num"), part(2).alias("den"))


def whole_fps(num: Column, den: Column) -> Column:
    """Frames a second by integer division, as a byte: 30000/1001 is 29, 1/30 is 0."""
    return (F.floor(num / den) % 256).cast("smallint")


def millis(ts: Column) -> Column:
    """Whole milliseconds since the epoch; what is finer is cut off."""
    return F.unix_millis(ts.cast("timestamp"))


def format_tags(tags: Column) -> Column:
    """map<string, array<string>> as `k=v` joined by ", ", several values by ","; the entry taglist is left out."""
    entries = F.filter(F.map_entries(tags), lambda e: e["key"] != "taglist")
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ","))), ", ")


def tag_date(ts: Column) -> Column:
    """ISO form of a date tag."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def sanitized(path: Column) -> Column:
    """Stage names with _ for -."""
    return F.transform(path, lambda s: F.replace(s, F.lit("-"), F.lit("_")))


def path_parts(text: Column) -> Column:
    """Stage names of a path such as detect/annotate."""
    return F.split(F.trim(text), "/")


def first_missing(path: Column, known: list[str]) -> Column:
    """The first stage of a path that the registry lacks; null if it has all."""
    return F.get(F.filter(path, lambda s: ~s.isin(*known)), 0)


def path_error(path: Column, known: list[str]) -> Column:
    return F.when(first_missing(path, known).isNotNull(), F.concat(F.lit("`"), first_missing(path, known), F.lit("` stage does not exist")))


def size_error(size: Column, width: Column, height: Column) -> Column:
    """A frame may be smaller than the output's buffer, not larger."""
    return F.when(size > width * height * 3, "size changed")
