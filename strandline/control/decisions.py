"""Decisions on the control table as set-based DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The target state after a stream ends, by restart policy and reason.
TRANSITIONS = {
    "never": {"completed": "completed", "error": "error", "updated": "running"},
    "always": {"completed": "running", "error": "running", "updated": "running"},
    "on_error": {"completed": "error", "error": "running", "updated": "error"},
    "on_eos": {"completed": "running", "error": "completed", "updated": "completed"},
}


def next_state(policy: Column, reason: Column) -> Column:
    """Null for a policy or reason that doesn't exist."""
    out = F.lit(None).cast("string")
    for p, by in TRANSITIONS.items():
        for r, state in by.items():
            out = F.when((policy == p) & (reason == r), state).otherwise(out)
    return out


def effective_policy(policy: Column, input_uri: Column, output_uri: Column) -> Column:
    """Streams from or to files never restart."""
    file = input_uri.startswith("file://") | F.coalesce(output_uri.startswith("file://"), F.lit(False))
    return F.when(file, "never").otherwise(F.coalesce(policy, F.lit("never")))


def entry_hash(input_uri: Column, output_uri: Column, path: Column, policy: Column) -> Column:
    """Differs when any part does: of the parts as JSON, so that swapped URIs and moved separators differ too."""
    return F.md5(F.to_json(F.struct(input_uri.alias("i"), output_uri.alias("o"), path.alias("p"), policy.alias("r"))))


def add_errors(requests: DataFrame) -> DataFrame:
    """status, message of requests to add a stream."""
    bad = F.col("input_uri").isNull() | F.col("frame_path").isNull()
    return requests.withColumns({"status": F.when(bad, 400).otherwise(200), "message": F.when(bad, "input_uri and frame_path are required")})


def updated(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Entries after requests of the same id: fields that a request leaves out (or an empty path) stay as they are."""
    r = requests.select("id", *[F.col(c).alias(f"_{c}") for c in ("input_uri", "output_uri", "frame_path", "restart_policy")])
    path = F.when(F.size("_frame_path") > 0, F.col("_frame_path"))
    return entries.join(r, "id", "left").select(
        "id", F.coalesce("_input_uri", "input_uri").alias("input_uri"), F.coalesce("_output_uri", "output_uri").alias("output_uri"),
        F.coalesce(path, "frame_path").alias("frame_path"), F.coalesce("_restart_policy", "restart_policy").alias("restart_policy"),
        *[c for c in entries.columns if c not in ("id", "input_uri", "output_uri", "frame_path", "restart_policy")])


def removed(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("id").distinct(), "id", "left_anti")


def to_restart(entries: DataFrame, managers: DataFrame) -> DataFrame:
    """Entries changed since they were stored, whose pipeline runs."""
    changed = entries.where(F.col("pipeline_id").isNotNull() & (F.col("stored_hash") != F.col("hash")))
    return changed.join(managers.select("pipeline_id").distinct(), "pipeline_id", "left_semi")


def to_create(entries: DataFrame) -> DataFrame:
    """Entries that should run and have no pipeline."""
    return entries.where(F.col("pipeline_id").isNull() & (F.col("target_state") == "running"))


def orphans(managers: DataFrame, entries: DataFrame) -> DataFrame:
    """Running pipelines that no entry names."""
    return managers.join(entries.select("pipeline_id").where("pipeline_id is not null").distinct(), "pipeline_id", "left_anti")


def reconcile(entries: DataFrame, managers: DataFrame) -> DataFrame:
    """action (restart, create, stop), id, pipeline_id: all that brings the running pipelines in line with the table."""
    pick = lambda d, action: d.select(F.lit(action).alias("action"), "id", "pipeline_id")
    stop = orphans(managers, entries).select(F.lit("stop").alias("action"), F.lit(None).cast("string").alias("id"), "pipeline_id")
    return pick(to_restart(entries, managers), "restart").union(pick(to_create(entries), "create")).union(stop)


def rolled_back(entries: DataFrame, failed: DataFrame) -> DataFrame:
    """Entries without those whose start failed."""
    return removed(entries, failed)


def taken(entries: DataFrame) -> DataFrame:
    """Pipelines that more than one entry names."""
    named = entries.where("pipeline_id is not null").groupBy("pipeline_id").count()
    return named.where("count > 1").select("pipeline_id", F.col("count").alias("entries"))


def finished_event(state: Column, stream: Column) -> Column:
    """JSON of the end of a stream; a stream that isn't known has the nil UUID."""
    nil = F.lit("00000000-0000-0000-0000-000000000000")
    return F.to_json(F.struct(F.lit("StreamFinished").alias("type"), state.alias("end_state"), F.coalesce(stream, nil).alias("stream_uuid")))


def start_error_event(stream: Column) -> Column:
    return F.to_json(F.struct(F.lit("StreamStartError").alias("type"), stream.alias("stream_uuid")))
