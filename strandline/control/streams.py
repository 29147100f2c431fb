"""The control table as an object, and a supervisor that runs a streaming query for each entry."""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandline import schemas
from strandline.control.decisions import TRANSITIONS
from strandline.plans.path import Registry, StageNotFound

log = logging.getLogger(__name__)
# Spellings of restart policies.
SPELLINGS = {"never": "never", "always": "always", "on_error": "on_error", "onerror": "on_error", "on-error": "on_error", "on_eos": "on_eos", "oneos": "on_eos", "on-eos": "on_eos"}


class NotFound(KeyError):
    """No entry of that id."""


@dataclass(frozen=True)
class Entry:
    """A stream: where it comes from and goes to, its stages, and when it starts again."""

    input_uri: str
    frame_path: tuple[str, ...]
    output_uri: str | None = None
    restart_policy: str = "never"
    target_state: str = "running"
    pipeline_id: str | None = None
    id: str = field(default_factory=lambda: str(uuid.uuid4()))

    def __post_init__(self) -> None:
        policy = SPELLINGS.get(self.restart_policy.lower())
        if policy is None:
            raise ValueError(f"unknown restart policy {self.restart_policy}")
        if policy != "never" and any((u or "").startswith("file://") for u in (self.input_uri, self.output_uri)):
            log.warning("stream %s reads or writes a file; its policy is never", self.id)
            policy = "never"
        object.__setattr__(self, "restart_policy", policy)
        object.__setattr__(self, "frame_path", tuple(s.replace("-", "_") for s in self.frame_path))

    def signature(self) -> tuple:
        return self.input_uri, self.output_uri, self.frame_path, self.restart_policy


class Streams:
    """add, update, remove, list and assign, for many threads; on_change is called after each change."""

    def __init__(self, on_change: Callable[[], None] = lambda: None) -> None:
        self._entries: dict[str, Entry] = {}
        self._lock = threading.RLock()
        self.on_change = on_change

    def add(self, input_uri: str, frame_path: list[str], output_uri: str | None = None, restart_policy: str = "never") -> Entry:
        """Streams with equal URIs are allowed."""
        if not input_uri or not frame_path:
            raise ValueError("input_uri and frame_path are required")
        entry = Entry(input_uri, tuple(frame_path), output_uri or None, restart_policy)
        with self._lock:
            self._entries[entry.id] = entry
        self.on_change()
        return entry

    def get(self, id_: str) -> Entry:
        with self._lock:
            if id_ not in self._entries:
                raise NotFound(id_)
            return self._entries[id_]

    def update(self, id_: str, **changes: object) -> Entry:
        """Fields that are None, and an empty path, stay. The running pipeline is let go and one for the new entry starts."""
        with self._lock:
            known = {k: v for k, v in changes.items() if v}
            if "frame_path" in known:
                known["frame_path"] = tuple(known["frame_path"])
            self._entries[id_] = entry = replace(self.get(id_), pipeline_id=None, **known)
        self.on_change()
        return entry

    def remove(self, id_: str) -> Entry:
        with self._lock:
            entry = self.get(id_)
            del self._entries[id_]
        self.on_change()
        return entry

    def list(self) -> list[Entry]:
        with self._lock:
            return list(self._entries.values())

    def assign(self, id_: str, pipeline_id: str) -> None:
        with self._lock:
            if any(e.pipeline_id == pipeline_id for e in self._entries.values()):
                raise ValueError(f"pipeline {pipeline_id} is assigned already")
            self._entries[id_] = replace(self.get(id_), pipeline_id=pipeline_id)

    def by_pipeline(self, pipeline_id: str) -> Entry | None:
        return next((e for e in self.list() if e.pipeline_id == pipeline_id), None)

    def finish(self, pipeline_id: str, reason: str) -> Entry | None:
        """The entry of a pipeline that ended, let go, in the state that its policy gives."""
        with self._lock:
            entry = self.by_pipeline(pipeline_id)
            if entry is not None:
                entry = replace(entry, pipeline_id=None, target_state=TRANSITIONS[entry.restart_policy][reason])
                self._entries[entry.id] = entry
        return entry

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [{**asdict(e), "frame_path": list(e.frame_path), "hash": hash(e.signature())} for e in self.list()]
        return spark.createDataFrame([tuple(r[n] for n in schemas.STREAM.names) for r in rows], schemas.STREAM)


class Supervisor:
    """Starts a query for each entry that should run, stops those that no entry names, and restarts by policy.

    start(entry, pipeline_id) starts the entry's query. export(event) gets the lifecycle events as dicts.
    """

    def __init__(self, streams: Streams, registry: Registry, start: Callable[[Entry, str], StreamingQuery], export: Callable[[dict], None] = lambda e: None) -> None:
        self.streams, self.registry, self.start, self.export = streams, registry, start, export
        self.running: dict[str, tuple[StreamingQuery, tuple]] = {}

    def reconcile(self) -> None:
        """One pass: stop orphans and changed pipelines, start what is missing. A start that fails deletes its entry."""
        entries = {e.pipeline_id: e for e in self.streams.list() if e.pipeline_id}
        for pipeline in [p for p in self.running if p not in entries]:
            self.running.pop(pipeline)[0].stop()
        for pipeline, (query, signature) in list(self.running.items()):
            if entries[pipeline].signature() != signature:
                query.stop()
                self._ended(pipeline, "updated")
        for entry in self.streams.list():
            if entry.pipeline_id or entry.target_state != "running":
                continue
            pipeline = str(uuid.uuid4())
            try:
                self.registry.path("/".join(entry.frame_path))
            except StageNotFound as e:
                log.error("stream %s: %s", entry.id, e)
                self.streams.remove(entry.id)
                continue
            try:
                query = self.start(entry, pipeline)
                self.streams.assign(entry.id, pipeline)
                self.running[pipeline] = query, entry.signature()
            except Exception:
                log.exception("stream %s can't start", entry.id)
                self.streams.remove(entry.id)
                self.export({"type": "StreamStartError", "stream_uuid": entry.id})

    def poll(self) -> None:
        """Settle queries that ended by themselves, then reconcile."""
        for pipeline, (query, _) in list(self.running.items()):
            if not query.isActive:
                self._ended(pipeline, "error" if query.exception() else "completed")
        self.reconcile()

    def _ended(self, pipeline: str, reason: str) -> None:
        self.running.pop(pipeline, None)
        entry = self.streams.finish(pipeline, reason)
        self.export({"type": "StreamFinished", "end_state": reason, "stream_uuid": entry.id if entry else str(uuid.UUID(int=0))})
