"""Stages, hooks and frame paths: a path is a fold of DataFrame transformations.

Declarative hooks stay expressions, so Catalyst pushes their filters down and prunes columns through them. Neighbouring
stateless Python hooks become one mapInPandas over the columns they read, write or pass on; stateful hooks get their
stream's frames in order, whatever tasks the streams fall in.
"""

from __future__ import annotations

import importlib.util
import json
import logging
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

PRE, PROCESS, POST = KINDS = ("pre", "process", "post")
PROTECTED = "original"
log = logging.getLogger(__name__)


class StageNotFound(ValueError):
    """Names the first stage of a path that isn't registered."""


@dataclass(frozen=True)
class Hook:
    """A step of a stage.

    columns: expressions by column name; where: rows that go on (null drops a row). Or frame: a function that changes a
    row's dict in place, given the stage's context; what it returns is ignored, an error drops the row. writes: types of
    columns that frame adds or replaces. stateful: frame gets the frames of a stream one after another, with the
    stream's own dict under "state" of the context.
    """

    kind: str
    columns: dict[str, Column] = field(default_factory=dict)
    where: Column | None = None
    frame: Callable[[dict, dict], object] | None = None
    writes: dict[str, T.DataType] = field(default_factory=dict)
    stateful: bool = False
    rows: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown hook kind {self.kind}")


@dataclass
class Stage:
    """At most one hook of each kind, and a context that init() builds once in each worker."""

    name: str
    hooks: dict[str, Hook] = field(default_factory=dict)
    init: Callable[[], dict] = dict

    def add(self, hook: Hook) -> Stage:
        if hook.kind in self.hooks:
            log.error("stage %s already has a %s hook; the second is ignored", self.name, hook.kind)
        else:
            self.hooks[hook.kind] = hook
        return self

    def ordered(self) -> list[Hook]:
        return [self.hooks[k] for k in KINDS if k in self.hooks]


class Registry:
    """Stages by name."""

    def __init__(self, *stages: Stage) -> None:
        self.stages = {s.name.replace("-", "_"): s for s in stages}

    def path(self, text: str) -> list[str]:
        """Names in a path such as detect/annotate; the first that isn't registered is an error."""
        names = text.strip().split("/")
        for name in names:
            if name not in self.stages:
                raise StageNotFound(f"`{name}` stage does not exist")
        return names

    @staticmethod
    def from_dir(folder: str | Path, writes: dict[str, T.DataType] | None = None) -> Registry:
        """A stage for each folder: init.py, and pre-process, process and post-process files in .py or .json.

        A Python hook whose first line is `# make stateful` is stateful; a JSON hook declares an inference.
        """
        from strandline.operators.inference import InferenceSpec, inference_hook

        kinds = {"pre_process": PRE, "process": PROCESS, "post_process": POST}
        found = []
        for place in sorted(p for p in Path(folder).iterdir()):
            if not place.is_dir():
                log.warning("%s is not a stage folder", place)
                continue
            stage = Stage(place.name.replace("-", "_"))
            for file in sorted(place.iterdir()):
                stem, dot, ending = file.name.partition(".")
                stem = stem.replace("-", "_")
                if not dot or ending not in ("py", "json"):
                    continue
                if stem == "init" and ending == "py":
                    stage.init = _Loaded(file.read_text(), "init")
                elif stem in kinds and ending == "py":
                    source = file.read_text()
                    stage.add(Hook(kinds[stem], frame=_Loaded(source, "hook"), writes=writes or {}, stateful=source.split("\n", 1)[0].strip() == "# make stateful"))
                elif stem in kinds:
                    stage.add(inference_hook(InferenceSpec.parse(json.loads(file.read_text())), kinds[stem]))
            found.append(stage)
        return Registry(*found)


class _Loaded:
    """A function of a source text; workers load it once."""

    known: dict[str, dict] = {}

    def __init__(self, source: str, name: str) -> None:
        self.source, self.name = source, name

    def __call__(self, *args):
        space = _Loaded.known.get(self.source)
        if space is None:
            spec = importlib.util.spec_from_loader("strandline_hook", loader=None)
            space = vars(importlib.util.module_from_spec(spec))
            exec(self.source, space)  # noqa: S102  the user's own hook files
            _Loaded.known[self.source] = space
        return space[self.name](*args)


_contexts: dict[tuple[str, str], dict] = {}


def _context(plan: str, name: str, init: Callable[[], dict]) -> dict:
    """Of a stage in a plan, built once in each worker; an init that fails gives an empty one."""
    if (plan, name) not in _contexts:
        try:
            _contexts[plan, name] = init()
        except Exception:
            log.exception("init of stage %s failed", name)
            _contexts[plan, name] = {}
    return _contexts[plan, name]


def _python(df: DataFrame, steps: list[tuple[Stage, Hook]], key: str, order: str, errors: str) -> DataFrame:
    """One Python pass for hooks that follow each other; stateful ones after a shuffle by stream."""
    added = {n: t for _, h in steps for n, t in h.writes.items() if n != PROTECTED}
    schema = T.StructType([f for f in df.schema.fields if f.name not in added] + [T.StructField(n, t) for n, t in added.items()])
    keep_errors = errors == "keep"
    if keep_errors and "hook_error" not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField("hook_error", T.StringType())])
    names, before = schema.names, df.columns
    work = [(s.name, s.init, h.frame, h.stateful) for s, h in steps]  # what the workers need
    stateful = any(h.stateful for _, h in steps)
    plan = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[int, dict] = {}
        failed: set[int] = set()
        current = None
        for batch in batches:
            out = []
            for values in batch.itertuples(index=False, name=None):
                row = dict(zip(before, values, strict=True))
                if stateful and row[key] != current:
                    current, states = row[key], {}
                if row.get("hook_error") is not None:
                    out.append(row)
                    continue
                original = row.get(PROTECTED)
                for i, (stage, init, frame, keeps_state) in enumerate(work):
                    context = _context(plan, stage, init)
                    if keeps_state:
                        context = {**context, "state": states.setdefault(i, {})}
                    try:
                        frame(row, context)
                    except Exception as e:
                        if i not in failed:  # once a task
                            failed.add(i)
                            log.warning("hook of stage %s failed: %s", stage, e)
                        row = {**dict(zip(before, values, strict=True)), "hook_error": f"{stage}: {e}"} if keep_errors else None
                        break
                    if PROTECTED in row:
                        row[PROTECTED] = original
                if row is not None:
                    out.append(row)
            yield pd.DataFrame([[r.get(n) for n in names] for r in out], columns=names, dtype=object)

    if stateful:
        df = df.repartition(key).sortWithinPartitions(key, order)
    return df.mapInPandas(run, schema)


def execute(df: DataFrame, path: list[str], registry: Registry, key: str = "pipeline_id", order: str = "frame_number", errors: str = "drop") -> DataFrame:
    """Every hook of every stage of the path, in order. Stages that are gone are skipped with a warning.

    errors: drop rows whose Python hook fails, or keep them as they came, with hook_error, past the remaining hooks.
    """
    steps: list[tuple[Stage, Hook]] = []
    for name in path:
        if name in registry.stages:
            steps += [(registry.stages[name], h) for h in registry.stages[name].ordered()]
        else:
            log.warning("stage %s does not exist any more; it is skipped", name)
    runs: list[list[tuple[Stage, Hook]]] = []
    for step in steps:
        if runs and step[1].frame and runs[-1][-1][1].frame and step[1].stateful == runs[-1][-1][1].stateful:
            runs[-1].append(step)
        else:
            runs.append([step])

    def apply(d: DataFrame, run: list[tuple[Stage, Hook]]) -> DataFrame:
        hook = run[0][1]
        if hook.frame:
            return _python(d, run, key, order, errors)
        if hook.rows:
            return hook.rows(d)
        if hook.columns:
            d = d.withColumns({n: c for n, c in hook.columns.items() if n != PROTECTED})
        return d if hook.where is None else d.where(hook.where)

    return reduce(apply, runs, df)
