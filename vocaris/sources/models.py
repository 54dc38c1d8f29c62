"""Models that workers hold: loaded once in each Python worker, kept over tasks.

A model is known by name, revision and files. Its loader is a function named by ``module:function``, so
that a task carries a few strings and no model. Files are shipped once to each executor by Spark; a
revision is the SHA-256 of the files, which a worker checks before it loads them.
"""

from __future__ import annotations

import hashlib
import importlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ModelSpec:
    name: str
    loader: str  # "module:function", called with the paths of the files and the options
    revision: str | None = None
    files: tuple[str, ...] = ()
    options: tuple[tuple[str, Any], ...] = ()

    def shipped(self, spark: SparkSession) -> ModelSpec:
        """The spec with its files on the way to all executors, and the revision that they have now, which
        must be the one asked for if that is given."""
        found = digest(self.files) if self.files else self.revision
        if self.files and self.revision is not None and found != self.revision:
            raise ValueError(f"{self.name}: files have revision {found}, not {self.revision}")
        for path in self.files:
            spark.sparkContext.addFile(path)
        return replace(self, revision=found, files=tuple(os.path.basename(p) for p in self.files))


def digest(paths: tuple[str, ...]) -> str:
    """SHA-256 over the files' names and bytes in order."""
    h = hashlib.sha256()
    for path in paths:
        h.update(os.path.basename(path).encode() + b"\0")
        with open(path, "rb") as f:
            while chunk := f.read(1 << 20):
                h.update(chunk)
    return h.hexdigest()


#: Of this process, which is one Python worker on an executor.
_held: dict[ModelSpec, Any] = {}


def held(spec: ModelSpec) -> Any:
    """The worker's instance of a model, loaded at first use."""
    if spec not in _held:
        paths = tuple(SparkFiles.get(name) for name in spec.files)
        if paths and spec.revision is not None and digest(paths) != spec.revision:
            raise ValueError(f"{spec.name}: an executor has other files than those of revision {spec.revision}")
        module, _, function = spec.loader.partition(":")
        # another revision of a model takes the place of the one before
        for old in [k for k in _held if k.name == spec.name]:
            del _held[old]
        _held[spec] = getattr(importlib.import_module(module), function)(*paths, **dict(spec.options))
    return _held[spec]


class Held:
    """A model for sources.audio and plans.recordings: the spec travels, the worker's instance is called.
    An instance with memory (``reset``) or modes (``set_mode``) keeps them."""

    def __init__(self, spec: ModelSpec):
        self.spec = spec

    def __call__(self, *args: Any) -> Any:
        return held(self.spec)(*args)

    def reset(self) -> None:
        getattr(held(self.spec), "reset", lambda: None)()

    def set_mode(self, mode: int) -> None:
        getattr(held(self.spec), "set_mode", lambda _: None)(mode)


def apply(rows: DataFrame, spec: ModelSpec, column: str, output: str, kind: str = "array<float>", batch: Callable[[Any, list[np.ndarray]], list] | None = None) -> DataFrame:
    """rows with ``output``, the model's answer for the array in ``column`` (null for null). batch(model,
    inputs) answers a whole Arrow batch at a time, for models that are faster so."""
    fields = [f for f in rows.schema.fields if f.name.lower() != output.lower()]
    names = [f.name for f in fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{output}` {kind}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held(spec)
        for part in parts:
            there = part[column].notna().to_numpy()
            inputs = [np.asarray(x) for x in part[column][there]]
            answers = batch(model, inputs) if batch else [model(x) for x in inputs]
            out = np.full(len(part), None, dtype=object)
            for at, answer in zip(np.flatnonzero(there), answers):
                out[at] = answer
            yield part[names].assign(**{output: out})

    return rows.mapInPandas(run, ddl)
