"""Registry of steps: functions DataFrame -> DataFrame, looked up by dotted name and chained."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame

Step = Callable[..., DataFrame]
_STEPS: dict[str, Step] = {}


def step(name: str) -> Callable[[Step], Step]:
    def add(f: Step) -> Step:
        _STEPS[name] = f
        return f

    return add


def find(name: str) -> Step:
    """A registered step, or a function of the package by its dotted path (``operators.vocab.cap``)."""
    if name in _STEPS:
        return _STEPS[name]
    module, _, attribute = name.rpartition(".")
    try:
        return getattr(importlib.import_module(f"tesserae.{module}"), attribute)
    except (ImportError, AttributeError) as e:
        raise KeyError(f"no step {name}") from e


def chain(df: DataFrame, steps: list) -> DataFrame:
    """Apply names, or (name, keyword arguments), in order."""
    for s in steps:
        name, kw = (s, {}) if isinstance(s, str) else s
        df = df.transform(lambda d, f=find(name), kw=kw: f(d, **kw))
    return df
