"""The function library: each function builds Columns from Columns."""

from __future__ import annotations

from collections.abc import Callable

#: name -> (fewest, most arguments, builder)
REGISTRY: dict[str, tuple[int, int, Callable]] = {}


def function(name: str, fewest: int = 0, most: int | None = None):
    """Register a builder fn(compiler, input, argument nodes, scope) -> Coll."""

    def put(fn):
        if name in REGISTRY:
            raise ValueError(f"function {name} is registered twice")
        REGISTRY[name] = (fewest, fewest if most is None else most, fn)
        return fn

    return put


def load() -> None:
    from pathloom.functions import collections, convert, dates, fhir, maths, strings  # noqa: F401
