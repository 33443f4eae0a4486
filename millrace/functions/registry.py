"""Named functions from DataFrame to DataFrame."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]

# Kinds of function, and the versions a lookup tries when none is given.
KINDS = ("start", "normal", "end")
DEFAULT_VERSIONS = ("v1", "latest")


class Registry:
    """Functions by name and version."""

    def __init__(self) -> None:
        self._steps: dict[tuple[str, str], Step] = {}
        self._kinds: dict[tuple[str, str], str] = {}

    def register(self, name: str, version: str = "v1", kind: str = "normal") -> Callable[[Step], Step]:
        """Decorator that adds a function; the same name and version twice is an error."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind of function {kind!r}")

        def add(step: Step) -> Step:
            if (name, version) in self._steps:
                raise ValueError(f"{name}:{version} is registered already")
            self._steps[name, version] = step
            self._kinds[name, version] = kind
            return step

        return add

    def get(self, name: str, version: str | None = None) -> Step:
        """Without a version ``v1`` is tried, then ``latest``."""
        for candidate in (version,) if version else DEFAULT_VERSIONS:
            if (name, candidate) in self._steps:
                return self._steps[name, candidate]
        raise KeyError(f"function {name}:{version or '/'.join(DEFAULT_VERSIONS)} is not registered")

    def names(self, kind: str | None = None) -> list[str]:
        return sorted(f"{n}:{v}" for (n, v), k in self._kinds.items() if kind in (None, k))

    def count_by_kind(self) -> dict[str, int]:
        return dict(Counter(self._kinds.values()))


registry = Registry()


@registry.register("identity", "v1", "normal")
def identity(df: DataFrame) -> DataFrame:
    return df


def chain(df: DataFrame, steps: Iterable[str | Step]) -> DataFrame:
    """Run steps one after the other; each sees the columns of those before. Spark plans them as one job,
    and the first failing step fails it."""
    for step in steps:
        df = df.transform(registry.get(step) if isinstance(step, str) else step)
    return df
