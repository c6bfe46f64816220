"""Registries of extractors, analyzers and contract checkers, and runs that go on when one of them fails."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Named callables; the last one registered under a name counts."""

    def __init__(self):
        self._known: dict[str, Callable] = {}

    def register(self, *names: str) -> Callable[[Callable], Callable]:
        def add(f: Callable) -> Callable:
            self._known.update(dict.fromkeys(names, f))
            return f

        return add

    def __getitem__(self, name: str) -> Callable:
        return self._known[name]

    def __contains__(self, name: str) -> bool:
        return name in self._known

    def names(self) -> list[str]:
        return sorted(self._known)

    def enabled(self, only: Iterable[str] = (), without: Iterable[str] = ()) -> list[str]:
        """Names to run: those asked for or all, but for some; ValueError for names that there aren't."""
        only, without = list(only), list(without)
        strange = sorted({*only, *without} - set(self._known))
        if strange:
            raise ValueError(f"unknown: {', '.join(strange)}")
        return [n for n in (only or self.names()) if n not in without]


def by_precedence(candidates: list[tuple[str, object]]) -> tuple[object, str]:
    """The first value that is set, and where it came from; ValueError if none is."""
    for origin, value in candidates:
        if value is not None:
            return value, origin
    raise ValueError(f"not set in any of: {', '.join(origin for origin, _ in candidates)}")


def run(spark: SparkSession, registry: Registry, names: list[str], schema: str, *given) -> tuple[dict[str, DataFrame], list[str]]:
    """What each makes of what is given, and which failed; a failed one's rows are none, in the schema that all share."""
    out, failed = {}, []
    for name in names:
        try:
            found = registry[name](*given)
            _ = found.schema  # plans are checked here, rows are made when they are asked for
            out[name] = found
        except Exception:
            out[name] = spark.createDataFrame([], schema)
            failed.append(name)
    return out, sorted(failed)
