"""A registry of analyzers, reporters and exporters, each a function from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

KINDS = ("analyzer", "reporter", "exporter")


@dataclass(frozen=True)
class Plugin:
    name: str
    version: str
    kind: str
    run: Callable[[DataFrame], DataFrame]


class Registry:
    def __init__(self) -> None:
        self._by_name: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> None:
        if plugin is None or not plugin.name or plugin.name in self._by_name:
            raise ValueError("a plugin needs a name that is not taken")
        if plugin.kind not in KINDS:
            raise ValueError(f"no such kind: {plugin.kind}")
        self._by_name[plugin.name] = plugin

    def unregister(self, name: str) -> None:
        del self._by_name[name]

    def get(self, name: str) -> Plugin | None:
        return self._by_name.get(name)

    def all(self) -> list[Plugin]:
        return sorted(self._by_name.values(), key=lambda p: p.name)

    def by_kind(self, kind: str) -> list[Plugin]:
        return [p for p in self.all() if p.kind == kind]

    def __len__(self) -> int:
        return len(self._by_name)
