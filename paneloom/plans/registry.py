"""Query name -> (DataFrame builder, oracle SQL or None). The modules in `paneloom.plans.catalog_*` register here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "a22_weighted_summary_by_flag"

_entries: dict[str, tuple[Builder, str | None]] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        if name in _entries:
            raise ValueError(f"query {name} is registered twice")
        _entries[name] = (build, oracle)
        return build

    return register


def _load() -> None:
    import importlib
    import pkgutil

    import paneloom.plans as plans

    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.startswith("catalog_"):
            importlib.import_module(f"paneloom.plans.{m.name}")


def queries() -> dict[str, Builder]:
    _load()
    return {name: build for name, (build, _) in _entries.items()}


def oracles() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _entries.items() if sql}
