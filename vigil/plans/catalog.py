"""All registered queries of the library itself: name -> (function, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its SQL twin if there is one."""

    def put(f: Query) -> Query:
        if name in _REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        _REGISTRY[name] = (f, sql)
        return f

    return put


def registry() -> dict[str, tuple[Query, str | None]]:
    from importlib import import_module
    from pkgutil import iter_modules

    import vigil.plans as plans

    for m in iter_modules(plans.__path__):
        if m.name.startswith("q_"):
            import_module(f"vigil.plans.{m.name}")
    return dict(_REGISTRY)
