"""Tables by name, and the registry of named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of a directory as attributes; each is read when it is asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(*ids: str, sql: str | None = None):
    """Register a function of Tables as a named query that shows the operators ids."""

    def add(f: Callable[[Tables], DataFrame]):
        if f.__name__ in REGISTRY:
            raise ValueError(f"two queries named {f.__name__}")
        REGISTRY[f.__name__] = Query(f.__name__, ids, f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from millrace import plans  # noqa: F401
    from millrace.plans import load

    load()
    return {name: (lambda spark, root, q=q: q.run(Tables(spark, root))) for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
