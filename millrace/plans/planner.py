"""Views with dependencies, and the planner of what to compute again.

The graph of views is a small list in code, so it is planned in plain Python; keys and digests of rows stay in tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.compare import changes


@dataclass(frozen=True)
class View:
    name: str
    build: Callable[[dict[str, DataFrame]], DataFrame]
    deps: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()


@dataclass
class Registry:
    """Views by name. A view's dependencies are views or inputs."""

    views: dict[str, View] = field(default_factory=dict)

    def view(self, name: str, deps: tuple[str, ...] = (), keys: tuple[str, ...] = ()):
        def add(f):
            if name in self.views:
                raise ValueError(f"two views named {name}")
            self.views[name] = View(name, f, tuple(deps), tuple(keys))
            return f

        return add

    def order(self, names: set[str] | None = None) -> list[str]:
        """Views after their dependencies, by name among equals. A cycle is an error."""
        left = {n: {d for d in v.deps if d in self.views and (names is None or d in names)} for n, v in self.views.items() if names is None or n in names}
        out: list[str] = []
        while left:
            free = sorted(n for n, d in left.items() if not d)
            if not free:
                raise ValueError(f"views depend on each other: {sorted(left)}")
            out += free
            left = {n: d - set(free) for n, d in left.items() if n not in free}
        return out

    def dependents(self, names: set[str]) -> set[str]:
        """Everything that depends on any of names, directly or not."""
        out: set[str] = set()
        while more := {n for n, v in self.views.items() if n not in out and (set(v.deps) & (names | out))}:
            out |= more
        return out

    def prerequisites(self, names: set[str]) -> set[str]:
        out: set[str] = set()
        new = set(names)
        while new := {d for n in new if n in self.views for d in self.views[n].deps if d in self.views} - out:
            out |= new
        return out

    def missing(self, ran: set[str]) -> dict[str, set[str]]:
        """Views that ran without being registered, and the other way round."""
        return {"unregistered": ran - self.views.keys(), "not_run": self.views.keys() - ran}


@dataclass(frozen=True)
class Step:
    view: str
    reason: str  # changed, dependent or prerequisite
    seconds: float


def plan(registry: Registry, changed_inputs: set[str], available: set[str], seconds: dict[str, float] | None = None) -> list[Step]:
    """The steps that changed inputs make necessary, in order, with prerequisites that are not available and the time each took before."""
    seconds = seconds or {}
    direct = {n for n, v in registry.views.items() if set(v.deps) & changed_inputs}
    dependent = registry.dependents(direct) - direct
    needed = registry.prerequisites(direct | dependent) - direct - dependent - available
    reason = dict.fromkeys(needed, "prerequisite") | dict.fromkeys(dependent, "dependent") | dict.fromkeys(direct, "changed")
    return [Step(n, reason[n], seconds.get(n, 0.0)) for n in registry.order(set(reason))]


def execute(registry: Registry, steps: list[Step], inputs: dict[str, DataFrame], *, changed: dict[str, DataFrame] | None = None, only: set[str] | None = None, skip: set[str] = frozenset(), save: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Run steps on inputs. A view with keys is built on the changed keys of an input alone (a semi join) if those are given; save writes a result and gives the table that replaces it."""
    have = dict(inputs)
    for s in steps:
        if s.view in skip or (only is not None and s.view not in only):
            continue
        v = registry.views[s.view]
        scope = {}
        for d in v.deps:
            df = have[d]
            if changed and d in changed and v.keys:
                df = df.join(changed[d].select(*v.keys).distinct(), list(v.keys), "left_semi")
            scope[d] = df
        out = v.build(scope)
        have[s.view] = save(s.view, out) if save else out
    return {n: df for n, df in have.items() if n not in inputs}


def detect(baseline: DataFrame | None, current: DataFrame, key: str, columns: list[str], name: str | None = None) -> DataFrame:
    """key, change against the baseline; without one every row is new."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return current.select(key, F.lit("new").alias("change")) if baseline is None else changes(baseline, current, key, digest, name)


def cached(keys: DataFrame, cache: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the cache whose digest is still that of keys, and the keys to compute anew."""
    return cache.join(keys.select(key, digest), [key, digest], "left_semi"), keys.join(cache.select(key, digest), [key, digest], "left_anti")


class Tools:
    """Named parameterised queries: a call gives rows, or an error as a value."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.queries = spark, {}
        for name, df in tables.items():
            df.createOrReplaceTempView(name)

    def add(self, name: str, sql: str, **defaults) -> None:
        """sql with :named parameters and their defaults."""
        self.queries[name] = (sql, defaults)

    def names(self) -> list[str]:
        return sorted(self.queries)

    def call(self, name: str, **args) -> dict:
        if name not in self.queries:
            return {"error": f"unknown tool {name}"}
        sql, defaults = self.queries[name]
        if unknown := set(args) - set(defaults):
            return {"error": f"unknown arguments {sorted(unknown)}"}
        return {"rows": self.spark.sql(sql, args=defaults | args)}
