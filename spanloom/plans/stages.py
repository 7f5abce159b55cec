"""Stage graphs: named steps with dependencies, run in order, skipped where their table exists."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from spanloom.sources.sinks import table_exists


class Stage(NamedTuple):
    name: str
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    after: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()


def ordered(stages: Iterable[Stage], wanted: Iterable[str] | None = None) -> list[Stage]:
    """The wanted stages with all they depend on, each after its dependencies. Raises ValueError on a cycle or an unknown name."""
    known = {s.name: s for s in stages}
    done: list[Stage] = []
    state: dict[str, bool] = {}

    def visit(name: str) -> None:
        if name not in known:
            raise ValueError(f"no stage {name}")
        if state.get(name) is False:
            raise ValueError(f"stage {name} depends on itself")
        if name not in state:
            state[name] = False
            for other in known[name].after:
                visit(other)
            state[name] = True
            done.append(known[name])

    for name in wanted or known:
        visit(name)
    return done


def execute(spark: SparkSession, stages: Iterable[Stage], out: str, inputs: dict[str, DataFrame], wanted: Iterable[str] | None = None,
            force: bool = False) -> dict[str, DataFrame]:
    """Run stages in order, each writing out/name and reading what it depends on from there."""
    plan = ordered(stages, wanted)
    missing = sorted({i for s in plan for i in s.inputs} - set(inputs))
    if missing:
        raise ValueError(f"missing inputs: {', '.join(missing)}")
    tables = dict(inputs)
    for stage in plan:
        path = f"{out}/{stage.name}"
        if force or not table_exists(spark, path):
            stage.run(spark, {k: tables[k] for k in (*stage.after, *stage.inputs)}).write.mode("overwrite").parquet(path)
        tables[stage.name] = spark.read.parquet(path)
    return {s.name: tables[s.name] for s in plan}
