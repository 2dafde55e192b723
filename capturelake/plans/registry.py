"""Registry of runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .frames import FRAMES, frame_sql

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
# named SQL steps: name -> (names it reads, text)
STEPS: dict[str, tuple[list[str], str]] = {}


def query(name: str, sql: str | None = None, uses: list[str] | None = None):
    """Registers a query; ``uses`` names the frames and steps its SQL reads."""

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_steps(sql, uses or [])
        return fn

    return register


def step(name: str, sql: str, uses: list[str] | None = None) -> None:
    STEPS[name] = (uses or [], sql)


def with_steps(sql: str, uses: list[str]) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in STEPS[name][0] if name in STEPS else []:
            visit(dep)
        ordered.append(name)

    for name in uses:
        visit(name)
    if not ordered:
        return sql
    parts = [f"{n} AS ({STEPS[n][1] if n in STEPS else frame_sql(n)})" for n in ordered if n in STEPS or n in FRAMES]
    return "WITH " + ",\n".join(parts) + "\n" + sql
