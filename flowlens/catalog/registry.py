"""Pairs a query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .views import SQL_VIEWS, VIEW_NEEDS


@dataclass
class Entry:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def r(expr: str, digits: int = 6) -> str:
    """Rounded output column; adding zero turns -0.0 into 0.0."""
    return f"(round({expr}, {digits}) + 0.0)"


def ratio(a: str, b: str) -> str:
    """a / b in doubles, 0 on a zero denominator."""
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END)"


def with_views(names: tuple[str, ...], body: str) -> str:
    """Prefix ``body`` (a SELECT, or ``name AS (...), ... SELECT``) with the views it needs."""
    order: list[str] = []

    def add(n: str) -> None:
        for need in VIEW_NEEDS.get(n, ()):
            add(need)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"WITH RECURSIVE {ctes} {body}" if ctes else body
    return f"WITH RECURSIVE {ctes}, {body}" if ctes else f"WITH RECURSIVE {body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), digits: int = 6):
    """Register a query; its double columns are rounded once, at the end."""

    def wrap(fn):
        def build(spark: SparkSession, sf: str) -> DataFrame:
            df = fn(spark, sf)
            fields = df.schema.fields
            if not any(f.dataType.typeName() in ("double", "float") for f in fields):
                return df
            return df.select(*[
                F.round(F.col(f.name).cast("double"), digits).alias(f.name)
                if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in fields])

        if name in ENTRIES:
            raise ValueError(f"query {name!r} registered twice")
        ENTRIES[name] = Entry(build, None if sql is None else with_views(views, sql))
        return fn

    return wrap
