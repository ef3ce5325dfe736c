"""Registered queries and the SQL each one is checked against."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidebook.sources.bindings import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Comparable output: doubles at 6 digits, decimals as doubles, dates and nested values as text."""
    cols = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = c.cast("double")
            c = F.when(F.abs(c) < 1e9, F.floor(c * 1e6 + 0.5) / 1e6).otherwise(c)
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, oracle: str | None = None):
    """Register `fn(inputs) -> DataFrame`; `oracle` is the body of the equivalent SQL."""
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(fn(Inputs(spark, folder)))
        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = with_views(oracle)
        return fn
    return register


def view(name: str, body: str) -> None:
    VIEWS[name] = body


def with_views(body: str) -> str:
    """Prefix a SQL body with the views it uses, directly or through other views."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)
    visit(body)
    ctes = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed]
    body = body.strip()
    if body.upper().startswith("WITH "):
        recursive = body.upper().startswith("WITH RECURSIVE ")
        ctes.append(body[15 if recursive else 5:].lstrip())
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes)
    return (("WITH " + ",\n".join(ctes) + "\n") if ctes else "") + body


def r(expr: str) -> str:
    """SQL text of a double rounded as in `plain`."""
    x = f"CAST(({expr}) AS DOUBLE)"
    return f"CASE WHEN abs({x}) < 1e9 THEN floor({x} * 1e6 + 0.5) / 1e6 ELSE {x} END"
