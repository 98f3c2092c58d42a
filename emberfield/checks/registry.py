"""Named checks: a Spark query and, where it can be written, an independent SQL text for the oracle engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.scale import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Every double column rounded (sums differ in the last digits with their order)."""
    cols = [n for n, t in df.dtypes if t == "double" and n not in skip]
    return df.withColumns({c: F.round(c, digits) for c in cols}) if cols else df


def q(expr: str, name: str | None = None, digits: int = 6) -> str:
    """SQL twin of ``r6``; adding zero turns a negative zero into zero."""
    return f"round({expr}, {digits}) + 0e0" + (f" as {name}" if name else "")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/emberfield-{name}-{uuid.uuid4().hex}"
