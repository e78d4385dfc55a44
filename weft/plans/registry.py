"""Queries by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, places: int | None = 6):
    """Register a function of (table reader) as the query of its name; doubles are rounded."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            if places is None:
                return out
            return out.select(*(F.round(F.col(c), places).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return add
