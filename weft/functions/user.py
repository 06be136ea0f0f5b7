"""User functions for SQL: scalar and aggregate ones over Arrow batches, and table functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf


def scalar(spark: SparkSession, name: str, f, kind: str) -> None:
    """f(series, …) -> series."""
    spark.udf.register(name, pandas_udf(f, kind))


kind_of = {"double": float, "bigint": int, "long": int, "int": int, "string": str}


def aggregate_of(f, kind: str):
    """A grouped aggregate function from f(series) -> value."""
    def run(x):
        return f(x)

    run.__annotations__ = {"x": pd.Series, "return": kind_of[kind]}
    return pandas_udf(run, kind)


def aggregate(spark: SparkSession, name: str, f, kind: str) -> None:
    """f(series) -> value of a group. The rows of a group meet in one task; where built-in sums will do, use these."""
    spark.udf.register(name, aggregate_of(f, kind))


def table_function(spark: SparkSession, name: str, eval_, schema: str) -> None:
    """eval_(arguments …) yields tuples."""
    handler = type(name, (), {"eval": lambda self, *args: eval_(*args)})
    spark.udtf.register(name, udtf(handler, returnType=schema))
