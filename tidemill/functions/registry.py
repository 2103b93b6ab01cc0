"""User steps, SQL functions and operators by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

_OPERATORS: dict[str, Callable] = {}


def python_step(df: DataFrame, fn: Callable, params: Mapping | None = None, schema: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """A user's function over a table.

    Without ``schema`` it maps a DataFrame to a DataFrame. With one it gets pandas batches: of single groups if
    ``keys`` are given (groups must fit a task), else an iterator over the batches of a partition.
    """
    params = dict(params or {})
    if schema is None:
        return fn(df, **params)
    if keys:
        return df.groupBy(*keys).applyInPandas(lambda pdf: fn(pdf, **params), schema)
    return df.mapInPandas(lambda batches: (fn(pdf, **params) for pdf in batches), schema)


def register_udf(spark: SparkSession, name: str, fn: Callable, return_type: str = "string", vectorized: bool = True):
    """Make a function known to SQL; vectorized ones get and return pandas Series by Arrow."""
    from pyspark.sql.functions import pandas_udf, udf

    if not vectorized:
        return spark.udf.register(name, udf(fn, return_type))
    return spark.udf.register(name, pandas_udf(fn, return_type))


def register_udtf(spark: SparkSession, name: str, cls: type, return_type: str):
    """Make a table function known to SQL."""
    from pyspark.sql.functions import udtf

    return spark.udtf.register(name, udtf(cls, returnType=return_type))


def operator(name: str):
    """Decorator: a callable (DataFrame, **config) -> DataFrame that :func:`run_operator` finds by ``name``."""

    def add(fn: Callable) -> Callable:
        _OPERATORS[name] = fn
        return fn

    return add


def run_operator(name: str, df: DataFrame, config: Mapping | None = None) -> DataFrame:
    if name not in _OPERATORS:
        raise KeyError(f"no operator {name!r}; known: {', '.join(sorted(_OPERATORS)) or 'none'}")
    out = _OPERATORS[name](df, **dict(config or {}))
    if not isinstance(out, DataFrame):
        raise TypeError(f"operator {name!r} returned {type(out).__name__}, not a DataFrame")
    return out


def operator_names() -> list[str]:
    return sorted(_OPERATORS)
