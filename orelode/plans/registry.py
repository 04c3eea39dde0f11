"""Where queries register themselves with their SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4, only: list[str] | None = None) -> DataFrame:
    """Doubles to a few digits, so that sums in another order compare equal.

    A half is moved off the boundary by a millionth of the last digit: decimal
    data give exact halves, which engines round by their last bit.
    """
    doubles = {n for n, t in df.dtypes if t == "double" and (only is None or n in only)}
    return df.select(*((F.floor(F.col(n) * 10.0**digits + 0.500001) / 10.0**digits).alias(n) if n in doubles else F.col(n) for n in df.columns))


def r(expr: str, name: str, digits: int = 4) -> str:
    return f"floor(({expr})::double * 1e{digits} + 0.500001::double) / 1e{digits}::double as {name}"
