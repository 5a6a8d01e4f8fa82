"""Registers named queries with their oracle SQL and gives both sides one column form."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def settled(df: DataFrame) -> DataFrame:
    """Whole numbers as long, doubles rounded to six digits: sums in another order compare equal."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def query(sql: str | None = None, doubles: str = "", others: str = "") -> Callable[[Query], Query]:
    """doubles, others: the oracle's columns; doubles are rounded as settled() does, others that end in :i are cast to long."""

    def register(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return settled(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            columns = [*(f"CAST({c[:-2]} AS BIGINT) AS {c[:-2]}" if c.endswith(":i") else c for c in others.split()), *(f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split())]
            SQL[f.__name__] = f"SELECT {', '.join(columns)} FROM ({sql.strip()})"
        return run

    return register
