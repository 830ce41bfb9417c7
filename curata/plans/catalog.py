"""Registered queries: one per operator of the inventory, each over the whole
test tables (or frames Spark derives from them), with the equivalent DuckDB SQL
where the operator is SQL-expressible.

Floating outputs are rounded alike on both sides (``round(x, d)``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def rnd(df: DataFrame, digits: int = 6, columns: list[str] | None = None) -> DataFrame:
    """Round every DOUBLE column (or ``columns``) to ``digits`` decimals."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() in ("double", "float") and (columns is None or f.name in columns):
            c = (F.round(c, digits) + F.lit(0.0)).alias(f.name)  # + 0.0 turns -0.0 into 0.0
        cols.append(c)
    return df.select(*cols)


# import the query modules so their decorators run
from curata.plans import q_profile, q_clean, q_transform, q_reduce, q_io  # noqa: E402,F401
