"""Registry of the named queries and their DuckDB twins.

Each entry maps a query name (the operator id of the blueprint) to a Spark
callable ``(spark, sf_dir) -> DataFrame`` and, where the operator is
SQL-expressible, the equivalent DuckDB SQL over the raw tables. Every query
reads the given tables in full; nothing is sampled or capped except where a
limit is the operator itself (top-k reports).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, rnd: tuple[str, ...] | dict[str, int] = (), digits: int = 6):
    """Register a query. ``rnd`` names float columns whose last bits depend
    on summation order; both sides round them to ``digits`` places (or to the
    places given per column when ``rnd`` is a dict: large sums of cents use 2)."""
    places = dict(rnd) if isinstance(rnd, dict) else {c: digits for c in rnd}

    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        if rnd:
            def rounded(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
                df = _fn(spark, sf_dir)
                return df.select(
                    *[
                        (F.floor(F.col(c) * float(10 ** places[c]) + 0.5).cast("double") / float(10 ** places[c])).alias(c)
                        if c in places
                        else F.col(c)
                        for c in df.columns
                    ]
                )

            rounded.__doc__ = fn.__doc__
            QUERIES[name] = rounded
        else:
            QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            if rnd:
                # The same three IEEE operations on both sides, so an equal
                # double always rounds to an equal double (the engines' own
                # round functions break exact ties differently).
                repl = ", ".join(f"floor({c} * {10**k}.0 + 0.5) / {10**k}.0 AS {c}" for c, k in places.items())
                body = f"SELECT * REPLACE ({repl}) FROM (\n{body}\n)"
            ORACLE[name] = body
        return fn

    return wrap


def load_all() -> None:
    """Import every module that registers queries."""
    from tidecast.plans import (  # noqa: F401
        q_daily,
        q_features,
        q_customers,
        q_ensemble,
        q_models,
        q_forecasters,
    )
