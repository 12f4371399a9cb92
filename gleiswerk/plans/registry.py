"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .testmodel import Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable:
    """Register a function of the data model under a name, with the SQL that gives the same rows.

    Columns named in ``dates`` are handed on as text, as engines and their clients differ in what a date is.
    """

    def register(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Model(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in dates})
        if sql is not None:
            texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            ORACLE_SQL[name] = f"SELECT * REPLACE ({texts}) FROM ({sql})" if dates else sql
        return f

    return register
