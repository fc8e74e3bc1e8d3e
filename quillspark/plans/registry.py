"""Where queries and their SQL are entered."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from quillspark.sources.stored import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, whole_sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with SQL that gives the same rows.

    With whole_sql it is registered once more, as NAME_whole, to be called with whole=True.
    """

    def enter(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        if whole_sql:
            QUERIES[f"{f.__name__}_whole"], ORACLES[f"{f.__name__}_whole"] = partial(f, whole=True), whole_sql
        return f

    return enter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")
