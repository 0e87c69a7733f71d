"""The table of registered queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str | Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register a query (spark, sf_dir) -> DataFrame; sql is the equivalent DuckDB statement, or what makes it, if SQL can say it."""

    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


def oracles() -> dict[str, str]:
    """The queries' SQL; such as needs a file that is not on this machine is left out."""
    out = {}
    for name, sql in ORACLES.items():
        try:
            out[name] = sql if isinstance(sql, str) else sql()
        except FileNotFoundError:
            continue
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes, where all executors can read it: under spark.checkpoint.dir; in local mode, where that may be unset, under
    the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
