"""Registry of the checkable queries: a Spark function and, where SQL can say it, its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seaglint.plans.views import Tables, duck_sql
from seaglint.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "scalar_queries",
    "filter_queries",
    "catalogue_queries",
    "join_queries",
    "tile_queries",
    "label_queries",
    "detection_queries",
    "raster_queries",
    "source_queries",
    "file_queries",
    "stream_queries",
)


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(Tables(spark, folder))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = duck_sql(oracle)
        return fn

    return add


def rounded(value: Column, digits: int = 6) -> Column:
    """Half-up rounding by floor, which both engines compute alike."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def r(expr: str, digits: int = 6) -> str:
    """The same in SQL text."""
    return f"(floor(({expr}) * 1e{digits} + 0.5e0) / 1e{digits})"


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"seaglint.plans.{m}")
