"""Registry of queries over the given tables, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from orderweave.session import configure

QUERIES: dict[str, Query] = {}


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places (negative zero made zero), NaN as null, so that engines compare equal."""
    return df.selectExpr(
        *[
            f"nullif(round(`{name}`, 6) + 0D, double('NaN')) as `{name}`" if kind == "double" else f"`{name}`"
            for name, kind in df.dtypes
        ]
    )


def query(name: str, oracle: str | None = None, doubles: str = ""):
    """Register a query. ``doubles`` names the double columns of its twin, which are rounded alike."""

    def add(fn):
        twin = oracle
        if twin and doubles:
            rounded = ", ".join(f"round({c}, 6) + 0 AS {c}" for c in doubles.split())
            twin = f"SELECT * REPLACE ({rounded}) FROM ({twin}) AS twin"
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, lambda spark, sf_dir: tidy(fn(configure(spark), sf_dir)), twin)
        return fn

    return add


_CACHE: dict[tuple, object] = {}


def once(fn):
    """Remember a derived table per application and input, as the event store would."""

    def remembered(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir, fn.__qualname__)
        if key not in _CACHE:
            _CACHE[key] = fn(configure(spark), sf_dir)
        return _CACHE[key]

    return remembered


def forget() -> None:
    """Drop remembered tables, so that the next query derives them again."""
    _CACHE.clear()


def load_all() -> dict[str, Query]:
    from orderweave.plans import queries_analytics, queries_events, queries_feeds  # noqa: F401

    return QUERIES
