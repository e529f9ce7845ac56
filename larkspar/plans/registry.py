"""Where each module of queries registers its pairs of a Spark query and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _unbound(text: str, bound: tuple[str, ...]) -> str:
    for b in bound:
        if b not in text:
            raise ValueError(f"{b!r} is not in {text!r}")
        text = text.replace(b, "TRUE")
    return text


def register(name: str, oracle: str | None = None, bound: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a query under ``name``, with the SQL that an independent engine can run on the same tables.

    A query that takes a ``bound``, a filter that keeps few rows, and its SQL are registered over all rows, with TRUE in its place.
    """

    def put(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if bound is None:
            _put(name, query, oracle)
        else:
            _put(name, lambda spark, sf_dir: query(spark, sf_dir, "TRUE"), None if oracle is None else _unbound(oracle, (bound,)))
        return query

    return put


def _put(name: str, query: Query, oracle: str | None) -> None:
    if name in QUERIES:
        raise ValueError(f"a query named {name} is there already")
    QUERIES[name] = query
    if oracle is not None:
        SQL[name] = oracle


def sql(name: str, query: str, oracle: str | None, bound: str | tuple[str, ...] = ()) -> None:
    """Register a query in Spark SQL over the tables that it names; each filter in ``bound`` gives way to TRUE, in both texts, so that all rows are read."""
    from larkspar.sources.tables import run_sql

    bounds = (bound,) if isinstance(bound, str) else bound
    query, oracle = _unbound(query, bounds), None if oracle is None else _unbound(oracle, bounds)
    register(name, oracle)(lambda spark, sf_dir: run_sql(spark, sf_dir, query))


def both(name: str, query: str, bound: str | tuple[str, ...] = ()) -> None:
    """Register a query that is the same text for either engine."""
    sql(name, query, query, bound)
