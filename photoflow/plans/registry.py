"""Queries over the given tables and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL where SQL can express it."""

    def register(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def _load() -> None:
    from photoflow.plans import cluster_queries, expression_queries, session_queries, stats_queries, stream_queries, table_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of all photos as one source: gap 60 minutes, duration 30."""
    from pyspark.sql import functions as F

    from photoflow.operators import sessions
    from photoflow.plans import fixtures

    photos = fixtures.photos(spark, sf_dir).withColumn("source", F.lit("all"))
    marked = sessions.mark_sessions_by_range(photos.where("ts is not null"), ["source"], 60)
    games = sessions.sessionize(photos, ["source"], 60, 30, marked)
    return sessions.game_summary(sessions.number_games(games, ["source"]), ["source"])
