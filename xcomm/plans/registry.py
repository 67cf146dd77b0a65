"""Registry of the fixture queries: each name has a Spark plan and, when the semantics are
SQL-expressible, the equivalent DuckDB SQL over the same parquet tables (the oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def sql_str(v: str) -> str:
    """A DuckDB string expression (newlines via chr(10))."""
    parts = ["'" + p.replace("'", "''") + "'" for p in v.split("\n")]
    return " || chr(10) || ".join(parts)


def sql_list(values: list[str]) -> str:
    """A DuckDB list literal of strings."""
    return "[" + ", ".join(sql_str(v) for v in values) + "]"


def load_all() -> None:
    """Import every module that registers queries."""
    from . import q_archive, q_effect, q_embed, q_eval, q_exact, q_features, q_history, q_jobs, q_mentions, q_models, q_scorer, q_search, q_similarity, q_sources  # noqa: F401
