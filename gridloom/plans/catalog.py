"""Registered queries of the domain operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans.adapters import Tables, columns, text, uses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of Tables under a name; sql may use {adapter} names.

    Where it reads the joined line items more than once, they are joined once and written.
    """

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        once = columns(sql) if sql and uses(sql) > 1 else None
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir, once))
        if sql:
            ORACLE_SQL[name] = text(sql)
        return build

    return register


from gridloom.plans import queries_audit, queries_detail, queries_io, queries_model, queries_polygons, queries_results, queries_rules, queries_solved, queries_space  # noqa: E402, F401
