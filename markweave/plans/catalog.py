"""All queries of the library by name, with the SQL they can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from markweave.plans import experiments, ratings
from markweave.session import ship_library


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_library(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(q) for name, q in (ratings.queries() | experiments.queries()).items()}


def steady_rounding(sql: str) -> str:
    """``round(x, 6)`` as ``(round(round(x, 10), 6) + 0.0)`` throughout a statement, as the queries round."""
    out, at = [], 0
    while (k := sql.find("round(", at)) >= 0:
        depth, end = 0, k + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        inner = steady_rounding(sql[k + 6 : end - 1])
        if inner.endswith(", 6"):
            inner = f"round({inner[:-3]}, 10), 6"
            out += [sql[at:k], "(round(", inner, ") + 0.0)"]
        else:
            out += [sql[at:k], "round(", inner, ")"]
        at = end
    return "".join(out) + sql[at:]


def oracle_sql() -> dict[str, str]:
    return {name: steady_rounding(sql) for name, sql in (ratings.oracle_sql() | experiments.oracle_sql()).items()}
