"""Registered queries over the driver's tables, and the SQL that each must agree with.

The driver's tables hold no run logs, so each query shows an operator on stand-in columns; the exact semantics on runs,
answers and measurements are tested on synthetic frames.
"""

from __future__ import annotations

QUERIES = {}
ORACLE_SQL = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from plumbline.plans import aggregates, comparisons, experiments, selections, streams, texts  # noqa: E402, F401
