"""Queries of the training-data operators by name, with SQL checks where SQL can state them."""

from __future__ import annotations

from lendgrain.plans.registry import Query

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check.strip()
        return fn
    return register


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
