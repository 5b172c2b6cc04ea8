"""Registered queries and their SQL twins, one module per topic."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from driftmark.sources.session import tune

Query = Callable[[SparkSession, str], DataFrame]

TOPICS = ("rollup", "segments", "profile", "pairs", "series", "arma", "models", "optima", "files")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for topic in TOPICS:
        part = getattr(import_module(f"driftmark.plans.{topic}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out.update(part)
    return out


def _tuned(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(tune(spark), sf_dir)

    return run


def all_queries() -> dict[str, Query]:
    return {name: _tuned(query) for name, query in _merged("QUERIES").items()}


def all_oracles() -> dict[str, str]:
    return _merged("ORACLE")
