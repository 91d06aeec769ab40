"""All queries of the reference's operators on the driver's tables, by name, with their DuckDB counterparts."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import quality

_PLANS = [import_module(f"factloom.plans.{name}") for name in ("quality", "selection", "schemas", "texts", "records", "sourcing", "greedy")]

QUERIES: dict = {k: v for m in _PLANS for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _PLANS for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of each language with its cluster-robust range."""
    return quality.clustered_wilson_by_lang(spark, sf_dir)
