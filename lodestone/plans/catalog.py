"""All queries of the core library by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import corpus, evaluations, files, models, nested, scalars, stores
from lodestone.plans.registry import Query

_MODULES = (corpus, stores, evaluations, scalars, nested, files, models)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pretoken_counts_top(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: f for m in _MODULES for k, f in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.R.sql.items()}
