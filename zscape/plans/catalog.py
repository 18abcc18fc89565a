"""Every registered query and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import backtest_queries, facts_queries, files_queries, raw_backtest, scoring_queries

SECTIONS = (scoring_queries.R, backtest_queries.R, facts_queries.R, files_queries.R, raw_backtest.R)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor scores of the whole universe."""
    return queries()["cp3_build_scores"](spark, sf_dir)


def queries() -> dict:
    return {k: q for r in SECTIONS for k, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for r in SECTIONS for k, q in r.oracles.items()}
