"""All queries outside the text subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandweave.plans import problem_sql, problems, reference, reference_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**problems.QUERIES, **reference.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**problem_sql.SQL, **reference_sql.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.barcode_counts(spark, sf_dir)
