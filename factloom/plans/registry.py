"""Every query of the core by name, and its SQL equivalent where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import data_problems, more_queries, reference_queries, survey_queries  # noqa: F401 — the modules of queries share one register

QUERIES = {**reference_queries.QUERIES, **more_queries.QUERIES, **data_problems.QUERIES}
ORACLES = {**reference_queries.ORACLES, **more_queries.ORACLES, **data_problems.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to ranked verdicts: evidence, hit rates, balanced cut, verdict, rank."""
    return QUERIES["triage"](spark, sf_dir)
