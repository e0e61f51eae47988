"""Queries of the general data problems: records that fail to parse, values packed in one field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import badrows, packed
from factloom.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return badrows.rejected_rows(badrows.parse_records(table(spark, sf_dir, "hypothesis_lines"), load=False))


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return badrows.valid_rows(badrows.parse_records(table(spark, sf_dir, "hypothesis_lines")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.unpack_fields(table(spark, sf_dir, "hypotheses"), "hypothesis_id", ["expected_signals", "expected_counter_signals"])


QUERIES = {f.__name__: f for f in (p2_found, p2_loaded, p7_found)}
ORACLES: dict[str, str] = {}
