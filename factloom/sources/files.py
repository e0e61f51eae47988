"""Readers: hypothesis CSV and JSON, manifests, parquet tables, replayed search results."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from factloom.functions.text import list_cell

#: Other names that a column of an uploaded file may have. Fixed values.
ALIASES = {
    "hypothesis_statement": "statement", "hypothesis": "statement", "claim": "statement", "claim_statement": "statement", "hyp_id": "hypothesis_id", "id": "hypothesis_id",
    "cp_id": "core_problem_id", "cp_statement": "core_problem_statement", "core_problem": "core_problem_statement", "force": "force_assignment", "priority": "investigation_priority",
    "signals": "expected_signals", "counter_signals": "expected_counter_signals", "pair_id": "contrarian_pair_id", "contrarian": "contrarian_pair_id",
    "mece_cluster": "mece_cluster_id", "cluster_id": "mece_cluster_id", "window": "window_label", "triage": "max_triage", "triage_budget": "max_triage",
}
MANIFEST = "struct<bundle_id:string,research_intent:struct<north_star:string>,hypotheses:struct<core_problems:array<struct<id:string,statement:string,priority:string,hypotheses:array<struct<hypothesis_id:string,statement:string,dimension:string,force_assignment:string,expected_signals:array<string>>>>>>>"


def read_hypothesis_csv(spark: SparkSession, path: str) -> DataFrame:
    """Hypotheses of CSV files with any order and spelling of columns.

    Headers are normalised (lower case, underscores, aliases), a byte order mark is
    dropped, rows without a statement are dropped, rows without an id are numbered h_auto_001... in the
    order of their file, and of a file's rows with one id the first is kept.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    named = raw.toDF(*[ALIASES.get(n, n) for n in (x.lstrip("\ufeff").strip().lower().replace(" ", "_").replace("-", "_") for x in raw.columns)])
    if "statement" not in named.columns:
        raise ValueError("a hypothesis file needs a column 'statement'")
    for c in ("hypothesis_id", "core_problem_id", "expected_signals", "expected_counter_signals"):
        if c not in named.columns:
            named = named.withColumn(c, F.lit(None).cast("string"))
    columns = named.columns
    # a file with line breaks inside quotes is read by one task, so its ids rise with its rows
    placed = named.withColumns({"_file": F.input_file_name(), "_pos": F.monotonically_increasing_id(), "hypothesis_id": F.nullif(F.trim("hypothesis_id"), F.lit(""))}).where(F.trim("statement") != "")
    lone = F.col("hypothesis_id").isNull()
    number = F.count_if(lone).over(Window.partitionBy("_file").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
    numbered = placed.withColumn("hypothesis_id", F.coalesce("hypothesis_id", F.format_string("h_auto_%03d", number)))
    rest = [c for c in columns if c != "hypothesis_id"]
    out = numbered.groupBy("_file", "hypothesis_id").agg(F.min_by(F.struct(*rest), "_pos").alias("r")).select("hypothesis_id", "r.*")
    return out.withColumns({
        "core_problem_id": F.coalesce(F.nullif(F.trim("core_problem_id"), F.lit("")), F.lit("_uncategorized")),
        "expected_signals": list_cell(F.coalesce("expected_signals", F.lit(""))),
        "expected_counter_signals": list_cell(F.coalesce("expected_counter_signals", F.lit(""))),
    })


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per hypothesis of JSON manifests; rows without a statement are dropped, ids default to the flat position."""
    text = spark.read.option("wholetext", True).text(path)
    parsed = text.select(F.from_json("value", MANIFEST).alias("m"))
    problems = parsed.select("m.bundle_id", F.posexplode("m.hypotheses.core_problems").alias("p", "problem"))
    rows = problems.select("bundle_id", F.col("problem.id").alias("core_problem_id"), F.col("problem.statement").alias("core_problem_statement"), "p", F.posexplode("problem.hypotheses").alias("i", "h"))
    named = rows.where(F.trim("h.statement") != "")
    n = F.row_number().over(Window.partitionBy("bundle_id").orderBy("p", "i"))
    return named.select("bundle_id", "core_problem_id", "core_problem_statement", F.coalesce(F.nullif(F.trim("h.hypothesis_id"), F.lit("")), F.format_string("h_auto_%03d", n)).alias("hypothesis_id"), "h.statement", "h.dimension", "h.force_assignment", "h.expected_signals")


class ReplaySource(DataSource):
    """Search results replayed from files of JSON lines: ``spark.read.format("replay").load(folder)``.

    Stands in for live search backends, one partition a file, so that every query runs offline."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "url string, title string, snippet string, backend string, vertical string"

    def reader(self, schema) -> DataSourceReader:
        return _ReplayReader(self.options["path"], [f.name for f in schema])


class _ReplayReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".jsonl")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import json

        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    row = json.loads(line)
                    yield tuple(row.get(c) for c in self.columns)
