"""Session settings and the shared helpers that every operator leans on."""

from __future__ import annotations

import atexit
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_FOLDERS: set[str] = set()


def get_spark(cores: str = "*", shuffle_partitions: int = 8, master: str | None = None, shared: str | None = None) -> SparkSession:
    """A session with the settings the engine expects (UTC, AQE, Arrow): local unless a master is given.

    ``shared`` is the folder for intermediate tables (spark.checkpoint.dir), which a master other than a local one needs."""
    builder = (
        SparkSession.builder.master(master or f"local[{cores}]")
        .appName("factloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master is None:
        builder = builder.config("spark.driver.memory", "8g").config("spark.driver.host", "127.0.0.1")
    return (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only a local master, as in tests, may do without: it gets a temporary folder."""
    jsc = spark.sparkContext._jsc.sc()
    known = jsc.getCheckpointDir()
    if known.isDefined():
        return known.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    path = path or os.path.join(tempfile.gettempdir(), "factloom-checkpoint")
    spark.sparkContext.setCheckpointDir(path)
    return jsc.getCheckpointDir().get()


def spread(df: DataFrame, mb: int = 32) -> int:
    """Partitions for work on df that is heavy for its bytes, which AQE would gather into too few tasks: one per ``mb`` of
    the planner's estimate, at least two a core. An unknown size counts as none."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 50 else 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, known // (mb << 20))


def widen(df: DataFrame) -> DataFrame:
    """df over all cores where its files give few partitions; for steps whose work outweighs moving the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def _forget(spark: SparkSession, folder: str) -> None:
    """Remove the tables of cut() when the program ends in good order."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 — the session is gone already
        return


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and the rows survive a lost executor."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/factloom-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_forget, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def big_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """df with its row number in ``order`` within each group of ``by``, where one group may hold a large part of all rows.

    Rows are ranged over tasks by group and order, so a hot group spans many tasks; each task numbers its own
    part, and the counts of the parts before it are added. ``order`` must decide between any two rows of a group.
    The parts are written once, as both steps must see the same ones."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = cut(df.repartitionByRange(parts, *[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id()))
    own = ranged.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    sizes = ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    # a group has at most one row a part here
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_p"), "_before")
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_part") == F.col("_p"))
    return own.join(before, same).withColumn(name, (F.col(name) + F.col("_before")).cast("bigint")).select(*df.columns, name)


def salted_join(big: DataFrame, small: DataFrame, on: str, salt_of: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """Join a skewed side with a far smaller one: big rows are spread over ``salts``
    sub-keys by ``salt_of`` and the small side is repeated once per sub-key, so
    one hot key never meets in a single task."""
    big = big.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(salts)).cast("int"))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.join(small, [on, "_salt"], how).drop("_salt")


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of every executor, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_factloom_shipped", None) is None:
        home = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="factloom-")) / "factloom.zip"
        with zipfile.ZipFile(path, "w") as out:
            for f in sorted(home.rglob("*.py")):
                out.write(f, f.relative_to(home.parent))
        sc.addPyFile(str(path))
        sc._factloom_shipped = str(path)
    return spark


def need(df: DataFrame, columns: Sequence[str]) -> None:
    """Fail early and readably when an input lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks the columns {missing}; it has {df.columns}")
