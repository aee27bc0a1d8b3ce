"""Reading the Parquet tables, and spreading rows over the cluster before Python work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; filters and column pruning reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Give Python stages work for every core.

    A table of a few files is read in fewer partitions than there are cores; it is then dealt out round robin. A table
    with partitions enough, as any large one, passes unchanged and without a shuffle. For tables as read; after a shuffle use deal().
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def python_partitions(spark: SparkSession) -> int:
    """Partitions for a Python stage behind a shuffle: named outright, so that they are not merged for being few bytes."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Rows for a Python stage, round robin or by ``keys``."""
    return df.repartition(python_partitions(df.sparkSession), *keys)
