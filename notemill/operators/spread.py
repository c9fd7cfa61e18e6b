"""Spreading of rows over tasks before row-wise Python work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least twice as many partitions as there are cores.

    The size that the plan expects says how many partitions there will be; nothing is run to find
    out.  A large table has enough of them and is not shuffled again.  A few small files, or the
    few partitions that adaptive execution leaves of a small shuffle, would leave most cores idle
    under a Python operator, so their rows are dealt out round-robin.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    unit = max(1, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")))
    return df if size // unit >= 2 * cores else df.repartition(3 * cores)
