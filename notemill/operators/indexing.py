"""Dense integer ids over a distributed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.operators.skew import lookup
from notemill.session import materialize


def dense_index(df: DataFrame, order: list[str], name: str, heavy: tuple[str, ...] = ()) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... along ``order`` (ascending), without a global sort in one task.

    Rows are range-partitioned and numbered within partitions; offsets come from one count per
    partition, so what is broadcast is as long as the number of partitions.  Rows equal in
    ``order`` get distinct ids.  The result is a materialised table; its attribute ``heavy`` has the
    heavy values of the columns ``heavy``.
    """
    numbered = materialize(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        heavy,
    )
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    out = (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + local)
        .drop("_at", "_part", "_before")
    )
    out._notemill_path, out.heavy = numbered._notemill_path, numbered.heavy
    return out


def rank_within(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... along ``order`` within each ``key``, however many rows a key has.

    A window would put a hot key into one task; here the rank is the dense id of the row less the
    least id of its key.  Null keys are ranked among themselves.
    """
    numbered = dense_index(df.withColumn("_key", F.col(key)), ["_key", *order], "_id", ("_key",))
    first = numbered.groupBy("_key").agg(F.min("_id").alias("_first"))
    # null keys stand first, from id 0 on
    joined = lookup(numbered, first.where("_key is not null"), "_key", heavy=numbered.heavy["_key"])
    return joined.withColumn(name, F.col("_id") - F.coalesce("_first", F.lit(0))).drop("_id", "_first", "_key")
