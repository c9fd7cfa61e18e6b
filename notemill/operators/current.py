"""Current rows of tables that hold repeats and re-scrapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """The row with the latest ``time`` of each key, with ``keys`` and ``columns`` only.

    A partial aggregate per input partition comes before the shuffle, so a key with a third of
    all rows costs no more than any other.  Rows with a null key are left out; a null time is
    older than any other; of different rows with equal times the one whose values compare
    highest is kept, whatever the order of arrival.  An empty table gives an empty one.
    """
    values = [c for c in columns if c not in keys]
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    packed = F.struct(*[F.col(c) for c in values])
    order = F.struct(F.col(time), F.xxhash64(*[F.col(c) for c in values]))
    return (
        df.where(present)
        .groupBy(*keys)
        .agg(F.max_by(packed, order).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in values])
    )
