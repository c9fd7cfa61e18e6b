"""Joins of rows with statistics of their keys, safe under hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.session import materialize


def join_key_stats(rows: DataFrame, stats: DataFrame, keys: list[str], size: str, hot: int = 1024) -> DataFrame:
    """Inner join of ``rows`` with one-row-per-key ``stats`` whose ``size`` counts the key's rows.

    A key with more than 1/``hot`` of all rows is hot.  There can be at most ``hot`` such keys,
    which bounds the broadcast side; all other keys are joined by a shuffle in which no key has
    more than that share.  Both ways give the same rows, and together every row once.
    Keys that are null match nothing.
    """
    total = stats.agg(F.sum(size).alias("_total"))
    flagged = stats.crossJoin(F.broadcast(total)).withColumn("_hot", F.col(size) * hot > F.col("_total")).drop("_total")
    heavy = flagged.where("_hot").drop("_hot")
    light = flagged.where("not _hot").drop("_hot")
    by_broadcast = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return by_broadcast.unionByName(rest.join(light, keys))


def join_heavy(rows: DataFrame, table: DataFrame, keys: list[str], column: str, heavy: list) -> DataFrame:
    """Inner join of ``rows`` with ``table``, one row per ``keys``, of which ``column`` is one.

    ``heavy`` are the values of ``column`` with a large share of ``rows``, as ``materialize`` finds
    them: fewer than 1,024.  Their entries are broadcast, all others are joined by a shuffle.
    """
    if not heavy:
        return rows.join(table, keys)
    is_hot = F.coalesce(F.col(column).isin(heavy), F.lit(False))
    by_broadcast = rows.where(is_hot).join(F.broadcast(table.where(is_hot)), keys)
    return by_broadcast.unionByName(rows.where(~is_hot).join(table.where(~is_hot), keys))


def bounded(table: DataFrame, limit: int, what: str) -> DataFrame:
    """``table``, written and marked for broadcast; refused if it has more than ``limit`` rows."""
    small = materialize(table, n=F.count(F.lit(1)))
    if small.counts["n"] > limit:
        raise ValueError(f"more than {limit} {what}")
    return F.broadcast(small)


def lookup(rows: DataFrame, table: DataFrame, key: str, hot: int = 1024, heavy: list | None = None) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has at most one row per ``key``.

    Keys with more than 1/``hot`` of all rows are ``heavy``; if not told (``materialize`` finds them
    while it writes) they are found first, by counts, of which there are fewer than ``hot``.  Their
    entries are broadcast, so no task gets more than that share by one key.  Null keys and keys that
    ``table`` lacks get nulls.
    """
    if heavy is None:
        total = rows.agg(F.count("*").alias("_total"))
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
        found = counts.crossJoin(F.broadcast(total)).where(F.col("_n") * hot > F.col("_total")).select(key)
        heavy = [r[0] for r in found.limit(hot).collect()]
    if not heavy:
        return rows.join(table, key, "left")
    is_hot = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    by_broadcast = rows.where(is_hot).join(F.broadcast(table.where(F.col(key).isin(heavy))), key, "left")
    return by_broadcast.unionByName(rows.where(~is_hot).join(table, key, "left"))
