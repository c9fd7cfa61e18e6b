"""Statistics: moments, quantiles, outliers, correlation, tests."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from notemill.session import materialize


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + term * d or tiny)
            c = 1.0 + term / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float | None, df: float | None) -> float | None:
    """Two-sided p-value of Student's t."""
    if t is None or df is None or math.isnan(t) or df <= 0:
        return None
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else t_two_sided(float(a), float(b)) for a, b in zip(t, df, strict=True)], dtype="float64")


def paired_tests(table: DataFrame, columns: list[str]) -> DataFrame:
    """Paired t-test of every pair of columns: (first, second, n, mean_diff, t, df, p)."""
    pairs = list(combinations(columns, 2))
    sums = table.agg(*[f(F.col(a) - F.col(b)).alias(f"{n}_{k}") for k, (a, b) in enumerate(pairs) for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"n_{k}").alias("n"), F.col(f"m_{k}").alias("mean_diff"), F.col(f"s_{k}").alias("s")) for k, (a, b) in enumerate(pairs)]))
    out = sums.select(rows.alias("r")).select("r.*")
    t = F.try_divide("mean_diff", F.col("s") / F.sqrt("n"))
    return out.withColumn("t", t).withColumn("df", F.col("n") - 1).withColumn("p", t_p_value("t", F.col("df").cast("double"))).drop("s")


def welch_tests(table: DataFrame, group: str, value: str, by: list[str] | None = None, max_groups: int = 10_000) -> DataFrame:
    """Welch's t-test of every pair of groups: (by, first, second, mean_diff, t, df, p).

    With ``by`` only groups of the same keys are compared.  There are as many tests as pairs, so more
    than ``max_groups`` groups are refused.
    """
    by = by or []
    stats = table.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, group).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    stats = materialize(stats, groups=F.count(F.lit(1)))
    if stats.counts["groups"] > max_groups:
        raise ValueError(f"more than {max_groups} groups")
    a, b = stats.select(*by, *[F.col(c).alias(f"{c}1") for c in (group, "m", "v", "n")]), stats.select(*by, *[F.col(c).alias(f"{c}2") for c in (group, "m", "v", "n")])
    pairs = (a.join(b, by) if by else a.join(b)).where(F.col(f"{group}1") < F.col(f"{group}2"))
    q1, q2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    df = F.try_divide((q1 + q2) * (q1 + q2), q1 * q1 / (F.col("n1") - 1) + q2 * q2 / (F.col("n2") - 1))
    big = pairs.where("n1 > 1 and n2 > 1")
    return big.select(
        *by, F.col(f"{group}1").alias("first"), F.col(f"{group}2").alias("second"), (F.col("m1") - F.col("m2")).alias("mean_diff"), F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(q1 + q2)).alias("t"), df.alias("df")
    ).withColumn("p", t_p_value("t", "df"))


def quartiles(table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Exact quartiles by linear interpolation: (keys, metric, q1, median, q3, low, high).

    low and high are the whiskers: the outermost values within 1.5 IQR of the box.
    """
    long = unpivot(table, keys, columns)
    q = long.groupBy(*keys, "metric").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    fences = q.select(*keys, "metric", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = long.join(fences, [*keys, "metric"]).where((F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach))
    return inside.groupBy(*keys, "metric", "q1", "median", "q3").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def unpivot(table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, metric, value) with one row per column whose value is not null."""
    packed = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return table.select(*keys, F.explode(packed).alias("_x")).select(*keys, "_x.metric", "_x.value").where("value is not null")


def drop_outliers(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows within 1.5 IQR of the box in every column, bounds taken anew after each column."""

    def step(df: DataFrame, column: str) -> DataFrame:
        q = df.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
        reach = 1.5 * (F.col("_q")[1] - F.col("_q")[0])
        return df.crossJoin(F.broadcast(q)).where(F.col(column).between(F.col("_q")[0] - reach, F.col("_q")[1] + reach)).drop("_q")

    return reduce(step, columns, table)


def correlations(table: DataFrame, columns: list[str]) -> DataFrame:
    """(first, second, corr) for every pair of columns; null for a constant column.

    One distributed pass gives the whole matrix; rows with a null in any column are skipped.
    """
    pairs = list(combinations(range(len(columns)), 2))
    spark = table.sparkSession
    schema = "first string, second string, corr double"
    if not pairs:
        return spark.createDataFrame([], schema)
    numbers = table.select(*[F.col(c).cast("double") for c in columns])
    rows = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip").transform(numbers).select("_x")
    if rows.isEmpty():
        return spark.createDataFrame([(columns[i], columns[j], None) for i, j in pairs], schema)
    matrix = Correlation.corr(rows, "_x").first()[0].toArray()
    known = [(columns[i], columns[j], None if math.isnan(matrix[i, j]) else float(matrix[i, j])) for i, j in pairs]
    return spark.createDataFrame(known, schema)


def standardized(table: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; a constant column becomes 0."""
    moments = table.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return table.crossJoin(F.broadcast(moments)).withColumns(scaled).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def sample_size_of(population: Column, z: float = 2.576, error: float = 0.02, share: float = 0.5) -> Column:
    """``sample_size`` of a column of populations."""
    endless = z * z * share * (1 - share) / (error * error)
    return F.ceil(F.lit(endless) / (1 + F.lit(endless - 1) / population)).cast("long")


def sample_size(population: int, z: float = 2.576, error: float = 0.02, share: float = 0.5) -> int:
    """Sample that a finite population needs for a margin of error."""
    endless = z * z * share * (1 - share) / (error * error)
    return math.ceil(endless / (1 + (endless - 1) / population))
