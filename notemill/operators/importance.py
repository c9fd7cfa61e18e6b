"""Tables of coefficients: the strongest by class, features by classes, selection of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def significant(statistics: DataFrame) -> DataFrame:
    """Rows of coefficient statistics (class, feature, coefficient, is_significant) that count: significant ones, intercepts left out."""
    return statistics.where(F.col("is_significant") & (F.col("feature") != "intercept"))


def strongest(statistics: DataFrame, limit: int = 12) -> DataFrame:
    """The ``limit`` largest coefficients by size of each class with their rank; ties go to the earlier feature."""
    order = Window.partitionBy("class").orderBy(F.desc(F.abs("coefficient")), "feature")
    return significant(statistics).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def busiest(statistics: DataFrame, limit: int = 12) -> DataFrame:
    """The classes with most significant features: (class, n)."""
    return significant(statistics).groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class").limit(limit)


def pivot_first(statistics: DataFrame, classes: list[str], features: list[str] | None = None) -> DataFrame:
    """(feature, a column for each class): the first coefficient of each, in the order of the features; null where there is none.

    A feature without any coefficient in ``classes`` is left out.
    """
    own = significant(statistics).where(F.col("class").isin(classes))
    if features is not None:
        own = own.where(F.col("feature").isin(features))
    return own.groupBy("feature").pivot("class", classes).agg(F.first("coefficient", ignorenulls=True)).orderBy("feature")


def mean_and_deviation(mean: Column, deviation: Column, digits: int = 4) -> Column:
    """``mean ± deviation`` as text; a missing deviation (a single value) is left out."""
    shown = F.format_string(f"%.{digits}f", F.round(mean, digits))
    return F.when(deviation.isNull(), shown).otherwise(F.concat(shown, F.lit(" ± "), F.format_string(f"%.{digits}f", F.round(deviation, digits))))
