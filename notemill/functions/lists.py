"""Lists of labels: their printed form, first label, precision at k."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_list(text: Column) -> Column:
    """The list that a printed list means; where it cannot be read, all quoted parts."""
    read = F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})
    return F.coalesce(read, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("'(.*?)'"), 1))


def print_list(items: Column) -> Column:
    """A list as Python prints it: single quotes, or double ones where a label has a single quote."""
    quoted = F.transform(items, lambda x: F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def first_label(items: Column, default: str = "Unknown") -> Column:
    return F.coalesce(F.get(items, F.lit(0)), F.lit(default))


def precision_at_k(predicted: Column, truth: Column, k: int = 3) -> Column:
    """Share of the first k predictions among the true labels, regardless of case.

    Null if there are fewer than k true labels (that test comes first); 0 without predictions;
    fewer than k predictions are measured against their own number; repeats count each.
    """
    truth_low = F.transform(truth, F.lower)
    top = F.transform(F.slice(predicted, 1, k), F.lower)
    hits = F.size(F.filter(top, lambda x: F.array_contains(truth_low, x)))
    return (
        F.when(truth.isNull() | (F.size(truth) < k), F.lit(None).cast("double"))
        .when(predicted.isNull() | (F.size(predicted) == 0), F.lit(0.0))
        .otherwise(hits / F.least(F.lit(k), F.size(predicted)).cast("double"))
    )
