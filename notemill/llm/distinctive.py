"""Problem 5: how distinctive a term is per record, by correspondence-analysis residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from notemill.llm.terms import current_contents, term_array
from notemill.operators.skew import bounded, join_heavy
from notemill.session import materialize

MAX_FIELDS = 10_000


def distinctive_terms(records: DataFrame) -> DataFrame:
    """Score the terms of ``records`` (notebook_id, field_name, terms array<string>).

    Returns (notebook_id, field_name, term, n_here, n_records, n_total, expected, residual,
    adjusted).  Within a field, expected = row sum x column sum / grand total; residual =
    (n_here - expected) / sqrt(expected); adjusted divides it by
    sqrt((1 - row share)(1 - column share)), which makes it a standard normal deviate if terms
    fell on records at random; it is 0 where a margin is the whole table.  Null terms count
    nothing, repeated (notebook_id, field_name) rows are one record, an empty table gives none; more
    than ``MAX_FIELDS`` fields are refused.
    """
    tokens = records.select("notebook_id", "field_name", F.explode("terms").alias("term")).where("term is not null")
    counts = tokens.groupBy("notebook_id", "field_name", "term").agg(F.count("*").alias("n_here"))
    # a record's cells stand together here; a join with the row totals would bring all cells together anew
    totals = F.sum("n_here").over(Window.partitionBy("notebook_id", "field_name"))
    # written once: three steps read the cells, and the texts are not taken apart again for each
    cells = materialize(counts.withColumn("row_total", totals), n=F.count(F.lit(1)))
    columns = materialize(cells.groupBy("field_name", "term").agg(F.count("*").alias("n_records"), F.sum("n_here").alias("n_total")))
    grand = bounded(columns.groupBy("field_name").agg(F.sum("n_total").alias("grand")), MAX_FIELDS, "fields")
    # terms with more than 1/1024 of the cells, of which there are fewer than 1024 in a field
    heavy = columns.where(F.col("n_records") * 1024 > cells.counts["n"]).select("term").distinct().collect()
    joined = join_heavy(cells.where("notebook_id is not null"), columns, ["field_name", "term"], "term", [r["term"] for r in heavy])
    joined = joined.join(grand, "field_name")
    row_share, column_share = F.col("row_total") / F.col("grand"), F.col("n_total") / F.col("grand")
    expected = F.col("row_total") * F.col("n_total").cast("double") / F.col("grand")
    residual = (F.col("n_here") - F.col("expected")) / F.sqrt("expected")
    spread = (1 - row_share) * (1 - column_share)
    return (
        joined.withColumn("expected", expected)
        .withColumn("residual", residual)
        .withColumn("adjusted", F.when(spread > 0, F.col("residual") / F.sqrt(F.greatest(spread, F.lit(1e-300)))).otherwise(0.0))
        .select("notebook_id", "field_name", "term", "n_here", "n_records", "n_total", "expected", "residual", "adjusted")
    )


def among_scored(scores: DataFrame, keep: str) -> DataFrame:
    """The rows of ``scores`` for which ``keep`` holds, written once every row has its ``adjusted``.

    A filter on counts alone would let Catalyst drop the scores and pass over the other terms.  The
    scores are observed before the filter, which cannot move below that, so every term is scored as
    in ``distinctive_terms``; a score that is no finite number is refused.
    """
    seen = Observation()
    finite = F.coalesce(F.abs("adjusted") < float("inf"), F.lit(False))
    kept = materialize(scores.observe(seen, F.count_if(~finite).alias("n_bad")).where(keep))
    if seen.get["n_bad"]:
        raise ValueError(f"{seen.get['n_bad']} terms without a finite score")
    return kept


def notebook_fields(nb_contents: DataFrame, fields: tuple[str, ...] = ("code", "in_line_comment", "markdown_narrative")) -> DataFrame:
    """Terms of the lower-cased current texts, one row per notebook and field."""
    current = current_contents(nb_contents)
    packed = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])
    return (
        current.select("notebook_id", F.explode(packed).alias("part"))
        .where("part.text is not null")
        .select("notebook_id", "part.field_name", term_array(F.lower("part.text")).alias("terms"))
    )
