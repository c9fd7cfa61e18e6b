"""Queries of the training-data operators: (session, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm import codetext, distinctive, frequency, leakage, markup, mixing, sentences, splits, subjects

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_term_frequency(spark: SparkSession, folder: str) -> DataFrame:
    records = frequency.notebook_records(table(spark, folder, "kernel_metadata"), table(spark, folder, "nb_contents"))
    return frequency.term_frequencies(records).drop("term_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_term_frequency(spark, folder).where("mark is not null").select("field_name", "term", "mark")


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    return markup.strip_markup(table(spark, folder, "nb_contents"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.structures(p2_clean(spark, folder)).select("notebook_id", "family", "structure")


def _code_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return codetext.language_in_code(table(spark, folder, "nb_contents"), table(spark, folder, "documents"))


def p3_shares(spark: SparkSession, folder: str) -> DataFrame:
    return codetext.language_shares(_code_phrases(spark, folder)).withColumn("share", F.round("share", 6))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _code_phrases(spark, folder).select("notebook_id", "lang", "found_in").distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = splits.kernel_groups(table(spark, folder, "kernels"))
    return splits.group_of_notebooks(table(spark, folder, "domain_classification_results"), groups)


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    groups = splits.kernel_groups(table(spark, folder, "kernels"), by_slug=True)
    rows = splits.related_rows(table(spark, folder, "domain_classification_results"), table(spark, folder, "code_complexity"), groups)
    sizes = rows.groupBy("group_key").agg(F.sum("n_rows").alias("n_rows"))
    assigned = splits.split_groups(sizes, SHARES)
    return splits.lookup(rows.drop("slug"), assigned.select("group_key", "split"), "group_key").select("kind", "notebook", "n_rows", "group_key", "split")


def p5_distinctive(spark: SparkSession, folder: str) -> DataFrame:
    scores = distinctive.distinctive_terms(distinctive.notebook_fields(table(spark, folder, "nb_contents")))
    rounded = {c: F.round(c, 6) for c in ("expected", "residual", "adjusted")}
    return scores.withColumns(rounded)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    scores = distinctive.distinctive_terms(distinctive.notebook_fields(table(spark, folder, "nb_contents")))
    return distinctive.among_scored(scores, "n_here >= 4 and n_records between 2 and 5").select("notebook_id", "field_name", "term")


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    names = ("nb_contents", "domain_classification_results", "subject_labels", "subjects")
    return subjects.subject_shares(*[table(spark, folder, n) for n in names])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_shares(spark, folder).where(F.col("share") >= subjects.SHARE).select("notebook_id", "subject")


def p6_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Make-up of the collection: notebooks and sentences by subject."""
    shares = p6_shares(spark, folder)
    return shares.groupBy("subject").agg(
        F.count_if(F.col("share") >= subjects.SHARE).alias("n_notebooks"), F.sum("n_with").alias("n_sentences")
    )


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark_items"))
    return found.withColumns({c: F.round(c, 6) for c in ("score", "item_share", "passage_share", "question_share")})


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark_items"))
    return found.select("doc_id", "item_id").distinct()


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(*_mix(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1].select("source", "fate")


def p9_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences with their texts."""
    return sentences.sentence_texts(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.split_sentences(table(spark, folder, "documents")).select("doc_id", "start_pos", "end_pos").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}
