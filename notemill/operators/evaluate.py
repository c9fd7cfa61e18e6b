"""Evaluation of predicted domains against tags; variations of notebooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.lists import precision_at_k
from notemill.functions.text import strip
from notemill.operators.current import current_rows

KEYS = ["notebook", "part", "term_type", "embedding_type"]


def notebook_name(stored: Column) -> Column:
    """One spelling of a stored notebook name: last part of a path, no extension or variation, lower case."""
    bare = F.regexp_replace(strip(F.lower(stored)), r"^.*/", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\.ipynb$", ""), r"_var\d+$", "")


def current_predictions(results: DataFrame) -> DataFrame:
    """The latest prediction of each (notebook, part, term_type, embedding_type)."""
    named = results.withColumn("notebook", notebook_name(F.col("notebook")))
    return current_rows(named, KEYS, "classified_at", ["top_domains"])


def tags_of(kernel_metadata: DataFrame) -> DataFrame:
    """(notebook, tags): distinct lower-case keywords of the current metadata, blank ones dropped.

    Notebooks go by their slug; those of several accounts with one slug share their tags.
    """
    current = current_rows(kernel_metadata, ["kernel_ref"], "scraped_at", ["keywords"])
    clean = F.transform(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: strip(F.regexp_replace(F.lower(x), r"(?U)[\s_-]+", " ")))
    tags = F.array_sort(F.array_distinct(F.filter(clean, lambda x: x != "")))
    named = current.select(F.element_at(F.split("kernel_ref", "/"), -1).alias("notebook"), tags.alias("tags"))
    return named.groupBy("notebook").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))


SPECIAL = "special_tags"


def evaluated(predictions: DataFrame, tags: DataFrame, k: int = 3) -> DataFrame:
    """Predictions with ``p_at_k``; a notebook without tags has none, and p_at_k is null.  Labels
    are compared with white space, hyphens and underscores as one space.  Tags of a notebook named
    ``special_tags`` hold for all notebooks, with tags of their own or not."""
    special = tags.where(F.col("notebook") == SPECIAL).agg(F.first("tags").alias("_special"))
    joined = predictions.join(tags, "notebook", "left").crossJoin(F.broadcast(special)).withColumn("tags", F.coalesce("_special", "tags"))
    same = F.transform("top_domains", lambda x: F.regexp_replace(F.lower(x), r"(?U)[\s_-]+", " "))
    return joined.select(*KEYS, precision_at_k(same, F.coalesce("tags", F.array().cast("array<string>")), k).alias("p_at_k"))


def rollups(scores: DataFrame) -> DataFrame:
    """Mean p_at_k by embedding, term type, part, both of the first, and all three, in one pass.

    Columns that a set leaves out are ``all``; null scores are skipped, sets with none stay null.
    """
    part, term, embedding = F.col("part"), F.col("term_type"), F.col("embedding_type")
    sets = [[embedding], [term], [part], [embedding, term], [part, term, embedding]]
    grouped = scores.groupingSets(sets, part, term, embedding).agg(F.avg("p_at_k").alias("mean_p_at_k"), F.count("p_at_k").alias("n"))
    return grouped.select(*[F.coalesce(c, F.lit("all")).alias(c) for c in ("part", "term_type", "embedding_type")], "mean_p_at_k", "n")


def combined_or_all(results: DataFrame) -> DataFrame:
    """Rows of the part ``all combined``, or all rows if there is none at all."""
    any_combined = results.agg(F.coalesce(F.max((F.col("part") == "all combined").cast("int")), F.lit(0)).alias("_any"))
    return results.crossJoin(F.broadcast(any_combined)).where((F.col("_any") == 0) | (F.col("part") == "all combined")).drop("_any")


def variations(predictions: DataFrame, wanted: int = 9) -> DataFrame:
    """(notebook, variation_idx, term_type, embedding_type, domain): up to ``wanted`` variations of each.

    Variations are numbered from 0 in the order of term and embedding types; one whose list is
    empty leaves a hole.  Notebooks with fewer are padded with the domain of variation 0, or
    ``unknown``; more than ``wanted`` are kept.
    """
    order = Window.partitionBy("notebook").orderBy("term_type", "embedding_type")
    numbered = predictions.select("notebook", "term_type", "embedding_type", F.get("top_domains", F.lit(0)).alias("domain"), (F.row_number().over(order) - 1).cast("long").alias("variation_idx"))
    per = numbered.groupBy("notebook").agg(F.count("*").alias("_n"), F.max(F.when(F.col("variation_idx") == 0, F.col("domain"))).alias("_first"))
    padding = per.where(F.col("_n") < wanted).select(
        "notebook", F.coalesce("_first", F.lit("unknown")).alias("domain"), F.explode(F.sequence(F.col("_n"), F.lit(wanted - 1).cast("long"))).alias("variation_idx")
    )
    padded = padding.select("notebook", "variation_idx", F.concat(F.lit("padded_"), F.col("variation_idx").cast("string")).alias("term_type"), F.lit("padded").alias("embedding_type"), "domain")
    return numbered.where("domain is not null").select("notebook", "variation_idx", "term_type", "embedding_type", "domain").unionByName(padded)
