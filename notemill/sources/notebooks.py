"""Notebook files and their metadata as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "cells array<struct<cell_type: string, source: string>>"


def read_notebooks(spark: SparkSession, root: str) -> DataFrame:
    """(path, account, folder, stem, content) of ``root/<account>/<folder>/*.ipynb``, exactly two levels deep."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ipynb").load(f"{root}/*/*/")
    pieces = F.split("path", "/")
    return files.select(
        "path", F.element_at(pieces, -3).alias("account"), F.element_at(pieces, -2).alias("folder"), F.regexp_replace(F.element_at(pieces, -1), r"\.ipynb$", "").alias("stem"), F.decode("content", "UTF-8").alias("content")
    )


def joined_source(source: Column) -> Column:
    """A cell's source as text; on disk it is a text or a list of lines."""
    return F.coalesce(F.array_join(F.from_json(source, "array<string>"), ""), source)


def notebook_cells(notebooks: DataFrame) -> DataFrame:
    """(path, pos, cell_type, source) of (path, content); a file that is no notebook of this form has no cells."""
    parsed = F.from_json("content", CELLS)
    return notebooks.select("path", F.posexplode(parsed["cells"]).alias("pos", "cell")).select("path", "pos", "cell.cell_type", joined_source(F.col("cell.source")).alias("source"))


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(path, account, notebook, keywords) of ``root/<account>/<notebook>/kernel-metadata.json``.

    A file that is empty, not JSON or without keywords has an empty list.
    """
    files = spark.read.option("pathGlobFilter", "kernel-metadata.json").text(f"{root}/*/*/", wholetext=True).withColumn("path", F.input_file_name())
    pieces = F.split("path", "/")
    keywords = F.from_json("value", "keywords array<string>")["keywords"]
    return files.select("path", F.element_at(pieces, -3).alias("account"), F.element_at(pieces, -2).alias("notebook"), F.coalesce(keywords, F.array().cast("array<string>")).alias("keywords"))


def read_part_files(spark: SparkSession, root: str, ordered: bool = False) -> DataFrame:
    """(notebook, stem, text) of all ``.txt`` files below ``root``, hidden ones left out; ``ordered`` by path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "[!.]*.txt").text(root, wholetext=True).withColumn("path", F.input_file_name())
    files = files.orderBy("path") if ordered else files
    pieces = F.split("path", "/")
    return files.select(F.element_at(pieces, -2).alias("notebook"), F.regexp_replace(F.element_at(pieces, -1), r"\.txt$", "").alias("stem"), F.col("value").alias("text"))
