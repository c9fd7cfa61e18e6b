"""Notebooks into part texts: code, comments, narrative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import clean_text, code_cells, inline_comments
from notemill.operators.current import current_rows

COLUMNS = {"code": "code", "comment": "in_line_comment", "narrative": "markdown_narrative"}


def part_texts(nb_contents: DataFrame) -> DataFrame:
    """(notebook_id, part, text): the current, not-null part texts of stored notebooks."""
    current = current_rows(nb_contents, ["notebook_id"], "scraped_at", list(COLUMNS.values()))
    packed = F.array(*[F.struct(F.lit(p).alias("part"), F.col(c).alias("text")) for p, c in COLUMNS.items()])
    return current.select("notebook_id", F.explode(packed).alias("x")).where("x.text is not null").select("notebook_id", "x.part", "x.text")


def clean_part(part: Column, text: Column) -> Column:
    """Text of a part without its frame, by the rules of its kind."""
    out = F.coalesce(text, F.lit(""))
    for kind in COLUMNS:
        out = F.when(part == kind, clean_text(text, kind)).otherwise(out)
    return out


def render_parts(cells: DataFrame, name: str = "path") -> DataFrame:
    """(key, part, text) from cells (key, pos, cell_type, source): the texts with their frame.

    Code cells are numbered from 1 among the code cells, the header glued to the first line;
    narrative cells likewise among the markdown cells, each closed by a rule.
    """
    bar, rule = "=" * 50, "-" * 30
    own = cells.where(F.col("cell_type").isin("code", "markdown"))
    grouped = own.groupBy(name, "cell_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "source"))), lambda c: F.coalesce(c["source"], F.lit(""))).alias("sources"))
    code = F.array_join(F.transform("sources", lambda s, i: F.concat(F.lit("\nContent of code cell #"), (i + 1).cast("string"), F.lit(":"), s)), "")
    notes = F.transform("sources", lambda s, i: F.concat(F.lit("Markdown Cell #"), (i + 1).cast("string"), F.lit(":\n"), s, F.lit(f"\n\n{rule}\n\n")))
    text = F.when(F.col("cell_type") == "code", code).otherwise(F.concat(F.lit("Markdown Narrative from: "), F.col(name), F.lit(f"\n{bar}\n\n"), F.array_join(notes, "")))
    return grouped.select(name, F.when(F.col("cell_type") == "code", "code").otherwise("narrative").alias("part"), text.alias("text"))


def cell_comments(code: DataFrame, key: str = "notebook_id") -> DataFrame:
    """(key, cell, pos, comment): comments of every cell of (key, code), in order."""
    cells = code.select(key, F.explode(code_cells(F.col("code"))).alias("c"))
    return cells.select(key, F.col("c.cell").cast("long").alias("cell"), F.posexplode(inline_comments(F.col("c.source"))).alias("pos", "comment")).withColumn("pos", F.col("pos").cast("long"))


def comment_text(code: DataFrame, key: str = "notebook_id") -> DataFrame:
    """(key, text): the comment part as a text with its frame; a fixed sentence where there are none."""
    rule = "-" * 30
    per_cell = cell_comments(code, key).groupBy(key, "cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "comment"))), lambda c: F.concat(F.lit("- "), c["comment"], F.lit("\n"))).alias("lines"))
    blocks = per_cell.select(key, "cell", F.concat(F.lit("Comments from Code Cell #"), F.col("cell").cast("string"), F.lit(":\n"), F.array_join("lines", ""), F.lit(f"\n{rule}\n\n")).alias("block"))
    bodies = blocks.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell", "block"))), lambda b: b["block"]), "").alias("body"))
    head = "Comments extracted from: code.txt\n" + "=" * 50 + "\n\n"
    return code.select(key).distinct().join(bodies, key, "left").select(key, F.concat(F.lit(head), F.coalesce("body", F.lit("No comments found in the code.\n"))).alias("text"))
