"""Terms and keywords as JVM-side expressions, shared by the term operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.operators.current import current_rows

#: Whole runs of letters of any script, digits and underscores that do not begin with a digit.
TERM = r"(?<![\p{L}\p{Nd}_])[\p{L}_][\p{L}\p{Nd}_]*+"


def term_array(text: Column) -> Column:
    """All terms of a text in order, repeats included; null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), 0)


def keyword_array(keywords: Column) -> Column:
    """Keywords in lower case, white space, hyphens and underscores as one space; blank ones dropped."""
    clean = F.transform(
        F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: k.isNotNull()),
        lambda k: F.trim(F.regexp_replace(F.lower(k), r"(?U)[\s_\p{Pd}]+", " ")),
    )
    return F.filter(clean, lambda k: k != "")


def current_contents(nb_contents: DataFrame) -> DataFrame:
    """Current row of each notebook with its three texts."""
    return current_rows(nb_contents, ["notebook_id"], "scraped_at", ["code", "in_line_comment", "markdown_narrative"])
