"""Text functions as Column expressions: line cleaning, tokens, comments, categories, prompts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from notemill.functions.stopwords import ENGLISH

LINE_END = "\r\n|[\n\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
CELL_HEAD = r"^Content of code cell #\d+:"
RULE, BAR = "-" * 30, "=" * 17
#: Where each kind of part text has its file header and its cell headers.
FRAMES = {"comment": ("Comments extracted from:", "Comments from Code Cell"), "narrative": ("Markdown Narrative from:", "Markdown Cell #")}


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def text_lines(text: Column) -> Column:
    """The lines of a text; null gives none."""
    return F.split(F.coalesce(text, F.lit("")), LINE_END)


def clean_lines(text: Column, kind: str) -> Column:
    """Content lines of a part text as an array, frame removed; other kinds give all lines.

    File headers are skipped only before the first other line, so a later line with a bar of ``=``
    stays; lines with a rule of 30 ``-`` never do.
    """
    lines = text_lines(text)
    if kind == "code":
        bare = F.transform(lines, lambda x: strip(F.regexp_replace(x, CELL_HEAD, "")))
        return F.filter(bare, lambda x: x != "")
    if kind not in FRAMES:
        return lines
    head, cell = FRAMES[kind]
    is_head = F.transform(lines, lambda x: x.contains(head) | x.contains(BAR))
    start = F.array_position(is_head, False).cast("int")
    body = F.when(start > 0, F.slice(lines, F.greatest(start, F.lit(1)), F.size(lines))).otherwise(F.array().cast("array<string>"))
    kept = F.filter(body, lambda x: (strip(x) != "") & ~x.contains(RULE) & ~x.startswith(cell))
    if kind == "comment":
        kept = F.transform(kept, lambda x: F.regexp_replace(x, r"(?U)^\s*-\s*", ""))
    return F.filter(F.transform(kept, strip), lambda x: x != "")


def clean_text(text: Column, kind: str) -> Column:
    """Content lines joined by line feeds."""
    return F.array_join(clean_lines(text, kind), "\n") if kind in ("code", *FRAMES) else F.coalesce(text, F.lit(""))


def count_lines(text: Column) -> Column:
    """Number of lines that are not blank."""
    return F.size(F.filter(text_lines(text), lambda x: strip(x) != "")).cast("long")


def part_kind(stem: Column) -> Column:
    """Kind of a part by its file stem: first of code, comment, narrative that it contains."""
    low = F.lower(stem)
    return F.when(low.contains("code"), "code").when(low.contains("comment"), "comment").when(low.contains("narrative"), "narrative").otherwise("unknown")


def part_label(part: Column) -> Column:
    """The name that predictions have for a part."""
    return F.when(part == "narrative", "markdown narrative").when(part == "combined", "all combined").otherwise(part)


def tokens(text: Column, stopwords: Iterable[str] = ENGLISH, least: int = 4, most: int = 15) -> Column:
    """Lower-case words of letters and underscores, ``least`` to ``most`` long, none led by ``_``, no stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}_]+"), 0)
    kept = F.filter(words, lambda w: F.length(w).between(least, most) & ~w.startswith("_"))
    return F.filter(kept, lambda w: ~w.isin(list(stopwords)))


def code_cells(text: Column) -> Column:
    """Cells of a code text as array<struct<cell int, source string>>."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"(?=Content of code cell #\d+:)")
    own = F.filter(parts, lambda p: p.rlike(r"^Content of code cell #\d+:"))
    return F.transform(
        own,
        lambda p: F.struct(
            F.regexp_extract(p, r"^Content of code cell #(\d+):", 1).cast("int").alias("cell"),
            F.regexp_replace(p, r"^Content of code cell #\d+:", "").alias("source"),
        ),
    )


def inline_comments(source: Column) -> Column:
    """Comments of a cell by pattern, as the notebooks' own extraction has them: ``#`` in strings
    counts, and a bare ``#`` takes the next line that is not blank."""
    found = F.regexp_extract_all(source, F.lit(r"(?Um)#\s*(.*?)$"), 1)
    return F.filter(F.transform(found, strip), lambda x: x != "")


def relevance(text: Column) -> Column:
    """Relevance category of a judge's answer; the order of the tests decides."""
    t = F.lower(text)
    return (
        F.when(text.isNull(), "Unknown")
        .when(t.contains("highly relevant") | t.contains("very relevant"), "Highly Relevant")
        .when(t.contains("relevant") & ~t.contains("partially") & ~t.contains("somewhat"), "Relevant")
        .when(t.contains("partially") | t.contains("somewhat"), "Partially Relevant")
        .otherwise("Unclear/Not Relevant")
    )


def specificity(text: Column) -> Column:
    """Specificity category of a judge's answer; the order of the tests decides."""
    t = F.lower(text)
    return (
        F.when(text.isNull(), "Unknown")
        .when(t.contains("very specific") | t.contains("appropriately specific"), "Appropriately Specific")
        .when(t.contains("general") | t.contains("broad"), "Too General")
        .when(t.contains("too specific") | t.contains("overly specific"), "Too Specific")
        .otherwise("Unclear")
    )


def shorten(text: Column, limit: int = 1500) -> Column:
    """At most ``limit`` characters, with dots where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def prompt(domain: Column, code: Column, narrative: Column) -> Column:
    """Question to a judge on whether ``domain`` fits; parts that are missing or empty are left out."""
    section = lambda title, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), shorten(x)))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Proposed domain: "), domain),
        section("Code", code),
        section("Narrative", narrative),
        F.lit("How relevant and how specific is the proposed domain for this notebook?"),
    )


def token_estimate(text: Column) -> Column:
    """Tokens estimated as characters / 4.7."""
    return F.length(F.coalesce(text, F.lit(""))) / 4.7


def squeeze(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def split_ref(ref: Column) -> Column:
    """``account/slug`` as struct<user, slug>; null unless there is exactly one slash."""
    parts = F.split(ref, "/")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("user"), parts[1].alias("slug")))
