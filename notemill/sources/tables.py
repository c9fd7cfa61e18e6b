"""CSV tables, error logs and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions.lists import parse_list, print_list

KERNELS = "id long, ref string, user string, slug string, title string, author string, last_run_time string, total_votes string"
PREDICTIONS = "notebook string, part string, term_type string, embedding_type string, top_domains string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header under a declared schema; quoted fields may hold line breaks."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions whose lists were written in printed form."""
    return read_csv(spark, path, PREDICTIONS).withColumn("top_domains", parse_list(F.col("top_domains")))


def write_predictions(df: DataFrame, path: str) -> None:
    write_csv(df.withColumn("top_domains", print_list(F.col("top_domains"))), path)


def write_unique(values: DataFrame, column: str, path: str) -> None:
    """The distinct values of a column as lines of text, in order."""
    values.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").write.mode("overwrite").text(path)


def append_errors(errors: DataFrame, path: str) -> None:
    """Append (ref, error) to a log without header."""
    errors.select("ref", "error").write.mode("append").csv(path, header=False, escape='"')


def salient_report(terms: DataFrame, titles: dict[str, str]) -> DataFrame:
    """(notebook_id, report): salient terms (notebook_id, method, term, score, rank) as a text, a section per method.

    A method without terms for a notebook has the line ``N/A``.
    """
    line = F.format_string("%d. %s (%.4f)", F.col("rank"), F.col("term"), F.col("score"))
    lists = terms.withColumn("line", line).groupBy("notebook_id").pivot("method", list(titles)).agg(F.sort_array(F.collect_list(F.struct("rank", "line"))))
    sections = []
    for method, title in titles.items():
        rows = F.when(F.size(method) > 0, F.array_join(F.transform(method, lambda x: x["line"]), "\n")).otherwise("N/A")
        sections.append(F.concat(F.lit(f"== {title} ==\n"), rows))
    return lists.select("notebook_id", F.concat_ws("\n\n", *sections).alias("report"))


def parse_report(reports: DataFrame, titles: dict[str, str]) -> DataFrame:
    """(notebook_id, method, term, rank) back from the reports; sections with ``N/A`` have none."""
    own = F.array(*[F.struct(F.lit(m).alias("method"), F.regexp_extract("report", rf"(?s)== \Q{t}\E ==\n(.*?)(?:\n\n== |\z)", 1).alias("body")) for m, t in titles.items()])
    rows = reports.select("notebook_id", F.explode(own).alias("s")).where(~F.col("s.body").contains("N/A"))
    lines = rows.select("notebook_id", "s.method", F.explode(F.split("s.body", "\n")).alias("line")).where("line <> ''")
    return lines.select("notebook_id", "method", F.regexp_extract("line", r"^\d+\. (.*) \([-0-9.]+\)$", 1).alias("term"), F.regexp_extract("line", r"^(\d+)\.", 1).cast("long").alias("rank"))


def coefficient_report(coefficients: list[dict], classes: list[str]) -> str:
    """Text of coefficient statistics by class, most significant first; made from a small collected table."""
    out = []
    for k in classes:
        own = sorted((c for c in coefficients if c["class"] == k and c["feature"] != "intercept"), key=lambda c: (c["p_value"], -abs(c["coefficient"]), c["feature"]))
        out.append(f"Class: {k}")
        out += [f"  {c['feature']}: {c['coefficient']:.4f} [{c['lower_ci']:.4f}, {c['upper_ci']:.4f}] p={c['p_value']:.4f}{' *' if c['is_significant'] else ''}" for c in own] or ["  no features"]
        out.append("")
    return "\n".join(out)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors (term_type, embed_type, term, vec) as parquet by type; a null vector becomes zeros of its type's width."""
    width = F.element_at(F.create_map(F.lit("bert"), F.lit(768), F.lit("word2vec"), F.lit(300), F.lit("glove"), F.lit(100)), F.col("embed_type"))
    filled = F.coalesce("vec", F.array_repeat(F.lit(0.0), F.coalesce(width, F.lit(0))))
    vectors.withColumn("vec", filled).write.mode("overwrite").partitionBy("embed_type", "term_type").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parse_vector_json(files: DataFrame) -> DataFrame:
    """(stem, term_type, embed_type, term, vec) of (path, value): JSON objects named ``<stem>_<term_type>_<embed_type>.json``."""
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    parts = F.regexp_extract_all(name, F.lit(r"^(.*)_([^_]+)_([^_]+)$"), 1)
    rows = files.where(F.size(parts) > 0).select(
        F.regexp_extract(name, r"^(.*)_([^_]+)_([^_]+)$", 1).alias("stem"), F.regexp_extract(name, r"^(.*)_([^_]+)_([^_]+)$", 2).alias("term_type"), F.regexp_extract(name, r"^(.*)_([^_]+)_([^_]+)$", 3).alias("embed_type"), F.explode(F.from_json("value", "map<string, array<double>>")).alias("term", "vec")
    )
    return rows
