"""Judging predictions by a scorer: any callable from a prompt to an answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import prompt, squeeze, token_estimate
from notemill.operators.indexing import dense_index
from notemill.streaming.budget import TokenBudget


def judge(rows: DataFrame, scorer: Callable[[str], str | None], tasks: int = 5, tokens: int = 200_000, requests: int = 1_000, tries: int = 3) -> DataFrame:
    """``rows`` (domain, code, narrative, ...) with ``answer``: the scorer's answer, white space squeezed.

    Each of ``tasks`` tasks keeps to its share of the tokens and requests a minute; a scorer that
    fails ``tries`` times gives null.
    """
    asked = rows.withColumn("_prompt", prompt(F.col("domain"), F.col("code"), F.col("narrative"))).withColumn("_tokens", token_estimate(F.col("_prompt")))
    names = [c for c in asked.columns if not c.startswith("_")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", answer string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        budget = TokenBudget(tokens, requests, tasks)
        for batch in batches:
            answers = []
            for text, n in zip(batch["_prompt"], batch["_tokens"], strict=True):
                answer = None
                for _ in range(tries):
                    budget.take(n)
                    try:
                        answer = scorer(text)
                        break
                    except Exception:  # noqa: BLE001, S112
                        continue
                answers.append(answer)
            yield batch[names].assign(answer=answers)

    return asked.repartition(tasks).mapInPandas(run, schema).withColumn("answer", squeeze(F.col("answer")))


def judge_in_chunks(rows: DataFrame, order: list[str], scorer: Callable[[str], str | None], path: str, size: int = 20, **limits: int) -> DataFrame:
    """``judge`` whose answers are kept in ``path`` by chunks of ``size`` rows along ``order``; the answers so far.

    Chunks that are there already are not asked for again, so a run that broke off goes on where it
    was.  A chunk is written as a whole.  ``rows`` and ``order`` must be the same in every run.
    """
    spark = rows.sparkSession
    numbered = dense_index(rows, order, "_number").withColumn("chunk", F.floor(F.col("_number") / size)).drop("_number")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        numbered = numbered.join(spark.read.parquet(path).select("chunk").distinct(), "chunk", "left_anti")
    if not numbered.isEmpty():
        judge(numbered, scorer, **limits).repartition("chunk").write.mode("append").partitionBy("chunk").parquet(path)
    return spark.read.parquet(path) if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder) else judge(numbered, scorer, **limits)
