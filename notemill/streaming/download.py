"""Resumable downloads: kernel references in the order of their ids, a failed one first the next time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "id long, ref string, ok boolean, error string"


def attempt(kernels: DataFrame, fetch: Callable[[str], None], tasks: int = 5) -> DataFrame:
    """(id, ref, ok, error) of calling ``fetch(ref)`` for every row, in ``tasks`` tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, ref in zip(batch["id"], batch["ref"], strict=True):
                try:
                    fetch(ref)
                    rows.append((i, ref, True, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((i, ref, False, str(e)))
            yield pd.DataFrame(rows, columns=["id", "ref", "ok", "error"])

    return kernels.select("id", "ref").repartition(tasks).mapInPandas(run, RESULT)


def download(spark: SparkSession, source: str, results: str, checkpoint: str, fetch: Callable[[str], None], files_per_batch: int = 10) -> None:
    """Fetch the kernels of new files in ``source`` (JSON: id, ref) and append outcomes to ``results``.

    The checkpoint holds how far the stream came, so a run after a crash goes on where the last one
    stopped, and a batch that is repeated overwrites its own outcome.  Failed references are logged;
    ``resume`` tries them again.
    """
    stream = spark.readStream.schema("id long, ref string").option("maxFilesPerTrigger", files_per_batch).json(source)

    def batch(df: DataFrame, number: int) -> None:
        attempt(df, fetch).write.mode("overwrite").parquet(f"{results}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def resume(kernels: DataFrame, progress: str, fetch: Callable[[str], None], at_once: int = 100, tasks: int = 5) -> bool:
    """Fetch ``kernels`` (id, ref) in the order of their ids; True if all were fetched.

    ``progress`` is a table of one row, ``current_id``.  References below it are skipped.  Up to
    ``at_once`` are fetched together; at the first that fails, its id becomes the ``current_id`` and
    False is returned, so the next call begins with it.  What came after it within the same
    batch is fetched again then.  Rows without an id or reference are left out.
    """
    spark = kernels.sparkSession
    current = read_progress(spark, progress)
    left = kernels.select("id", "ref").where("id is not null and ref is not null")
    while True:
        rows = left if current is None else left.where(F.col("id") >= current)
        batch = rows.orderBy("id", "ref").limit(at_once)
        outcome = attempt(batch, fetch, tasks).agg(F.min(F.when(~F.col("ok"), F.col("id"))).alias("failed"), F.max("id").alias("last"), F.count("*").alias("n")).first()
        if outcome["failed"] is not None:
            write_progress(spark, progress, outcome["failed"])
            return False
        if not outcome["n"]:
            return True
        current = outcome["last"] + 1
        write_progress(spark, progress, current)


def read_progress(spark: SparkSession, progress: str) -> int | None:
    """The id to go on with; None before the first run."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(progress)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    row = spark.read.schema("current_id long").json(progress).agg(F.max("current_id").alias("x")).first()
    return row["x"]


def write_progress(spark: SparkSession, progress: str, current: int) -> None:
    spark.createDataFrame([(current,)], "current_id long").coalesce(1).write.mode("overwrite").json(progress)


def failures(spark: SparkSession, results: str) -> DataFrame:
    """References that failed and were not fetched later."""
    rows = spark.read.parquet(results)
    return rows.groupBy("id", "ref").agg(F.max("ok").alias("ok"), F.max("error").alias("error")).where("not ok").select("id", "ref", "error")
