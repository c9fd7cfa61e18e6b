"""Session set-up and lineage cutting.

A cluster names a shared folder in ``spark.checkpoint.dir``; intermediate tables are written
there.  Only a session without that setting (tests, local runs) gets a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_dir: str | None = None
_runs: dict[str, str] = {}


def build_session(app: str = "notemill", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, else a local one."""
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="notemill-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return "file://" + _local_dir


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables in the shared folder.

    The file system itself deletes it when the driver's JVM ends, so it is gone also if the
    session was stopped before.
    """
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_dir(spark)}/notemill/{app}-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_runs[app])
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _runs[app]


def materialize(df: DataFrame, heavy: tuple[str, ...] = (), hot: int = 1024, **counts: Column) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result survives the loss of executors, has a short lineage and fixed contents, so
    what depends on partition numbers or on sampling stays the same when it is read again.

    While the table is written, the values with more than 1/``hot`` of its rows are found in the
    columns ``heavy`` (a sketch that can miss a value only if it has hardly more than that), and
    ``counts`` are taken.  They are the attributes ``heavy`` (column -> values), ``counts``.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    seen = Observation()
    asked = {**counts, **{f"_h_{c}": F.expr(f"approx_top_k(`{c}`, {hot}, {8 * hot})") for c in heavy}}
    (df.observe(seen, F.count(F.lit(1)).alias("_n"), *[x.alias(k) for k, x in asked.items()]) if asked else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._notemill_path = path
    got = seen.get if asked else {}
    out.counts = {k: got[k] for k in counts}
    out.heavy = {c: [r[0] for r in got[f"_h_{c}"] or [] if r[0] is not None and r[1] * hot > got["_n"]] for c in heavy}
    return out


def release(df: DataFrame | None) -> None:
    """Delete the files of a table made by ``materialize``; anything else is left alone."""
    path = getattr(df, "_notemill_path", None)
    if path is not None:
        target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
