"""Term vectors and the ranking of domains by cosine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.vectors import dot

#: Vectors by their kind: how long they are.
WIDTHS = {"bert": 768, "word2vec": 300, "glove": 100}


def vector_mean(vectors: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Component-wise mean of the vectors of each group as ``column``; null vectors are left out."""
    rows = vectors.where(F.col(column).isNotNull()).select(*keys, array_to_vector(column).alias("_v"))
    return rows.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(*keys, vector_to_array("_m").alias(column))


def embed_terms(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(term, vec): mean vector of a term's words under the table ``words`` (word, vec).

    Words that the table lacks are skipped; a term without any known word gets null.
    """
    distinct = terms.select("term").where("term is not null").distinct()
    parts = distinct.select("term", F.explode(F.split(F.lower("term"), r"\s+")).alias("word"))
    known = parts.join(words.select("word", "vec"), "word")
    return distinct.join(vector_mean(known, ["term"], "vec"), "term", "left")


def encode_terms(terms: DataFrame, encoder: Callable[[list[str]], np.ndarray], width: int = WIDTHS["bert"]) -> DataFrame:
    """(term, vec): vectors of whole terms by a model, such as the first output of a language model.

    ``encoder`` maps a list of texts to a matrix of ``width`` columns; it travels to the executors and
    is called with a batch of distinct terms at a time.  A batch that it fails on is tried term by
    term; a term that it fails on, and what is no number, becomes zeros.
    """

    def one(texts: list[str]) -> np.ndarray:
        try:
            out = np.asarray(encoder(texts), dtype=float).reshape(len(texts), width)
            return np.nan_to_num(out, posinf=0.0, neginf=0.0)
        except Exception:  # noqa: BLE001
            return np.zeros((1, width)) if len(texts) == 1 else np.vstack([one([t]) for t in texts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"term": batch["term"], "vec": list(one(batch["term"].tolist()))})

    return terms.select("term").where("term is not null").distinct().mapInPandas(run, "term string, vec array<double>")


def _unit_rows(vectors: pa.Array) -> np.ndarray:
    """The vectors as rows of length 1; zero vectors stay."""
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def rank_domains(terms: DataFrame, domains: DataFrame, keys: list[str], limit: int = 10, max_domains: int = 10_000) -> DataFrame:
    """Best domains of each group of terms: (keys, domain, score, rank).

    ``terms`` (keys, vec) and ``domains`` (domain, vec); a domain's score is the sum of the
    positive cosines over the terms.  Zero and null vectors count for nothing.  The domain table is a
    fixed list, larger ones than ``max_domains`` are refused; it travels as one matrix of unit vectors,
    and each batch of terms is one product with it, whose rows are added up by group before they leave.
    """
    spark = terms.sparkSession
    listed = domains.where("vec is not null and domain is not null").select("domain", "vec").limit(max_domains + 1).toArrow().sort_by("domain")
    if len(listed) > max_domains:
        raise ValueError(f"more than {max_domains} domains")
    matrix = _unit_rows(listed["vec"].combine_chunks()) if len(listed) else np.zeros((0, 0))
    some = np.abs(matrix).sum(axis=1) > 0
    names = [n for n, keep in zip(listed["domain"].to_pylist(), some, strict=True) if keep]
    columns = spark.sparkContext.broadcast(np.ascontiguousarray(matrix[some].T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch) or not columns.value.size:
                continue
            rows = _unit_rows(batch.column("vec"))
            some = rows.any(axis=1)
            if not some.any():
                continue
            batch, rows = batch.filter(pa.array(some)), rows[some]
            group = batch.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.diff(group[order], prepend=-1))
            scores = np.maximum(rows @ columns.value, 0.0)[order]
            sums = np.add.reduceat(scores, first, axis=0)
            own = batch.select(keys).take(pa.array(order[first]))
            offsets = np.arange(len(first) + 1, dtype=np.int32) * sums.shape[1]
            yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(offsets, sums.ravel())], names=[*keys, "_s"])

    known = terms.where("vec is not null").select(*keys, F.col("vec").cast("array<double>").alias("vec"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema if f.name != "vec")
    # rows of a group stand together, so that a batch adds up whole groups; a group that is larger than
    # a partition should be is shared out by adaptive execution
    together = known.hint("rebalance", *keys).sortWithinPartitions(*keys)
    partial = together.mapInArrow(run, schema + ", _s array<double>").select(*keys, F.posexplode("_s").alias("_k", "_x"))
    scores = partial.groupBy(*keys, "_k").agg(F.sum("_x").alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "_k")
    best = scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)
    table = spark.createDataFrame(list(enumerate(names)), "_k int, domain string")
    return best.join(F.broadcast(table), "_k").select(*keys, "domain", "score", "rank")


def top_lists(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Ranked labels as one ordered list per group: (keys, top_domains)."""
    return ranked.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "domain"))), lambda x: x["domain"]).alias("top_domains"))


def domains_of_terms(terms: DataFrame, labels: DataFrame, words: DataFrame, keys: list[str], limit: int = 10) -> DataFrame:
    """From salient terms to domains: (keys, domain, score, rank) of ``terms`` (keys, term).

    Terms and ``labels`` (domain) get vectors from the table ``words`` (word, vec), each distinct
    one once; a repeated term of a group counts each time.
    """
    vectors = embed_terms(terms, words)
    named = embed_terms(labels.select(F.col("domain").alias("term")), words).select(F.col("term").alias("domain"), "vec")
    return rank_domains(terms.select(*keys, "term").join(vectors, "term"), named, keys, limit)


def principal_components(vectors: DataFrame, column: str, k: int = 2) -> DataFrame:
    """``vectors`` with ``components``: centred coordinates on the first k principal axes.

    The sign of an axis is such that its largest loading is positive.
    """
    rows = vectors.select(array_to_vector(column).alias("_v"))
    mean = rows.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray()
    axes = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(k)])
    centred = F.zip_with(F.col(column), F.lit(mean.tolist()), lambda x, m: x - m)
    return vectors.withColumn("components", F.array(*[dot(centred, F.lit(axes[:, j].tolist())) for j in range(k)]))
