"""Problem 1: frequency of every distinct value or term.

A global dictionary gives every (field, term) a dense integer.  Blocks of records are encoded
with local dictionaries and counted with array arithmetic (occurrences and record presence);
the block counts are translated to global identifiers and added up in arrays per range of
identifiers.  No step holds more than one block or one identifier range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.terms import current_contents, keyword_array, term_array
from notemill.operators.current import current_rows
from notemill.operators.indexing import dense_index
from notemill.operators.skew import bounded, join_heavy
from notemill.session import materialize

RANGE, MAX_FIELDS = 4096, 10_000
BLOCK_SCHEMA = "field_name string, term string, n_occurrences long, n_records long"
SUM_SCHEMA = "range_id long, occurrences array<long>, records array<long>"


def _count_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of (field_name, terms): occurrences and record presence of each local term."""
    for batch in batches:
        lists, fields = batch.column("terms"), batch.column("field_name")
        parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        if not len(parents):
            continue
        coded = pc.list_flatten(lists).dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for name in pc.unique(fields).to_pylist():
            own = pc.equal(fields, name).to_numpy(zero_copy_only=False)[parents]
            occurrences = np.bincount(codes[own], minlength=len(words))
            once = np.unique(parents[own].astype(np.int64) * len(words) + codes[own]) % len(words)
            records = np.bincount(once, minlength=len(words))
            seen = np.flatnonzero(occurrences)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(seen), pa.string()), words.take(pa.array(seen)), pa.array(occurrences[seen]), pa.array(records[seen])],
                names=["field_name", "term", "n_occurrences", "n_records"],
            )


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add encoded block counts into one pair of arrays per identifier range seen here."""
    sums: dict[int, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        keys = list(sums)
        out = pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([sums[k][0] for k in keys], pa.list_(pa.int64())), pa.array([sums[k][1] for k in keys], pa.list_(pa.int64()))],
            names=["range_id", "occurrences", "records"],
        )
        sums.clear()
        return out

    for batch in batches:
        ids, occ, rec = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("term_id", "n_occurrences", "n_records"))
        of = ids // RANGE
        for r in np.unique(of):
            own = of == r
            both = sums.setdefault(int(r), np.zeros((2, RANGE), np.int64))
            np.add.at(both[0], ids[own] % RANGE, occ[own])
            np.add.at(both[1], ids[own] % RANGE, rec[own])
        if len(sums) >= 256:  # arrays of 16 MB; what is flushed early is added up downstream
            yield flush()
    if sums:
        yield flush()


def term_frequencies(records: DataFrame, min_records: int = 3, max_share: float = 0.2) -> DataFrame:
    """Count every distinct term of ``records`` (field_name string, terms array<string>; one row a record).

    Returns (field_name, term, term_id, n_occurrences, n_records, n_holders, mark): n_holders is
    the number of records of the field that hold any term; mark is ``rare`` if fewer than
    ``min_records`` records hold the term, ``common`` if more than ``max_share`` of n_holders do,
    else null; a term that is both has both marks in two rows.  Null terms and null or empty
    arrays count nothing; other columns are ignored; an empty table gives an empty result.
    A term in every record costs one count per block; terms with a large share of these counts are
    encoded by broadcast.  More than ``MAX_FIELDS`` fields are refused.
    """
    terms = records.select("field_name", F.filter("terms", lambda t: t.isNotNull()).alias("terms")).where("size(terms) > 0")
    blocks = materialize(terms.mapInArrow(_count_block, BLOCK_SCHEMA), ("term",))
    dictionary = dense_index(blocks.select("field_name", "term").distinct(), ["field_name", "term"], "term_id")
    encoded = join_heavy(blocks, dictionary, ["field_name", "term"], "term", blocks.heavy["term"]).select("term_id", "n_occurrences", "n_records")
    # a range of hot terms gets a count from each block: 16 salts share it, then 16 arrays are added
    salted = encoded.repartition(F.expr(f"term_id div {RANGE}"), F.pmod(F.hash("n_occurrences", "n_records"), F.lit(16)))
    partial = salted.mapInArrow(_sum_ranges, SUM_SCHEMA)
    positions = partial.select(
        "range_id", F.posexplode(F.arrays_zip("occurrences", "records")).alias("offset", "both")
    ).where("both.occurrences > 0")
    totals = positions.groupBy((F.col("range_id") * RANGE + F.col("offset")).alias("term_id")).agg(
        F.sum("both.occurrences").alias("n_occurrences"), F.sum("both.records").alias("n_records")
    )
    holders = bounded(terms.groupBy("field_name").agg(F.count("*").alias("n_holders")), MAX_FIELDS, "fields")
    marks = F.array_compact(
        F.array(
            F.when(F.col("n_records") < min_records, "rare"),
            F.when(F.col("n_records") > max_share * F.col("n_holders"), "common"),
        )
    )
    return (
        totals.join(dictionary, "term_id")
        .join(holders, "field_name")
        .select("field_name", "term", "term_id", "n_occurrences", "n_records", "n_holders", F.explode_outer(marks).alias("mark"))
    )


def notebook_records(kernel_metadata: DataFrame, nb_contents: DataFrame) -> DataFrame:
    """The records of problem 1: current keyword lists and current code, as (field_name, terms)."""
    tags = current_rows(kernel_metadata, ["kernel_ref"], "scraped_at", ["keywords"])
    code = current_contents(nb_contents).select("code")
    return tags.select(F.lit("keywords").alias("field_name"), keyword_array(F.col("keywords")).alias("terms")).unionAll(
        code.select(F.lit("code"), term_array(F.col("code")))
    )
