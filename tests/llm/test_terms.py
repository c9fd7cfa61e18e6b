import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from notemill.llm import distinctive, frequency
from notemill.llm.terms import keyword_array, term_array

SCHEMA = "field_name string, terms array<string>, extra string"


def test_terms_and_keywords(spark):
    df = spark.createDataFrame([("2nd x_1 été _a9 数据 #5:import", ["A  b", "a_B", "\u00a0C-d ", None, "--", ""])], "t string, k array<string>")
    row = df.select(term_array(F.col("t")).alias("t"), keyword_array(F.col("k")).alias("k")).first()
    assert row["t"] == ["x_1", "été", "_a9", "数据", "import"] and row["k"] == ["a b", "a b", "c d"]


def test_frequencies_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [("f" if rng.random() < 0.8 else "g", [rng.choice(["hot", "hot", *map(str, range(40))]) for _ in range(rng.randrange(6))], "x") for _ in range(300)]
    rows += [("f", None, "x"), ("f", [None, "hot"], "x"), ("f", [], "x")]
    occ, rec, holders = Counter(), Counter(), Counter()
    for f, terms, _ in rows:
        own = [t for t in terms or [] if t is not None]
        holders[f] += bool(own)
        for t in own:
            occ[f, t] += 1
        for t in set(own):
            rec[f, t] += 1
    got = frequency.term_frequencies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["field_name"], r["term"]): (r["n_occurrences"], r["n_records"], r["n_holders"]) for r in got} == {k: (n, rec[k], holders[k[0]]) for k, n in occ.items()}
    for r in got:
        rare, common = r["n_records"] < 3, r["n_records"] > 0.2 * r["n_holders"]
        assert r["mark"] in ({"rare"} if rare else set()) | ({"common"} if common else set()) or (r["mark"] is None and not rare and not common)
    ids = {(r["field_name"], r["term"]): r["term_id"] for r in got}
    assert sorted(ids.values()) == list(range(len(ids)))


def test_term_that_is_rare_and_common_has_both_marks(spark):
    got = frequency.term_frequencies(spark.createDataFrame([("f", ["a"], "")], SCHEMA)).collect()
    assert {r["mark"] for r in got} == {"rare", "common"}


def test_frequencies_of_nothing(spark):
    assert frequency.term_frequencies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_residuals_equal_brute_force(spark):
    rows = [(i, "code", ["a"] * (i % 4) + ["b", f"t{i % 7}"] * 2, i) for i in range(40)] + [(99, "code", [], 0), (98, "code", None, 0)]
    got = distinctive.distinctive_terms(spark.createDataFrame(rows, "notebook_id long, field_name string, terms array<string>, n_here long")).collect()
    cells, cols, rws = Counter(), Counter(), Counter()
    holders = defaultdict(set)
    for i, _, terms, _ in rows:
        for t in terms or []:
            cells[i, t] += 1
            cols[t] += 1
            rws[i] += 1
            holders[t].add(i)
    grand = sum(cells.values())
    assert len(got) == len(cells)
    for r in got:
        n, e = cells[r["notebook_id"], r["term"]], rws[r["notebook_id"]] * cols[r["term"]] / grand
        assert (r["n_here"], r["n_records"], r["n_total"]) == (n, len(holders[r["term"]]), cols[r["term"]])
        z = (n - e) / math.sqrt(e)
        assert r["residual"] == pytest.approx(z)
        assert r["adjusted"] == pytest.approx(z / math.sqrt((1 - rws[r["notebook_id"]] / grand) * (1 - cols[r["term"]] / grand)))


def test_one_record_is_never_distinctive(spark):
    df = spark.createDataFrame([(1, "code", ["a"])], "notebook_id long, field_name string, terms array<string>")
    assert distinctive.distinctive_terms(df).first()["adjusted"] == 0.0
    assert distinctive.distinctive_terms(df.limit(0)).count() == 0


def test_found_queries_equal_brute_force(spark, data):
    import duckdb

    from notemill.llm import queries

    rows = duckdb.sql(f"select notebook_id, arg_max({{'c': code}}, scraped_at).c from '{data}/nb_contents.parquet' group by 1").fetchall()
    terms = {i: Counter(m for m in re.findall(r"\w+", c.lower()) if not m[0].isdecimal()) for i, c in rows if c is not None}
    df = Counter(t for own in terms.values() for t in own)
    want = {(i, t) for i, own in terms.items() for t, n in own.items() if n >= 4 and 2 <= df[t] <= 5}
    got = {(r["notebook_id"], r["term"]) for r in queries.p5_found(spark, data).where("field_name = 'code'").collect()}
    assert got == want


def test_found_query_scores_every_term(spark, data, monkeypatch):
    from notemill.llm import queries

    scored = spark.sparkContext.accumulator(0)
    whole = distinctive.distinctive_terms

    def counted(records):
        @F.udf("double")
        def note(score):
            scored.add(1)
            return score

        return whole(records).withColumn("adjusted", note("adjusted"))

    n_cells = queries.p5_distinctive(spark, data).count()
    monkeypatch.setattr(distinctive, "distinctive_terms", counted)
    assert 0 < queries.p5_found(spark, data).count() < n_cells
    assert scored.value == n_cells


def test_terms_without_a_finite_score_are_refused(spark):
    scores = spark.createDataFrame([("a", 4, 1.0), ("b", 1, -2.0)], "term string, n_here long, adjusted double")
    assert [r["term"] for r in distinctive.among_scored(scores, "n_here >= 4").collect()] == ["a"]
    for bad in (None, math.nan, math.inf, -math.inf):
        # the term that is not kept counts too
        with pytest.raises(ValueError, match="1 terms"):
            distinctive.among_scored(scores.withColumn("adjusted", F.when(F.col("term") == "b", F.lit(bad).cast("double")).otherwise(F.col("adjusted"))), "n_here >= 4")
