import importlib

import __spark_entry__ as entry


def test_entry_runs(spark, data):
    rows = entry.entry(spark).collect()
    assert rows and rows[0]["part"] is not None


def test_every_query_has_sql_or_a_reason():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    core = {n for n in names if n.startswith("q_")}
    without = core - set(entry.oracle_sql())
    assert without == {"q_lda_terms", "q_lda_combined", "q_tensor_ops_ast", "q_pca", "q_uncorrelated", "q_feature_selection", "q_welch_p", "q_logreg", "q_permutation"}


def test_modules_import():
    for name in ("operators.judge", "sources.pages", "streaming.download", "plans.oracle"):
        importlib.import_module(f"notemill.{name}")
