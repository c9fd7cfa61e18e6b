import numpy as np
import pytest
from pyspark.sql import functions as F

from notemill.operators import evaluate as E
from notemill.operators import model as M
from notemill.operators import parts as P
from notemill.operators import ranking as R
from notemill.operators import salient as S
from notemill.operators import stats as X
from notemill.operators.current import current_rows
from notemill.operators.indexing import dense_index, rank_within
from notemill.operators.judge import judge
from notemill.operators.skew import join_key_stats, lookup
from notemill.plans import catalogue
from notemill.plans.catalogue import REPORTED, REPORTED_PARTS


def test_current_rows(spark):
    rows = [(1, "a", 1, "x"), (1, "b", 2, "x"), (1, "b", 2, "x"), (2, None, None, "y"), (None, "z", 9, "z")]
    df = spark.createDataFrame(rows, "k long, v string, t long, extra string")
    got = {r["k"]: r["v"] for r in current_rows(df, ["k"], "t", ["v"]).collect()}
    assert got == {1: "b", 2: None}
    assert current_rows(df.limit(0), ["k"], "t", ["v"]).count() == 0


def test_dense_index(spark):
    df = spark.createDataFrame([(x,) for x in "hello world of rows"], "c string")
    got = dense_index(df, ["c"], "i").orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(19)) and [r["c"] for r in got] == sorted("hello world of rows")


def test_rank_within(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 3), ("b", 1), (None, 9)], "k string, v long")
    got = {(r["k"], r["v"]): r["n"] for r in rank_within(df, "k", ["v"], "n").collect()}
    assert got == {("a", i): i for i in range(50)} | {("b", 1): 0, ("b", 3): 1, (None, 9): 0}


def test_hot_joins(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, v long")
    stats = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    joined = join_key_stats(rows, stats, ["k"], "n", hot=4)
    assert joined.count() == 350 and joined.where("k = 'hot' and n = 300").count() == 300
    table = spark.createDataFrame([("hot", "h"), ("k1", "one")], "k string, w string")
    found = lookup(rows, table, "k", hot=4)
    assert found.count() == 351 and found.where("w = 'h'").count() == 300 and found.where("w = 'one'").count() == 1


def test_render_and_read_parts(spark):
    cells = spark.createDataFrame([("n", 0, "markdown", "# T"), ("n", 1, "code", "x = 1  # one"), ("n", 2, "raw", "r"), ("n", 3, "code", None)], "path string, pos int, cell_type string, source string")
    got = {r["part"]: r["text"] for r in P.render_parts(cells).collect()}
    assert got["code"] == "\nContent of code cell #1:x = 1  # one\nContent of code cell #2:"
    assert got["narrative"].startswith("Markdown Narrative from: n\n" + "=" * 50 + "\n\nMarkdown Cell #1:\n# T\n\n" + "-" * 30)
    code = spark.createDataFrame([(1, got["code"]), (2, "\nContent of code cell #1:y")], "notebook_id long, code string")
    texts = {r["notebook_id"]: r["text"] for r in P.comment_text(code).collect()}
    assert "Comments from Code Cell #1:\n- one\n" in texts[1] and texts[2].endswith("No comments found in the code.\n")


def test_tfidf_has_unit_length(spark):
    tokens = spark.createDataFrame([(1, "code", t) for t in "aaaa bbbb bbbb cccc".split()] + [(2, "code", t) for t in "bbbb cccc dddd".split()] + [(3, "code", "eeee")], "notebook_id long, part string, term string")
    counts = S.term_counts(tokens, ["notebook_id", "part"])
    vocabulary = S.tfidf_vocabulary(counts, spark.createDataFrame([(3,)], "n_docs long"))
    weights = S.tfidf(counts, vocabulary, ["notebook_id", "part"])
    assert {r["term"] for r in vocabulary.collect()} == {"bbbb", "cccc"}
    lengths = weights.groupBy("notebook_id").agg(F.sum(F.col("weight") ** 2).alias("l")).collect()
    assert all(r["l"] == pytest.approx(1.0) for r in lengths)


def test_top_terms_break_ties_by_term(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "c", 3)], "d long, term string, n long")
    assert [r["term"] for r in S.top_terms(df, ["d"], "n", 2).orderBy("rank").collect()] == ["c", "a"]


def test_lda_is_a_distribution():
    counts = np.array([[5, 4, 0, 0], [0, 0, 6, 5], [4, 5, 0, 1]], float)
    doc_topic, topic_term = S.fit_lda(counts, 2)
    assert doc_topic.sum(axis=1) == pytest.approx(np.ones(3)) and topic_term.sum(axis=1) == pytest.approx(np.ones(2))
    assert doc_topic[0].argmax() == doc_topic[2].argmax() != doc_topic[1].argmax()
    again = S.fit_lda(counts, 2)
    assert np.array_equal(doc_topic, again[0])


def test_topic_models_of_many_notebooks_are_those_of_each_alone(spark):
    rng = np.random.default_rng(1)
    tables = [rng.poisson(1.0, (3, n)).astype(float) + (np.arange(3)[:, None] == np.arange(n) % 3) for n in (17, 20, 31, 32, 32)]
    padded = np.zeros((5, 3, 32))
    for k, t in enumerate(tables):
        padded[k, :, : t.shape[1]] = t
    doc_topic, topic_term = S.fit_ldas(padded, np.array([t.shape[1] for t in tables]), 4)
    for k, t in enumerate(tables):
        alone = S.fit_lda(t, 4)
        assert np.array_equal(doc_topic[k], alone[0]) and np.array_equal(topic_term[k, :, : t.shape[1]], alone[1])
    # digamma is -0.5772.. at 1, trigamma pi^2 / 6
    assert S._digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-9) and S._trigamma(np.array([1.0]))[0] == pytest.approx(np.pi**2 / 6, abs=1e-9)


def test_terms_of_whole_notebooks_by_topic_models(spark):
    rows = [(k, part, f"w{j:02d}", 1 + (j * k + len(part)) % 5) for k in range(1, 6) for part in ("code", "comment") for j in range(8 + 6 * k)]
    counts = spark.createDataFrame(rows, "notebook_id long, part string, term string, n long")
    lists = S.lda_combined_lists(counts)
    # no call for each notebook, and the best terms are found without a further shuffle
    best = S.top_of_lists(lists, ["notebook_id"], 6, 5)
    assert "FlatMapGroupsInPandas" not in best._jdf.queryExecution().toString() and "Window" not in best._jdf.queryExecution().toString()
    got = {(r["notebook_id"], r["rank"]): (r["term"], r["score"]) for r in best.collect()}
    assert len(got) == 25 and got == {(r["notebook_id"], r["rank"]): (r["term"], r["score"]) for r in S.top_terms(S.lda_combined(counts).withColumn("score", F.round("score", 6)), ["notebook_id"], "score", 5).collect()}
    for k in (1, 5):
        total = {}
        for i, _, term, n in rows:
            total[term] = total.get(term, 0) + n if i == k else total.get(term, 0)
        own = np.array([total[w] for w in sorted(total) if total[w]], float)
        share = S.fit_lda(own[None, :], min(5, max(1, len(own) // 10)))[1].max(axis=0)
        assert got[k, 1][1] == pytest.approx(share.max(), abs=1e-6)


def test_terms_of_parts_by_topic_models(spark):
    rows = [(k, part, f"w{j:02d}", 1 + (j * k + len(part)) % 5) for k in (1, 2) for part in ("narrative", "code") for j in range(12 * k)]
    counts = spark.createDataFrame(rows, "notebook_id long, part string, term string, n long")
    best = S.top_of_lists(S.lda_term_lists(counts), ["notebook_id", "part"], 6)
    assert "FlatMapGroupsInPandas" not in best._jdf.queryExecution().toString()
    got = {(r["notebook_id"], r["part"], r["term"]): r["score"] for r in best.collect()}
    expected = {}
    for k in (1, 2):
        table = np.array([[n for i, p, _, n in rows if (i, p) == (k, part)] for part in ("code", "narrative")], float)
        doc_topic, topic_term = S.fit_lda(table, min(10, 12 * k // 5))
        for part, own in zip(("code", "narrative"), doc_topic, strict=True):
            for t in np.flatnonzero(own > 0.05):
                for w in np.argsort(-topic_term[t], kind="stable")[:20]:
                    expected[k, part, f"w{w:02d}"] = expected.get((k, part, f"w{w:02d}"), 0.0) + own[t] * topic_term[t, w]
    assert got.keys() == expected.keys() and all(got[x] == pytest.approx(expected[x], abs=1e-6) for x in got)


def test_domains_are_ranked(spark):
    terms = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 0.0])], "g long, vec array<double>")
    domains = spark.createDataFrame([("x", [2.0, 0.0]), ("y", [-1.0, 0.0]), ("zero", [0.0, 0.0])], "domain string, vec array<double>")
    got = R.rank_domains(terms, domains, ["g"]).orderBy("rank").collect()
    # a negative cosine counts as 0 and its domain still appears; zero vectors never count
    assert [(r["g"], r["domain"], r["score"]) for r in got] == [(1, "x", 1.0), (1, "y", 0.0)]
    assert R.top_lists(R.rank_domains(terms, domains, ["g"]), ["g"]).first()["top_domains"] == ["x", "y"]


def test_terms_of_several_words(spark):
    words = spark.createDataFrame([("big", [2.0, 0.0]), ("data", [0.0, 2.0])], "word string, vec array<double>")
    got = {r["term"]: r["vec"] for r in R.embed_terms(spark.createDataFrame([("Big data",), ("nothing",)], "term string"), words).collect()}
    assert got == {"Big data": [1.0, 1.0], "nothing": None}


def test_variations_leave_holes_and_pad(spark):
    rows = [("n", "all combined", "bow", "bert", ["a"]), ("n", "all combined", "bow", "glove", []), ("n", "all combined", "lda", "bert", ["c"])]
    df = spark.createDataFrame(rows, "notebook string, part string, term_type string, embedding_type string, top_domains array<string>")
    got = {r["variation_idx"]: (r["domain"], r["term_type"]) for r in E.variations(df).collect()}
    assert 1 not in got and got[0] == ("a", "bow") and got[3] == ("a", "padded_3") and len(got) == 8


def test_combined_or_all(spark):
    df = spark.createDataFrame([("code",), ("all combined",)], "part string")
    assert E.combined_or_all(df).count() == 1
    assert E.combined_or_all(df.where("part = 'code'")).count() == 1
    assert E.combined_or_all(df.limit(0)).count() == 0


def test_rollups_skip_nulls(spark):
    df = spark.createDataFrame([("code", "bow", "bert", 1.0), ("code", "bow", "glove", None)], "part string, term_type string, embedding_type string, p_at_k double")
    got = {(r["part"], r["term_type"], r["embedding_type"]): (r["mean_p_at_k"], r["n"]) for r in E.rollups(df).collect()}
    assert got[("code", "all", "all")] == (1.0, 1) and got[("all", "all", "glove")] == (None, 0) and len(got) == 8


def reported(spark):
    return spark.createDataFrame(REPORTED, "kind string, " + ", ".join(f"{c} double" for c in REPORTED_PARTS))


def test_paired_tests_match_reported_values(spark):
    got = {(r["first"], r["second"]): r for r in X.paired_tests(reported(spark), REPORTED_PARTS).collect()}
    assert got["all_contents", "in_line_comment"]["t"] == pytest.approx(0.7833, abs=1e-4)
    assert got["all_contents", "in_line_comment"]["p"] == pytest.approx(0.4560, abs=1e-4)
    assert got["in_line_comment", "markdown_narrative"]["p"] == pytest.approx(0.6367, abs=1e-4)


def test_welch_tests_match_reported_values(spark):
    long = X.unpivot(reported(spark).withColumn("e", F.split("kind", "-")[0]), ["e"], REPORTED_PARTS)
    got = {(r["first"], r["second"]): r for r in X.welch_tests(long, "e", "value").collect()}
    row = got["BERT", "Word2Vec"]
    assert (row["t"], row["df"], row["p"]) == (pytest.approx(8.9221, abs=1e-4), pytest.approx(20.0603, abs=1e-4), pytest.approx(2.02441e-8, rel=1e-4))


def test_t_distribution():
    assert X.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert X.t_two_sided(0.0, 5) == pytest.approx(1.0) and X.t_two_sided(None, 5) is None


def test_outliers_are_dropped_in_sequence(spark):
    df = spark.createDataFrame([(i, float(i % 5), float(i)) for i in range(20)] + [(99, 100.0, 5.0), (98, 2.0, 500.0)], "id long, a double, b double")
    assert {r["id"] for r in X.drop_outliers(df, ["a", "b"]).collect()} == set(range(20))


def test_standardize_constant_column(spark):
    df = spark.createDataFrame([(1, 5.0, 7.0), (2, 7.0, 7.0)], "id long, a double, b double")
    got = {r["id"]: (r["a"], r["b"]) for r in X.standardized(df, ["a", "b"]).collect()}
    assert got == {1: (-1.0, 0.0), 2: (1.0, 0.0)}


def test_sample_size():
    assert X.sample_size(37764) == 3738


def test_correlated_features(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=60)
    rows = [(float(b), float(b * 2 + e), float(o), 1.0) for b, e, o in zip(base, rng.normal(size=60) * 0.01, rng.normal(size=60), strict=True)]
    df = spark.createDataFrame(rows, "num_lines double, op_add double, narrative_size double, op_dot double")
    assert M.uncorrelated(df, df.columns) == ["op_add", "narrative_size", "op_dot"]
    vif = M.inflation(df, df.columns)
    assert vif["num_lines"] > 100 and vif["narrative_size"] == pytest.approx(1.0, abs=0.2) and "op_dot" not in vif
    double = df.withColumn("twin", F.col("num_lines"))
    assert M.inflation(double, ["num_lines", "twin"])["twin"] == float("inf")


def test_split_is_stratified(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(40)], "id long, y string")
    got = {r["y"]: (r["n"], r["t"]) for r in M.stratified_split(df, "y", "id").groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert got == {"a": (30, 8), "b": (10, 3)}


def test_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, p string")
    got = {r["class"]: r for r in M.classification_report(df, "t", "p").collect()}
    assert got["a"]["recall"] == 0.5 and got["c"]["f1"] == 0.0 and got["macro"]["recall"] == pytest.approx(0.5)


def test_models_separate_classes(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.normal(3 * k)), float(rng.normal()), "abc"[k]) for k in range(3) for _ in range(40)]
    df = spark.createDataFrame(rows, "x double, z double, y string")
    model, classes = M.fit_multinomial(df, ["x", "z"], "y", iterations=30)
    report = {r["class"]: r["recall"] for r in M.classification_report(M.predict(model, classes, ["x", "z"], df), "y", "predicted").collect()}
    assert report["macro"] > 0.85
    assert M.coefficients(model, classes, ["x", "z"], df).count() == 9
    tests = {(r["class"], r["feature"]): r for r in M.permutation_test(df, ["x", "z"], "y", ["c"], permutations=60).collect()}
    assert tests["c", "x"]["is_significant"] and tests["c", "x"]["coefficient"] > 0
    assert 0 <= tests["c", "z"]["p_value"] <= 1


def test_permutation_test_of_larger_tables_gives_the_same(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.normal(k == 2)), float(rng.normal()), "abc"[k]) for k in range(3) for _ in range(30)] + [(None, 1.0, "a")]
    df = spark.createDataFrame(rows, "x double, z double, y string")
    small, large = ({(r["class"], r["feature"]): r for r in M.permutation_test(df, ["x", "z"], "y", ["c"], permutations=5, max_rows=n).collect()} for n in (1000, 10))
    assert len(small) == 3 and small.keys() == large.keys()
    for k, r in small.items():
        assert list(large[k])[2:7] == pytest.approx(list(r)[2:7], abs=1e-6)
    assert sorted(M.shuffled(np.arange(91), 91, 4)) == list(range(91)) and list(M.shuffled(np.arange(91), 91, 4)) != list(M.shuffled(np.arange(91), 91, 5))


def test_models_of_permuted_labels_need_sums_of_their_rows_alone():
    rng = np.random.default_rng(5)
    x = np.column_stack([np.ones(400), rng.normal(size=(400, 2)), rng.random((400, 1)) < 0.1])
    bounds, ids = np.array([0, 5, 150, 400]), np.arange(400)
    targets, places = M._targets(ids, x, 400, [-1, 0, 1], bounds), M.shuffled(ids, 400, 1)
    for k in range(3):
        assert targets[0, k] == pytest.approx(x[bounds[k] : bounds[k + 1]].sum(axis=0))
        assert targets[2, k] == pytest.approx(x[(places >= bounds[k]) & (places < bounds[k + 1])].sum(axis=0))
    flat, counts = targets[1:].reshape(-1, 4).T, np.tile(np.diff(bounds), 2)
    w = M._fit_null(lambda at: M._gradients(x, at), lambda at: M._sums(x, at), M._cubes(x), flat, counts, 1.0)
    # at the minimum the pull of the penalty makes up for what rows and labels differ by
    assert np.abs(x.T @ (1 / (1 + np.exp(-x @ w))) - flat + w).max() < 1e-6
    assert w == pytest.approx(M._fit_binary(lambda at: M._sums(x, at), flat, M._start(counts, 400, 4), 1.0, False), abs=1e-7)


def test_permutation_query_does_every_class(spark, monkeypatch):
    folder, seen = "/root/testdata/sf0.01", {}
    monkeypatch.setattr(M, "permutation_test", lambda table, columns, label, classes, permutations=1000: seen.update(n=table.count(), columns=columns, classes=classes, permutations=permutations))
    catalogue.q_permutation(spark, folder)
    split = catalogue.q_split(spark, folder).collect()
    assert seen["classes"] == sorted(r["domain"] for r in split) and len(split) > 5 and seen["permutations"] == 1000
    assert len(seen["columns"]) == 29 and seen["n"] == sum(r["n"] - r["n_test"] for r in split)


def test_judge_uses_the_scorer_and_survives_failures(spark):
    def scorer(text):
        if "bad" in text:
            raise ValueError
        return " highly \n relevant "

    rows = spark.createDataFrame([("music", "x = 1", None), ("bad", None, "text")], "domain string, code string, narrative string")
    got = {r["domain"]: r["answer"] for r in judge(rows, scorer, tasks=2).collect()}
    assert got == {"music": "highly relevant", "bad": None}


def test_heavy_keys_are_found_while_a_table_is_written(spark):
    from notemill.operators.skew import bounded, join_heavy
    from notemill.session import materialize

    df = spark.createDataFrame([("hub", i) for i in range(900)] + [(f"k{i}", i) for i in range(3000)] + [(None, 1)], "k string, v long")
    table = materialize(df, ("k",), hot=16, n=F.count("k"))
    assert table.heavy == {"k": ["hub"]} and table.counts == {"n": 3900}
    stats = table.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    joined = join_heavy(table, stats, ["k"], "k", table.heavy["k"])
    assert joined.count() == 3900 and joined.where("k = 'hub'").first()["n"] == 900
    assert join_heavy(table.limit(0), stats, ["k"], "k", []).count() == 0
    with pytest.raises(ValueError, match="keys"):
        bounded(stats, 10, "keys")


def test_encoded_terms(spark):
    def encoder(texts):
        if "bad" in texts:
            raise ValueError("no")
        return np.array([[len(t), 1.0, float("nan")] for t in texts])

    df = spark.createDataFrame([("one",), ("one",), ("bad",), ("three",), (None,)], "term string").repartition(1)
    got = {r["term"]: r["vec"] for r in R.encode_terms(df, encoder, 3).collect()}
    assert got == {"one": [3.0, 1.0, 0.0], "bad": [0.0, 0.0, 0.0], "three": [5.0, 1.0, 0.0]}
    assert R.encode_terms(df.limit(0), encoder, 3).count() == 0


def test_domains_of_terms(spark):
    words = spark.createDataFrame([("deep", [1.0, 0.0]), ("learning", [0.0, 1.0]), ("law", [-1.0, 0.0]), ("nil", [0.0, 0.0])], "word string, vec array<double>")
    terms = spark.createDataFrame([(1, "deep"), (1, "deep"), (1, "unknown"), (2, "law"), (2, "nil"), (3, "unknown"), (None, "deep")], "id long, term string")
    labels = spark.createDataFrame([("Deep learning",), ("law",), ("nowhere",), ("nil",)], "domain string")
    got = {(r["id"], r["domain"]): (round(r["score"], 6), r["rank"]) for r in R.domains_of_terms(terms, labels, words, ["id"]).collect()}
    assert got[1, "Deep learning"] == (1.414214, 1) and got[1, "law"] == (0.0, 2) and got[2, "law"] == (1.0, 1) and got[None, "Deep learning"] == (0.707107, 1)
    assert {d for _, d in got} == {"Deep learning", "law"} and 3 not in {i for i, _ in got}
    assert R.domains_of_terms(terms, labels.limit(0), words, ["id"]).count() == 0
    with pytest.raises(ValueError, match="domains"):
        R.rank_domains(terms.select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("vec")), words.toDF("domain", "vec"), ["id"], max_domains=2)


def test_tables_of_coefficients(spark):
    from notemill.operators import importance as I

    rows = [("a", "x", 0.5, True), ("a", "y", -0.9, True), ("a", "z", 0.5, True), ("a", "w", 9.0, False), ("a", "intercept", 99.0, True), ("b", "x", 0.1, True)]
    stats = spark.createDataFrame(rows, "class string, feature string, coefficient double, is_significant boolean")
    assert [(r["class"], r["feature"], r["rank"]) for r in I.strongest(stats, 2).orderBy("class", "rank").collect()] == [("a", "y", 1), ("a", "x", 2), ("b", "x", 1)]
    assert [tuple(r) for r in I.busiest(stats, 1).collect()] == [("a", 3)]
    assert [tuple(r) for r in I.pivot_first(stats, ["a", "b"]).collect()] == [("x", 0.5, 0.1), ("y", -0.9, None), ("z", 0.5, None)]
    assert [tuple(r) for r in I.pivot_first(stats, ["b"], ["x", "q"]).collect()] == [("x", 0.1)] and I.pivot_first(stats.limit(0), ["a"]).count() == 0
    shown = spark.range(1).select(I.mean_and_deviation(F.lit(1.23456), F.lit(0.5), 3).alias("m"), I.mean_and_deviation(F.lit(2.0), F.lit(None).cast("double"), 1).alias("s")).first()
    assert tuple(shown) == ("1.235 ± 0.500", "2.0")


def test_selection_drops_pairs_then_inflated_columns(spark):
    rng = np.random.default_rng(1)
    a, b, c = rng.normal(size=(3, 400))
    rows = np.column_stack([a, a + 0.01 * rng.normal(size=400), b, c, b + c + 0.1 * rng.normal(size=400), np.ones(400)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "num_lines double, op_add double, op_dot double, op_conv double, op_pool double, op_split double")
    states = {f: s for f, s, _ in M.selection(df, df.columns)}
    assert states == {"num_lines": "correlated", "op_add": "kept", "op_dot": "inflated", "op_conv": "inflated", "op_pool": "inflated", "op_split": "kept"}
    factors = [v for _, _, v in M.selection(df, df.columns) if v is not None]
    assert factors == sorted(factors, reverse=True) and M.selected(df, df.columns) == ["op_add", "op_split"]


def test_special_tags_hold_for_all(spark):
    predictions = spark.createDataFrame([("n1", "code", "bow", "bert", ["a", "b", "c"]), ("n2", "code", "bow", "bert", ["x"])], "notebook string, part string, term_type string, embedding_type string, top_domains array<string>")
    tags = spark.createDataFrame([("n1", ["q", "r", "s"]), ("special_tags", ["a", "b", "z"])], "notebook string, tags array<string>")
    got = {r["notebook"]: r["p_at_k"] for r in E.evaluated(predictions, tags).collect()}
    assert got == {"n1": pytest.approx(2 / 3), "n2": 0.0}
    assert {r["notebook"]: r["p_at_k"] for r in E.evaluated(predictions, tags.where("notebook = 'n1'")).collect()} == {"n1": 0.0, "n2": None}
    meta = spark.createDataFrame([("a/n", ["X", "y"], 1), ("b/n", ["y", "z"], 1)], "kernel_ref string, keywords array<string>, scraped_at long")
    assert [tuple(r) for r in E.tags_of(meta).collect()] == [("n", ["x", "y", "z"])]


def test_welch_within_keys(spark):
    df = spark.createDataFrame([(p, g, float(v)) for p in "pq" for g in "ab" for v in (1, 2, 4 + (g == "b"))] + [("p", None, 1.0), ("p", "a", None)], "part string, g string, v double")
    got = X.welch_tests(df, "g", "v", ["part"]).collect()
    assert sorted((r["part"], r["first"], r["second"]) for r in got) == [("p", "a", "b"), ("q", "a", "b")]
    with pytest.raises(ValueError, match="groups"):
        X.welch_tests(df, "g", "v", ["part"], max_groups=3)


def test_lemmas(spark):
    terms = spark.createDataFrame([(t,) for t in ("training", "train", "trained", "makes", "make", "tries", "try", "class", "clas", "bus", None)], "term string")
    got = {r["term"]: r["lemma"] for r in S.lemma_table(terms, terms.withColumnRenamed("term", "word")).collect()}
    assert got == {"training": "train", "trained": "train", "makes": "make", "tries": "try", "class": "clas"}
    assert S.lemma_table(terms.limit(0), terms.withColumnRenamed("term", "word")).count() == 0
    counts = spark.createDataFrame([("have", 1), ("a", 1), ("model", 2)], "term string, n long")
    assert [r["term"] for r in S.retokenised(counts, ["have"]).collect()] == ["model"]


def test_priors_move_towards_what_is_observed():
    rng = np.random.default_rng(3)
    true = np.array([1.5, 2.0, 6.0])
    prior = np.ones(3)
    observed = rng.dirichlet(true, 4000) * 1e9
    for _ in range(40):
        prior = S._newton_prior(prior, observed)
    assert np.allclose(prior, true, rtol=0.1)
    assert np.allclose(S._trigamma(np.array([0.3, 1.0, 8.0])), [12.2454, 1.644934, 0.133137], rtol=1e-4)


def test_judging_in_chunks_goes_on(spark, tmp_path):
    from notemill.operators.judge import judge_in_chunks

    asked, path = tmp_path / "asked", str(tmp_path / "answers")
    asked.mkdir()
    folder = str(asked)

    def scorer(text):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w"):
            pass
        return "relevant"

    rows = spark.createDataFrame([(i, "law", "x = 1", f"note {i}") for i in range(25)], "id long, domain string, code string, narrative string")
    assert judge_in_chunks(rows.where("id < 20"), ["id"], scorer, path, size=10).count() == 20
    got = judge_in_chunks(rows, ["id"], scorer, path, size=10).collect()
    assert len(got) == 25 and {r["answer"] for r in got} == {"relevant"} and sorted({r["chunk"] for r in got}) == [0, 1, 2] and len(list(asked.iterdir())) == 25
    assert judge_in_chunks(rows.limit(0), ["id"], scorer, str(tmp_path / "none")).count() == 0
