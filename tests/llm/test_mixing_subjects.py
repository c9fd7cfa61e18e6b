import pytest
from pyspark.sql import functions as F

from notemill.llm import mixing, subjects


def test_flow_is_cheapest():
    #     0 -> 1 (cap 4, cost 1), 0 -> 2 (cap 3, cost 2), both -> 3
    flows = mixing.min_cost_flow(4, [(0, 1, 4, 1), (0, 2, 3, 2), (1, 3, 2, 0), (1, 2, 9, 0), (2, 3, 9, 0)], 0, 3)
    assert sum(flows[:2]) == 7 and flows[0] == 4 and flows[1] == 3


def test_plan():
    supply = {("a",): 100, ("a", "b"): 50, ("b",): 10, ("c",): 5}
    flow = mixing.plan_mix(supply, {"a": 120.0, "b": 60.0, "c": 40.0}, {"a": 3, "b": 2, "c": 4})
    given = {s: sum(f for (_, q), f in flow.items() if q == s) for s in "abc"}
    assert given == {"a": pytest.approx(120), "b": pytest.approx(60), "c": pytest.approx(20)}
    for p, n in supply.items():
        assert sum(f for (q, _), f in flow.items() if q == p) <= n * max({"a": 3, "b": 2, "c": 4}[s] for s in p) + 1e-6
        assert all(f <= n * {"a": 3, "b": 2, "c": 4}[s] + 1e-6 for (q, s), f in flow.items() if q == p)


def documents(spark):
    rows = [(i, f"text number {i} of the forum " * 3, " Forum ") for i in range(300)]
    rows += [(1000 + i, f"a small source {i} here", "small_one") for i in range(20)]
    rows += [(2000 + i, f"text number {i} of the forum " * 3, "small-one") for i in range(5)]
    rows += [(3000, None, "forum"), (3001, "", "forum"), (3002, "no source", None), (3003, "no target at all", "other"), (0, rows[0][1], " Forum ")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix(spark):
    targets = spark.createDataFrame([("forum", 0.5, 2), ("small-one", 0.3, 6), ("empty", 0.1, 2)], "source string, target_share double, max_repeats long")
    mix, plan = mixing.mix_sources(documents(spark), targets)
    fates = {r["source"]: r["fate"] for r in plan.collect()}
    assert fates["forum"] == "sample" and fates["empty"] == "short"
    assert fates["small-one"] in ("repeat", "short")
    uses = mix.groupBy("doc_id").agg(F.sum("n_uses").alias("n"), F.collect_set("source").alias("s")).collect()
    assert max(r["n"] for r in uses) <= 6 and all(r["n"] <= 2 for r in uses if 5 <= r["doc_id"] < 300)
    caps = {"forum": 2, "small-one": 6}
    assert all(r["n_uses"] <= caps[r["source"]] for r in mix.collect())
    report = {r["source"]: r for r in mixing.mix_report(mix, plan).collect()}
    assert report["forum"]["used_tokens"] == pytest.approx(report["forum"]["quota"], rel=0.02)
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1.0)
    again = {tuple(r) for r in mixing.mix_sources(documents(spark), targets)[0].collect()}
    assert again == {tuple(r) for r in mix.collect()}


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("forum", 1.0, 2)], "source string, target_share double, max_repeats long")
    mix, plan = mixing.mix_sources(documents(spark).limit(0), targets)
    assert mix.count() == 0 and plan.first()["fate"] == "short"


def test_token_counts_of_a_public_tokenizer(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, "Größe 数据")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in mixing.count_tokens(df).collect()}
    assert got[1] == 2 and got[2] > 3


def test_subjects_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    nb, labels = spark.read.parquet(f"{folder}/nb_contents.parquet"), spark.read.parquet(f"{folder}/subject_labels.parquet")
    held_out = labels.where("notebook_id % 3 = 0")
    shares = subjects.subject_shares(nb, spark.read.parquet(f"{folder}/domain_classification_results.parquet"), labels.where("notebook_id % 3 <> 0"), spark.read.parquet(f"{folder}/subjects.parquet"))
    got = {(r["notebook_id"], r["subject"]) for r in shares.where(F.col("share") >= subjects.SHARE).collect()}
    want = {(r["notebook_id"], r["subject"]) for r in held_out.collect()}
    ids = {i for i, _ in want}
    found = {x for x in got if x[0] in ids}
    assert len(want) > 20 and len(found & want) / len(want) > 0.9 and len(found - want) / len(want) < 0.1


def test_subjects_without_labels_or_texts(spark):
    nb = spark.createDataFrame([(1, "a", None, 1), (2, "b", "", 1), (3, "c", "The bank lends money to the market every day.", 1)], "notebook_id long, notebook string, markdown_narrative string, scraped_at long")
    predictions = spark.createDataFrame([], "notebook string, top_domains array<string>")
    labels = spark.createDataFrame([], "notebook_id long, subject string")
    names = spark.createDataFrame([("finance", "money")], "subject string, description string")
    assert subjects.subject_shares(nb, predictions, labels, names).count() == 0


def test_fates_follow_from_own_tokens_where_sources_share_texts(spark):
    rows = [(i, f"a shared text with the number {i}", s) for i in range(50) for s in ("a", "b")]
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 1), ("c", 0.1, 1)], "source string, target_share double, max_repeats long")
    mix, plan = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), targets)
    report = {r["source"]: r for r in plan.collect()}
    # each has enough for itself, but no text is used twice, so one of them gets less
    assert {s: r["fate"] for s, r in report.items()} == {"a": "sample", "b": "sample", "c": "short"}
    assert report["a"]["shortfall"] + report["b"]["shortfall"] == pytest.approx(0.2 * 0.5 * sum(r["own_tokens"] for r in report.values() if r["source"] != "c"), rel=0.01)
    assert mix.groupBy("doc_id").agg(F.sum("n_uses").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize(("own", "quota", "cap", "want"), [(10, 10, 1, "sample"), (10, 11, 1, "short"), (10, 30, 3, "repeat"), (10, 31, 3, "short"), (0, 0, 9, "short")])
def test_fate(own, quota, cap, want):
    assert mixing.fate(own, quota, cap) == want
