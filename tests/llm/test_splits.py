import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from notemill.llm import splits


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute(edges):
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = sorted((find(parent, a), find(parent, b)))
        parent[b] = a
    return {x: find(parent, x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(120):03}", f"n{rng.randrange(120):03}") for _ in range(80)]
    edges += [("hub", f"leaf{i:03}") for i in range(150)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(30)] + [("self", "self")]
    df = spark.createDataFrame([(*e, 1) for e in edges] + [(None, "x", 1), ("x", None, 1)], "src string, dst string, root int")
    got = {r["node"]: r["root"] for r in splits.components(df).collect()}
    assert got == brute(edges)


def test_components_of_nothing(spark):
    assert splits.components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_names(spark):
    df = spark.createDataFrame([("Doe,  Jane ", " /A/B-c/ ", "data/u/X-y/X-y.IPYNB\n"), (" None", None, "x-y_var3"), ("JANE doe", "a", None)], "author string, ref string, nb string")
    got = df.select(splits.person_key(F.col("author")).alias("p"), splits.ref_key(F.col("ref")).alias("r"), splits.notebook_key(F.col("nb")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("jane doe", "a/b-c", "x-y"), (None, None, "x-y"), ("jane doe", None, None)]


def test_groups(spark):
    rows = [("b/one", "Jane Doe", None), ("a/two", "Doe, Jane", None), ("c/three", "", "gone/away"), ("d/four", None, " GONE/AWAY"), ("gone/other", "X Y", None), ("e/five", "Q", "b/one"), (None, "Jane Doe", None), ("b/one", "Jane Doe", None)]
    groups = splits.kernel_groups(spark.createDataFrame(rows, "kernel_ref string, author string, forked_from string"))
    got = {r["kernel_ref"]: r["group_key"] for r in groups.collect()}
    # a kernel that is not here relates its forks, but not its account
    assert got == {"a/two": "a", "b/one": "a", "e/five": "a", "c/three": "c", "d/four": "c", "gone/other": "gone"}
    names = spark.createDataFrame([("ONE.ipynb",), ("one",), ("one",), ("nothing",), (None,)], "notebook string")
    assert {(r["notebook"], r["group_key"]) for r in splits.group_of_notebooks(names, groups).collect()} == {("ONE.ipynb", "a"), ("one", "a")}


@pytest.mark.parametrize("seed", range(4))
def test_deal_is_as_close_as_groups_allow(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 3, 7, 12, 30]) for _ in range(9)]
    plan = splits.deal_sizes(dict(Counter(sizes)), {"train": 0.7, "test": 0.3})
    total = sum(sizes)
    goal = round(total * 0.3)
    best = min(abs(goal - sum(c)) for n in range(len(sizes) + 1) for c in combinations(sizes, n))
    assert abs(goal - sum(s * n for s, n in plan["test"].items())) == best
    assert Counter(plan["train"]) + Counter(plan["test"]) == Counter(sizes)


def test_deal_with_coarse_units():
    plan = splits.deal_sizes({1000: 30, 1: 500, 37: 20}, {"train": 0.8, "validation": 0.1, "test": 0.1}, max_bits=512)
    total = 30000 + 500 + 740
    for s in ("validation", "test"):
        assert abs(sum(k * n for k, n in plan[s].items()) - total * 0.1) < total * 0.01
    assert splits.deal_sizes({}, {"train": 0.9, "test": 0.1}) == {"train": {}, "test": {}}


@pytest.mark.parametrize(("histogram", "bits"), [({2: 5_000_000}, 1 << 22), ({2: 1000, 3: 1001}, 1 << 11), ({3: 500, 5: 400, 1000: 3}, 1 << 10), ({4: 900, 6: 700}, 1 << 11), ({7: 10, 400: 12, 5000: 1}, 1 << 8)])
def test_rounding_of_units_is_made_good(histogram, bits):
    total = sum(s * n for s, n in histogram.items())
    plan = splits.deal_sizes(histogram, {"train": 0.8, "validation": 0.1, "test": 0.1}, max_bits=bits)
    exact = splits.deal_sizes(histogram, {"train": 0.8, "validation": 0.1, "test": 0.1}, max_bits=total) if total < 1 << 20 else None
    for s in ("validation", "test"):
        got = sum(k * n for k, n in plan[s].items())
        assert abs(got - round(total * 0.1)) <= (abs(sum(k * n for k, n in exact[s].items()) - round(total * 0.1)) if exact else 0)
    assert sum((Counter(p) for p in plan.values()), Counter()) == Counter(histogram) and all(n > 0 for p in plan.values() for n in p.values())


def test_groups_stay_together(spark):
    df = spark.createDataFrame([(f"g{i}", 1 + i % 5) for i in range(100)] + [("huge", 150), (None, 5)], "group_key string, n_rows long")
    got = splits.split_groups(df, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(got) == 101 and len({r["group_key"] for r in got}) == 101
    sums = Counter()
    for r in got:
        sums[r["split"]] += r["n_rows"]
    assert sums["test"] == sums["validation"] == 45
    assert splits.split_groups(df.limit(0), {"train": 0.8, "test": 0.2}).count() == 0


def test_kernels_of_one_slug_can_be_one_group(spark):
    kernels = spark.createDataFrame([("b/one", None, None), ("a/one", None, None), ("c/two", None, None)], "kernel_ref string, author string, forked_from string")
    apart, together = (splits.kernel_groups(kernels, by_slug=x) for x in (False, True))
    assert {r["group_key"] for r in apart.collect()} == {"a", "b", "c"}
    assert {r["kernel_ref"]: r["group_key"] for r in together.collect()} == {"a/one": "a", "b/one": "a", "c/two": "c"}
    results = spark.createDataFrame([("one",), ("one",), ("two",)], "notebook string")
    features = spark.createDataFrame([("ONE",), ("two",)], "base_notebook string")
    assert {(r["notebook"], r["group_key"]) for r in splits.related_rows(results, features, together).collect()} == {("one", "a"), ("ONE", "a"), ("two", "c")}


def test_a_star_and_a_path_with_heavy_keys(spark):
    edges = [("hub", f"leaf{i:04}") for i in range(3000)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(90)]
    got = {r["node"]: r["root"] for r in splits.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == brute(edges)
