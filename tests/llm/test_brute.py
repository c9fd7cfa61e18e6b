"""Found queries against plain Python on whole small tables."""

import re

import duckdb
import pytest

from notemill.llm import queries


def rows(folder, sql):
    return duckdb.sql(sql.replace("@", folder + "/")).fetchall()


def test_p4_found(spark, data):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        parent[find(a)] = find(b)

    kernels = rows(data, "select kernel_ref, author, forked_from, slug from '@kernels.parquet'")
    slugs = {}
    for ref, author, fork, slug in kernels:
        account = ref.split("/")[0]
        join(("ref", ref), ("account", account))
        slugs.setdefault(slug, ref)
        name = " ".join((author or "").lower().split())
        if "," in name:
            last, first = (x.strip() for x in name.split(","))
            name = f"{first} {last}"
        if name not in ("", "none"):
            join(("ref", ref), ("person", name))
        if fork:
            join(("ref", ref), ("ref", fork.strip(" /").lower()))
    first = {}
    for ref, *_ in kernels:
        root = find(("ref", ref))
        first[root] = min(first.get(root, "~"), ref.split("/")[0])
    want = set()
    for (name,) in rows(data, "select distinct notebook from '@domain_classification_results.parquet' where notebook is not null"):
        slug = re.sub(r"_var\d+$", "", re.sub(r"\.ipynb$", "", name.strip().lower().rsplit("/", 1)[-1]))
        want.add((name, first[find(("ref", slugs[slug]))]))
    assert {tuple(r) for r in queries.p4_found(spark, data).collect()} == want


def test_p4_splits_keep_groups_together(spark, data):
    got = queries.p4_splits(spark, data).collect()
    by = {}
    for r in got:
        by.setdefault(r["group_key"], set()).add(r["split"])
    assert all(len(v) == 1 and None not in v for v in by.values())
    total = sum(r["n_rows"] for r in got)
    for split, share in queries.SHARES.items():
        assert sum(r["n_rows"] for r in got if r["split"] == split) / total == pytest.approx(share, abs=0.02)


def test_p1_keywords(spark, data):
    tags = rows(data, "select kernel_ref, arg_max({'k': keywords}, scraped_at).k from '@kernel_metadata.parquet' group by 1")
    records = {ref: {re.sub(r"[\s_-]+", " ", k.lower()).strip() for k in own or [] if k is not None} - {""} for ref, own in tags}
    holders = sum(map(bool, records.values()))
    n = {}
    for own in records.values():
        for t in own:
            n[t] = n.get(t, 0) + 1
    want = {(t, "rare") for t, c in n.items() if c < 3} | {(t, "common") for t, c in n.items() if c > 0.2 * holders}
    assert {(r["term"], r["mark"]) for r in queries.p1_found(spark, data).where("field_name = 'keywords'").collect()} == want


def test_p8_report(spark, data):
    report = queries.p8_report(spark, data).collect()
    assert len(report) == 9
    for r in report:
        if r["fate"] != "short":
            assert r["used_tokens"] == pytest.approx(r["quota"], rel=0.15)
        if r["fate"] == "sample":
            assert r["most_uses"] == 1
