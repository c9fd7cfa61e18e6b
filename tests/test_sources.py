import json

from notemill.operators.evaluate import tags_of
from notemill.sources import notebooks as N
from notemill.sources import pages, tables
from notemill.streaming import budget, download


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_notebooks(spark, tmp_path):
    cells = [{"cell_type": "code", "source": ["a\n", "b"]}, {"cell_type": "markdown", "source": "# T"}]
    write(tmp_path / "data/u/f/n.ipynb", json.dumps({"cells": cells, "nbformat": 4}))
    write(tmp_path / "data/u/g/old.ipynb", json.dumps({"worksheets": []}))
    write(tmp_path / "data/u/f/deep/x.ipynb", "{}")
    books = N.read_notebooks(spark, str(tmp_path / "data"))
    assert {(r["account"], r["folder"], r["stem"]) for r in books.collect()} == {("u", "f", "n"), ("u", "g", "old")}
    got = [(r["pos"], r["cell_type"], r["source"]) for r in N.notebook_cells(books).orderBy("pos").collect()]
    assert got == [(0, "code", "a\nb"), (1, "markdown", "# T")]


def test_metadata(spark, tmp_path):
    write(tmp_path / "d/u/a/kernel-metadata.json", '{"keywords": ["x", "y"]}')
    write(tmp_path / "d/u/b/kernel-metadata.json", "not json")
    write(tmp_path / "d/u/c/kernel-metadata.json", "{}")
    got = {r["notebook"]: r["keywords"] for r in N.read_metadata(spark, str(tmp_path / "d")).collect()}
    assert got == {"a": ["x", "y"], "b": [], "c": []}


def test_part_files(spark, tmp_path):
    write(tmp_path / "nb/one/code.txt", "x\ny")
    write(tmp_path / "nb/one/.hidden.txt", "no")
    assert [(r["notebook"], r["stem"], r["text"]) for r in N.read_part_files(spark, str(tmp_path / "nb")).collect()] == [("one", "code", "x\ny")]


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("n", "code", "bow", "bert", ["women's health", "x"]), ("m", "code", "bow", "bert", [])], "notebook string, part string, term_type string, embedding_type string, top_domains array<string>")
    tables.write_predictions(df, str(tmp_path / "p"))
    got = {r["notebook"]: r["top_domains"] for r in tables.read_predictions(spark, str(tmp_path / "p")).collect()}
    assert got == {"n": ["women's health", "x"], "m": []}


def test_error_log_is_appended(spark, tmp_path):
    df = spark.createDataFrame([("a/b", "gone")], "ref string, error string")
    for _ in range(2):
        tables.append_errors(df, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log")).count() == 2


def test_report_round_trip(spark):
    titles = {"bow": "Bag of words", "lda": "Topics"}
    df = spark.createDataFrame([(1, "bow", "alpha beta", 2.0, 1), (1, "bow", "gamma", 1.0, 2)], "notebook_id long, method string, term string, score double, rank long")
    text = tables.salient_report(df, titles)
    assert "N/A" in text.first()["report"]
    got = [(r["method"], r["rank"], r["term"]) for r in tables.parse_report(text, titles).orderBy("rank").collect()]
    assert got == [("bow", 1, "alpha beta"), ("bow", 2, "gamma")]


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([("bow", "glove", "x", None)], "term_type string, embed_type string, term string, vec array<double>")
    tables.write_vectors(df, str(tmp_path / "v"))
    assert tables.read_vectors(spark, str(tmp_path / "v")).first()["vec"] == [0.0] * 100
    files = spark.createDataFrame([("/a/nb_one_bow_glove.json", '{"t": [1.0, 2.0]}')], "path string, value string")
    assert tuple(tables.parse_vector_json(files).first()) == ("nb_one", "bow", "glove", "t", [1.0, 2.0])


def test_coefficient_report():
    row = {"class": "a", "feature": "x", "coefficient": 1.5, "lower_ci": 1.0, "upper_ci": 2.0, "p_value": 0.01, "is_significant": True}
    assert "x: 1.5000 [1.0000, 2.0000] p=0.0100 *" in tables.coefficient_report([row], ["a", "b"])


def test_pages(spark, tmp_path):
    rows = [{"id": i, "ref": f"u/k{i}" if i != 3 else "broken", "title": "t"} for i in range(7)]
    (tmp_path / "k.jsonl").write_text("\n".join(map(json.dumps, rows)))
    pages.register(spark)
    df = spark.read.format("kernels").option("search", str(tmp_path / "k.jsonl")).option("page_size", "3").load()
    got = {r["id"]: (r["user"], r["slug"]) for r in df.collect()}
    assert len(got) == 7 and got[3] == (None, None) and got[5] == ("u", "k5")


def test_downloads_resume(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    (source / "a.json").write_text('{"id": 1, "ref": "u/a"}\n{"id": 2, "ref": "u/bad"}')
    paths = str(source), str(tmp_path / "out"), str(tmp_path / "cp")

    def fetch(ref):
        if "bad" in ref:
            raise ValueError("gone")

    download.download(spark, *paths, fetch)
    download.download(spark, *paths, fetch)
    assert spark.read.parquet(paths[1]).count() == 2
    (source / "b.json").write_text('{"id": 3, "ref": "u/c"}')
    download.download(spark, *paths, fetch)
    assert spark.read.parquet(paths[1]).count() == 3
    assert [r["ref"] for r in download.failures(spark, paths[1]).collect()] == ["u/bad"]


def test_trailing_sum_is_exact(spark):
    import random

    random.seed(4)
    times = sorted(random.uniform(0, 400) for _ in range(80))
    df = spark.createDataFrame([(i, t, float(i)) for i, t in enumerate(times)], "i long, t double, v double").selectExpr("i", "timestamp_micros(cast(t * 1000000 as long)) as ts", "v")
    got = {r["i"]: r["trailing"] for r in budget.trailing_sum(df, "ts", "v", 60).collect()}
    micros = [int(t * 1000000) for t in times]
    assert got == {i: sum(float(j) for j in range(80) if 0 <= micros[i] - micros[j] < 60_000_000) for i in range(80)}


def test_token_budget_waits():
    now = [0.0]
    own = budget.TokenBudget(100, 10, 1, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    own.take(80)
    own.take(30)
    assert now[0] >= 60 and own.used() == 30


def test_windowed_tokens_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i,) for i in range(120)], "i long").selectExpr("timestamp_seconds(i) as ts", "1.0 as v")
    rows.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))
    query = budget.windowed_tokens(stream, "ts", "v", "60 seconds", "60 seconds").writeStream.format("memory").queryName("tok").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["tokens"] for r in spark.table("tok").collect()) == [60.0, 60.0]


def test_tags(spark):
    df = spark.createDataFrame([("u/n", ["A b", "a_B", None, " "], 1)], "kernel_ref string, keywords array<string>, scraped_at long")
    assert tuple(tags_of(df).first()) == ("n", ["a b"])


def test_downloads_begin_again_at_the_failed_id(spark, tmp_path):
    asked, broken = tmp_path / "asked", tmp_path / "broken"
    asked.mkdir()
    broken.write_text("")
    folder, switch = str(asked), str(broken)
    kernels = spark.createDataFrame([(i, f"u/k{i}") for i in range(1, 30)] + [(None, "u/none"), (40, None)], "id long, ref string")

    def fetch(ref):
        import os
        import uuid

        with open(f"{folder}/{ref.split('/')[1]}-{uuid.uuid4().hex}", "w"):
            pass
        if ref == "u/k17" and os.path.exists(switch):
            raise ValueError("gone")

    def seen():
        return sorted(int(p.name.split("-")[0][1:]) for p in asked.iterdir())

    progress = str(tmp_path / "progress")
    assert download.read_progress(spark, progress) is None
    assert download.resume(kernels, progress, fetch, at_once=8) is False
    assert download.read_progress(spark, progress) == 17 and max(seen()) <= 24
    for p in asked.iterdir():
        p.unlink()
    broken.unlink()
    assert download.resume(kernels, progress, fetch, at_once=8) is True
    assert seen() == list(range(17, 30)) and download.read_progress(spark, progress) == 30
    assert download.resume(kernels.limit(0), progress, fetch) is True


def test_single_files_and_unique_values(spark, tmp_path):
    from notemill.sources.files import write_files
    from notemill.sources.tables import write_unique

    df = spark.createDataFrame([("a/b.txt", "é\n"), ("c.txt", ""), (None, "x"), ("d", None)], "path string, content string")
    assert write_files(df, f"file://{tmp_path}/out") == 2 and write_files(df.limit(0), f"file://{tmp_path}/out") == 0
    assert (tmp_path / "out/a/b.txt").read_text() == "é\n" and (tmp_path / "out/c.txt").read_text() == ""
    write_unique(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "tag string"), "tag", str(tmp_path / "tags"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "tags")).collect()] == ["a", "b"]


def test_intermediate_tables_are_gone_after_the_session(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from notemill.session import build_session, materialize
spark = build_session("t", 2, spark__checkpoint__dir="file://{tmp_path}")
assert materialize(spark.range(5)).count() == 5
import os
assert len(list(os.walk("{tmp_path}"))) > 2
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, stderr=subprocess.DEVNULL)
    assert not [p for p in tmp_path.rglob("*.parquet")]


def test_part_files_in_the_order_of_their_paths(spark, tmp_path):
    from notemill.sources.notebooks import read_part_files

    for name in ("b/x_code.txt", "a/y_comment.txt", "a/.hidden.txt", "a/b/z_code.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    rows = read_part_files(spark, str(tmp_path), ordered=True).collect()
    assert [r["text"] for r in rows] == ["a/b/z_code.txt", "a/y_comment.txt", "b/x_code.txt"]
