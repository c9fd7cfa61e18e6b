import pytest
from pyspark.sql import functions as F

from notemill.functions import code as C
from notemill.functions import lists as L
from notemill.functions import text as T
from notemill.functions.vectors import cosine, unit


def value(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if v and isinstance(v[0], str) or v == [] else 'array<double>'}" for k, v in cells.items()))
    return df.select(column.alias("x")).first()["x"]


def test_clean_code_strips_headers_and_indentation(spark):
    text = "\nContent of code cell #1:import os\n    x = 1\n\nContent of code cell #2:def f():\n\treturn 2"
    assert value(spark, T.clean_lines(F.col("t"), "code"), t=text) == ["import os", "x = 1", "def f():", "return 2"]


def test_clean_narrative_skips_head_only_before_text(spark):
    text = "Markdown Narrative from: a.ipynb\n" + "=" * 50 + "\n\nMarkdown Cell #1:\nTitle\n" + "=" * 20 + "\n" + "-" * 30 + "\nend"
    assert value(spark, T.clean_lines(F.col("t"), "narrative"), t=text) == ["Title", "=" * 20, "end"]


def test_clean_comment_keeps_the_no_comment_sentence(spark):
    text = "Comments extracted from: code.txt\n" + "=" * 50 + "\n\nNo comments found in the code.\n"
    assert value(spark, T.clean_lines(F.col("t"), "comment"), t=text) == ["No comments found in the code."]
    assert value(spark, T.clean_lines(F.col("t"), "comment"), t=None) == []


def test_tokens(spark):
    got = value(spark, T.tokens(F.col("t")), t="The Größe of _private data_frame and abc 12tensors averyveryverylongword")
    assert got == ["größe", "data_frame", "tensors"]


def test_bare_hash_takes_the_next_line(spark):
    assert value(spark, T.inline_comments(F.col("t")), t="#\nx = 1\ny = 2  # two") == ["x = 1", "two"]


def test_cells(spark):
    got = value(spark, T.code_cells(F.col("t")), t="\nContent of code cell #1:a\nContent of code cell #2:b")
    assert [(c["cell"], c["source"]) for c in got] == [(1, "a\n"), (2, "b")]


@pytest.mark.parametrize(
    ("answer", "relevance", "specificity"),
    [
        ("Highly Relevant", "Highly Relevant", "Unclear"),
        ("not relevant", "Relevant", "Unclear"),
        ("partially relevant", "Partially Relevant", "Unclear"),
        ("too specific and general", "Unclear/Not Relevant", "Too General"),
        ("appropriately specific, too broad", "Unclear/Not Relevant", "Appropriately Specific"),
        (None, "Unknown", "Unknown"),
    ],
)
def test_categories(spark, answer, relevance, specificity):
    assert value(spark, T.relevance(F.col("a")), a=answer) == relevance
    assert value(spark, T.specificity(F.col("a")), a=answer) == specificity


def test_prompt_leaves_out_missing_parts(spark):
    got = value(spark, T.prompt(F.lit("music"), F.col("c"), F.col("n")), c="x" * 1501, n=None)
    assert "x" * 1500 + "..." in got and "Narrative" not in got


def test_split_ref(spark):
    assert tuple(value(spark, T.split_ref(F.col("r")), r="a/b")) == ("a", "b")
    assert value(spark, T.split_ref(F.col("r")), r="a/b/c") is None


def test_imports(spark):
    code = "import numpy as np, pandas\nfrom a.b.c import keras\nfrom torch.nn import Linear"
    row = spark.createDataFrame([(code,)], "c string").select(*C.library_flags(F.col("c"))).first().asDict()
    on = {k for k, v in row.items() if v}
    # only the first of several names; with two dots only what follows import; pytorch stands for torch
    assert on == {"lib_numpy", "tensor_lib_numpy", "lib_keras", "lib_torch", "lib_pytorch", "tensor_lib_torch"}


def test_tensor_ops_by_tree_and_by_pattern():
    flags, n = C.ops_of("%matplotlib inline\nx = np.add(a, b)\ny = add(x)")
    assert n == 2 and flags[C.TENSOR_OPS.index("add")] == 1
    # indentation without a block is no Python: the pattern counts an attribute call twice
    flags, n = C.ops_of("def f():\nreturn x.add(y)\nsplit_x = 1")
    assert n == 3 and flags[C.TENSOR_OPS.index("split")] == 1
    assert C.ops_of("train_test_split(x)") == ([0] * 17, 0)
    assert C.ops_of(None) == ([0] * 17, 0)


@pytest.mark.parametrize(("code", "depth"), [("class A:\n pass", 0), ("class A():", 2), ("class A(B):\nclass B(C):", 3), ("class A(B):\nclass B(A):", 2), ("class A(metaclass=M):", 2), (None, 0), ("class A(B, C):\nclass B(D):\nclass C(D):\nclass D(E):", 4), ("class A(B):\nclass B(C):\nclass C(B, X):", 4), ("class A(B):\nclass A(X):", 2), ("\n".join(f"class K{i}(K{i + 1}, L{i + 1}):\nclass L{i}(K{i + 1}, L{i + 1}):" for i in range(40)), 41)])
def test_inheritance(code, depth):
    assert C.depth_of(code) == depth


def test_counts(spark):
    code = "def f(x):\n  if x and y: return 1\n  elif z: pass\nclass A):"
    assert value(spark, C.count_functions(F.col("c")), c=code) == 1
    assert value(spark, C.count_classes(F.col("c")), c=code) == 1
    assert value(spark, C.cyclomatic(F.col("c")), c=code) == 3 + 2 * 2
    assert value(spark, C.cyclomatic(F.col("c")), c="") == 2
    assert value(spark, C.cyclomatic(F.col("c")), c=None) == 1


def test_lists(spark):
    assert value(spark, L.parse_list(F.col("s")), s="[\"it's\", 'x']") == ["it's", "x"]
    assert value(spark, L.parse_list(F.col("s")), s="broken 'a' and 'b") == ["a"]
    assert value(spark, L.parse_list(L.print_list(F.col("s"))), s=["it's", "x"]) == ["it's", "x"]
    assert value(spark, L.first_label(L.parse_list(F.col("s"))), s="[]") == "Unknown"


@pytest.mark.parametrize(("predicted", "truth", "want"), [(["A", "b", "x"], ["a", "B", "c"], 2 / 3), ([], ["a", "b", "c"], 0.0), (["a"], ["a", "b"], None), (["a"], ["a", "b", "c"], 1.0), (["a", "a", "a"], ["a", "b", "c"], 1.0)])
def test_precision(spark, predicted, truth, want):
    df = spark.createDataFrame([(predicted, truth)], "p array<string>, t array<string>")
    assert df.select(L.precision_at_k(F.col("p"), F.col("t")).alias("x")).first()["x"] == (pytest.approx(want) if want is not None else None)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(unit(F.col("a")).alias("u"), cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert got["u"] == pytest.approx([0.6, 0.8]) and got["c"] is None
