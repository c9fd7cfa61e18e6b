"""Features of source code: libraries, tensor operations, definitions, complexity."""

from __future__ import annotations

import ast
import re
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as TY

# The libraries and operations that the feature table has columns for, in its order.
LIBRARIES = ["numpy", "pandas", "matplotlib", "seaborn", "sklearn", "tensorflow", "keras", "torch", "pytorch", "scipy", "nltk", "cv2", "xgboost", "lightgbm", "transformers", "huggingface", "spacy", "plotly", "gensim", "statsmodels", "tqdm"]
TENSOR_LIBRARIES = ["numpy", "tensorflow", "torch", "jax", "mxnet", "theano", "cupy"]
TENSOR_OPS = ["dot", "matmul", "multiply", "add", "subtract", "divide", "transpose", "reshape", "concatenate", "stack", "split", "slice", "gather", "scatter", "einsum", "conv", "pool"]
# The patterns of imports and definitions.
#: ``import a.b`` names a; ``from a.b import`` names a; with more dots only what follows ``import`` is seen.
IMPORTS = [r"(?U)import\s+(\w+)", r"(?U)from\s+(\w+)(?:\.\w+)?\s+import"]
FUNCTION, CLASS = r"(?U)def\s+\w+\s*\(", r"(?U)class\s+\w+\s*[(:)]"
CLASS_BASES = re.compile(r"class\s+(\w+)\s*\((.*?)\):")
DECISIONS = r"(?U)\b(?:if|for|while|and|or|elif|catch|except|case|with)\b"


def imported(code: Column) -> Column:
    """Distinct lower-case names that import statements bind or load from."""
    text = F.coalesce(code, F.lit(""))
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in IMPORTS])
    return F.array_distinct(F.transform(found, F.lower))


def library_flags(code: Column) -> list[Column]:
    """28 columns of 0 and 1: lib_* and tensor_lib_*; torch and pytorch stand for each other."""
    names = imported(code)
    has = lambda x: F.array_contains(names, x)
    out = [(has(x) | (has("torch") if x == "pytorch" else F.lit(False))).cast("long").alias(f"lib_{x}") for x in LIBRARIES]
    return out + [(has(x) | (has("pytorch") if x == "torch" else F.lit(False))).cast("long").alias(f"tensor_lib_{x}") for x in TENSOR_LIBRARIES]


def tensor_op_count(code: Column, op: str) -> Column:
    """Occurrences of an operation by pattern, for text that Python cannot parse: calls by name,
    calls by attribute (which the first pattern counts too) and names that begin with it."""
    text = F.coalesce(code, F.lit(""))
    patterns = [rf"(?iU)\b{op}\(", rf"(?iU)\.{op}\(", rf"(?iU)\b{op}_"]
    return sum((F.regexp_count(text, F.lit(p)) for p in patterns[1:]), F.regexp_count(text, F.lit(patterns[0]))).cast("long")


def count_functions(code: Column) -> Column:
    return F.regexp_count(F.coalesce(code, F.lit("")), F.lit(FUNCTION)).cast("long")


def count_classes(code: Column) -> Column:
    return F.regexp_count(F.coalesce(code, F.lit("")), F.lit(CLASS)).cast("long")


def cyclomatic(code: Column) -> Column:
    """Decision points plus twice the number of definitions (at least one); 1 where there is no code."""
    decisions = F.regexp_count(code, F.lit(DECISIONS)).cast("long")
    return F.when(code.isNull(), F.lit(1)).otherwise(decisions + 2 * F.greatest(F.lit(1), count_functions(code) + count_classes(code))).cast("long")


def ops_of(code: str | None) -> tuple[list[int], int]:
    """Flags of the operations and the number of their uses: by syntax tree, else by pattern."""
    text = code or ""
    body = "\n".join(ln for ln in text.splitlines() if not ln.strip().startswith(("%", "!")))
    counts = dict.fromkeys(TENSOR_OPS, 0)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(body) if body.strip() else ast.Module([], [])
        for node in ast.walk(tree):
            if isinstance(node, ast.Call):
                name = getattr(node.func, "id", None) or getattr(node.func, "attr", None) or ""
                if isinstance(name, str) and name.lower() in counts:
                    counts[name.lower()] += 1
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        for op in TENSOR_OPS:
            counts[op] = sum(len(re.findall(p, text, re.I)) for p in (rf"\b{op}\(", rf"\.{op}\(", rf"\b{op}_"))
    return [int(counts[op] > 0) for op in TENSOR_OPS], sum(counts.values())


@F.pandas_udf(TY.StructType([TY.StructField("flags", TY.ArrayType(TY.LongType())), TY.StructField("num_tensor_ops", TY.LongType())]))
def tensor_ops(code: pd.Series) -> pd.DataFrame:
    """Flags in the order of ``TENSOR_OPS`` and total uses; null code has none."""
    rows = [ops_of(c) for c in code]
    return pd.DataFrame({"flags": [r[0] for r in rows], "num_tensor_ops": [r[1] for r in rows]})


def depth_of(code: str | None) -> int:
    """Longest chain of base classes among ``class X(...):`` definitions; a name that is not defined
    here counts one, an empty list of bases too; a cycle ends where it closes.

    Classes get their depth once all their bases have one.  Those left over lie on cycles or lead
    to one; among them the longest way without repeated classes counts.
    """
    bases = {name: {b.strip() for b in listed.split(",")} for name, listed in CLASS_BASES.findall(code or "")}
    known: dict[str, int] = {}
    waiting = dict(bases)
    while ready := [c for c, own in waiting.items() if all(b in known or b not in bases for b in own)]:
        known.update({c: 1 + max(known.get(b, 1) for b in waiting[c]) for c in ready})
        for c in ready:
            del waiting[c]

    longest = max(known.values(), default=0)
    ways = [(c, frozenset([c]), 1) for c in waiting]
    while ways:
        at, seen, length = ways.pop()
        for b in waiting[at]:
            if b in waiting and b not in seen:
                ways.append((b, seen | {b}, length + 1))
            else:
                longest = max(longest, length + (0 if b in seen else known.get(b, 1)))
    return longest


@F.pandas_udf(TY.LongType())
def inheritance_depth(code: pd.Series) -> pd.Series:
    return pd.Series([depth_of(c) for c in code], dtype="int64")
