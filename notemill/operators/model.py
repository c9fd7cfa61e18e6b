"""Regression on features: selection, split, logistic models, permutation tests, scores."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.operators.indexing import dense_index, rank_within
from notemill.operators.skew import lookup
from notemill.operators.stats import correlations
from notemill.session import materialize, release

#: Columns that a correlated pair keeps against others, by how their names begin.
FAVOURED = ("tensor_lib_", "op_", "cyclomatic_complexity")
NAMED = ["num_lines", "num_functions", "num_classes", "cyclomatic_complexity", "narrative_size"]


def feature_columns(table: DataFrame) -> list[str]:
    """Features by name: the operation and tensor-library flags and five counts."""
    return [c for c in table.columns if c.startswith(("tensor_lib_", "op_")) or c in NAMED]


def frequent_classes(table: DataFrame, label: str, least: int = 5) -> DataFrame:
    """Rows whose class has at least ``least`` rows; null classes are dropped."""
    kept = table.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return table.join(kept.select(label), label, "left_semi")


def uncorrelated(table: DataFrame, columns: list[str], limit: float = 0.8) -> list[str]:
    """Columns left after the strongest pairs lost one each.

    Pairs go from the strongest down; one that has lost a column already is skipped.  The second
    of a pair is kept if its name is favoured, else the first if that is; else both stay.
    """
    pairs = correlations(table, columns).where(F.abs("corr") >= limit).orderBy(F.desc(F.abs("corr")), "first", "second").collect()
    lost: set[str] = set()
    for pair in pairs:
        a, b = pair["first"], pair["second"]
        if a in lost or b in lost:
            continue
        if b.startswith(FAVOURED):
            lost.add(a)
        elif a.startswith(FAVOURED):
            lost.add(b)
    return [c for c in columns if c not in lost]


def inflation(table: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation factor of each column: the diagonal of the inverse correlation matrix.

    Constant columns have none and are left out; columns that others determine get infinity.
    """
    spread = table.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in columns]).first()
    own = [c for c in columns if spread[c]]
    at = {c: k for k, c in enumerate(own)}
    matrix = np.eye(len(own))
    for r in correlations(table, own).collect() if len(own) > 1 else []:
        matrix[at[r["first"]], at[r["second"]]] = matrix[at[r["second"]], at[r["first"]]] = r["corr"] or 0.0
    values, vectors = np.linalg.eigh(matrix)
    out = {}
    for c, k in at.items():
        weak = values < 1e-10
        out[c] = float("inf") if (np.abs(vectors[k, weak]) > 1e-6).any() else float((vectors[k, ~weak] ** 2 / values[~weak]).sum())
    return out


def selection(table: DataFrame, columns: list[str], limit: float = 0.8, most: float = 10.0) -> list[tuple[str, str, float | None]]:
    """(feature, state, inflation factor), the largest factor first.

    ``correlated`` columns went by pairs; of those left, all at once, the ``inflated`` ones with a
    factor above ``most``; the others are ``kept``.  Correlated and constant columns have no factor.
    """
    left = uncorrelated(table, columns, limit)
    factors = inflation(table, left)
    rows = [(c, "correlated" if c not in left else "inflated" if factors.get(c, 0.0) > most else "kept", factors.get(c)) for c in columns]
    return sorted(rows, key=lambda r: (-(r[2] if r[2] is not None else -1.0), r[0]))


def selected(table: DataFrame, columns: list[str], limit: float = 0.8, most: float = 10.0) -> list[str]:
    """The columns that ``selection`` keeps, in their order."""
    kept = {c for c, state, _ in selection(table, columns, limit, most) if state == "kept"}
    return [c for c in columns if c in kept]


def stratified_split(table: DataFrame, label: str, key: str, test: float = 0.25, seed: int = 42) -> DataFrame:
    """``table`` with ``is_test``: in every class the share ``test`` with the least hashes of ``key``."""
    counts = table.groupBy(label).agg(F.count("*").alias("_n"))
    ranked = rank_within(table.withColumn("_o", F.xxhash64(F.lit(seed), key)), label, ["_o", key], "_r")
    return lookup(ranked, counts, label).where("_n is not null").withColumn("is_test", F.col("_r") < F.ceil(F.col("_n") * test)).drop("_r", "_n", "_o")


def balanced_weights(table: DataFrame, label: str) -> DataFrame:
    """``table`` with ``weight`` = rows / (classes x rows of the class)."""
    counts = table.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    return lookup(table, counts, label).where("_n is not null").crossJoin(F.broadcast(total)).withColumn("weight", F.col("_t") / (F.col("_k") * F.col("_n"))).drop("_n", "_t", "_k")


def fit_multinomial(table: DataFrame, columns: list[str], label: str, c: float = 1.0, iterations: int = 2000) -> tuple[LogisticRegressionModel, list[str]]:
    """Multinomial logistic regression with L2 penalty and balanced class weights; (model, classes)."""
    classes = sorted(r[0] for r in table.select(label).where(F.col(label).isNotNull()).distinct().limit(10_000).collect())
    index = F.element_at(F.create_map(*[x for k, v in enumerate(classes) for x in (F.lit(v), F.lit(float(k)))]), F.col(label))
    # written once, as every iteration is a pass over it
    rows = materialize(balanced_weights(table.select(label, *columns), label).select(index.alias("_y"), "weight", *columns), n=F.count(F.lit(1)))
    data = VectorAssembler(inputCols=columns, outputCol="_x").transform(rows)
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="weight", family="multinomial", regParam=1.0 / (c * max(1, rows.counts["n"])), elasticNetParam=0.0, standardization=False, maxIter=iterations).fit(data)
    return model, classes


def coefficients(model: LogisticRegressionModel, classes: list[str], columns: list[str], like: DataFrame) -> DataFrame:
    """(class, feature, coefficient), the intercept among the features."""
    matrix, intercept = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    rows = [(k, f, float(matrix[i, j])) for i, k in enumerate(classes) for j, f in enumerate(columns)]
    rows += [(k, "intercept", float(intercept[i])) for i, k in enumerate(classes)]
    return like.sparkSession.createDataFrame(rows, "class string, feature string, coefficient double")


def predict(model: LogisticRegressionModel, classes: list[str], columns: list[str], table: DataFrame) -> DataFrame:
    """``table`` with ``predicted``, the likeliest class."""
    data = VectorAssembler(inputCols=columns, outputCol="_x").transform(table)
    names = F.array(*[F.lit(k) for k in classes])
    return model.transform(data).withColumn("predicted", F.get(names, F.col("prediction").cast("int"))).drop("_x", "rawPrediction", "probability", "prediction")


def classification_report(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, support, precision, recall, f1) and the row ``macro`` with their plain means.

    The macro recall is the balanced accuracy.  A class that is never predicted has precision 0.
    """
    cells = pairs.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    rows = cells.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    given = cells.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("given"))
    both = rows.join(given, "class", "left").na.fill(0, ["given"])
    precision, recall = F.coalesce(F.try_divide("hit", "given"), F.lit(0.0)), F.col("hit") / F.col("support")
    scored = both.withColumn("precision", precision).withColumn("recall", recall)
    scored = scored.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    scored = scored.select(F.col("class").cast("string").alias("class"), "support", "precision", "recall", "f1")
    macro = scored.agg(F.lit("macro").alias("class"), F.sum("support").alias("support"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    return scored.unionByName(macro)


#: Rows that are worked on at once, rows and models of one look at gradients alone, and models whose sums travel together.
ROWS_AT_ONCE, GRADIENT_ROWS, GRADIENT_MODELS, MODELS_A_BLOCK = 2048, 256, 512, 1024


def shuffled(ids: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where permutation ``seed`` of 0 .. n-1 puts ``ids``.

    A Feistel network over the next even number of bits, walked until it is below n, is a
    bijection; so every row can tell its own place, and no table of places is needed.
    """
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng([7, seed]).integers(0, 1 << 63, 8, dtype=np.uint64)
    out = ids.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        at = out[todo]
        left, right = at >> half, at & mask
        for key in keys:
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _targets(ids: np.ndarray, x: np.ndarray, n: int, places: list[int], bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows ``x`` that permutation i puts into each class: (permutation, class, feature); -1 leaves rows where they are.

    Rows are numbered by class, so class k has the places from ``bounds[k]`` to before ``bounds[k + 1]``.  This is all
    that a logistic model needs to know of its labels.
    """
    d, k = x.shape[1], len(bounds) - 1
    out, column = np.zeros((len(places), k, d)), np.arange(d)
    for at, i in enumerate(places):
        own = np.searchsorted(bounds, shuffled(ids, n, i) if i >= 0 else ids, "right") - 1
        out[at] = np.bincount((own[:, None] * d + column).ravel(), x.ravel(), k * d).reshape(k, d)
    return out


def _cubes(x: np.ndarray) -> np.ndarray:
    """Sums over the rows of the products of each upper pair of features (row) with each feature (column)."""
    i, j = np.triu_indices(x.shape[1])
    return sum(((own[:, i] * own[:, j]).T @ own for own in (x[at : at + ROWS_AT_ONCE] for at in range(0, len(x), ROWS_AT_ONCE))), np.zeros((len(i), x.shape[1])))


def _gradients(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of the rows times their probabilities, for each column's model."""
    out = np.zeros(w.shape)
    for k in range(0, w.shape[1], GRADIENT_MODELS):
        own = np.ascontiguousarray(-w[:, k : k + GRADIENT_MODELS])
        for at in range(0, len(x), GRADIENT_ROWS):
            rows = x[at : at + GRADIENT_ROWS]
            m = rows @ own
            np.minimum(m, 700, out=m)
            np.exp(m, out=m)
            m += 1
            out[:, k : k + GRADIENT_MODELS] += rows.T @ np.reciprocal(m, out=m)
    return out


def _sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper half of the Hessian of each column's model if no row is of its class, one below the other."""
    i, j = np.triu_indices(len(w))
    out = np.zeros((1 + len(w) + len(i), w.shape[1]))
    for at in range(0, len(x), ROWS_AT_ONCE):
        rows = x[at : at + ROWS_AT_ONCE]
        m = rows @ w
        e = np.exp(-np.abs(m))
        p = np.where(m >= 0, 1.0, e) / (1 + e)
        out[0] += (np.maximum(m, 0) + np.log1p(e)).sum(axis=0)
        out[1 : 1 + len(w)] += rows.T @ p
        out[1 + len(w) :] += (rows[:, i] * rows[:, j]).T @ (p * (1 - p))
    return out


def _lasso_step(w: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Minimum of the quadratic model plus the L1 norm, by coordinate descent for all columns at once."""
    v, pull = w.copy(), np.zeros((w.shape[1], len(w)))
    for _ in range(10_000):
        most = 0.0
        for j in range(len(w)):
            h = hess[:, j, j] + 1e-12
            z = v[j] * h - grad[j] - pull[:, j]
            new = np.sign(z) * np.maximum(np.abs(z) - 1, 0) / h
            move = new - v[j]
            pull += move[:, None] * hess[:, j]
            v[j] = new
            most = max(most, float(np.abs(move).max()))
        if most < 1e-10:
            break
    return v - w


def _fit_binary(sums: Callable[[np.ndarray], np.ndarray], targets: np.ndarray, start: np.ndarray, c: float, l1: bool, passes: int = 200) -> np.ndarray:
    """Coefficients (intercept first, penalised too) of binary logistic models, one a column of ``start``.

    Newton steps, for L1 proximal ones, halved where the loss would rise.  ``sums`` gives what
    ``_sums`` does for coefficients: from an array or from a distributed table; ``targets`` has the sum of each
    model's rows of its class.
    """
    d, k = start.shape
    w, move, low = start.copy(), np.zeros((d, k)), np.full(k, np.inf)
    i, j = np.triu_indices(d)
    left = np.arange(k)
    for _ in range(passes):
        at = w[:, left] + move[:, left]
        got = sums(at)
        got[0] -= (targets[:, left] * at).sum(axis=0)
        got[1 : 1 + d] -= targets[:, left]
        got *= c
        loss = got[0] + (np.abs(at).sum(axis=0) if l1 else (at * at).sum(axis=0) / 2)
        fine = loss <= low[left] + 1e-12 * np.abs(loss)
        move[:, left[~fine]] /= 2
        if fine.any():
            at, grad, own = at[:, fine], got[1 : 1 + d, fine], left[fine]
            hess = np.zeros((len(own), d, d))
            hess[:, i, j] = hess[:, j, i] = got[1 + d :, fine].T
            w[:, own], low[own] = at, loss[fine]
            move[:, own] = _lasso_step(at, grad, hess) if l1 else -np.linalg.solve(hess + np.eye(d), (grad + at).T[:, :, None])[:, :, 0].T
        left = left[np.abs(move[:, left]).max(axis=0) >= 1e-5]  # the error that is left is of the order of its square
        if not len(left):
            return w + move + 0.0
    raise RuntimeError(f"logistic models did not settle in {passes} passes")


def _fit_null(gradients: Callable[[np.ndarray], np.ndarray], sums: Callable[[np.ndarray], np.ndarray], cubes: np.ndarray, targets: np.ndarray, counts: np.ndarray, c: float, passes: int = 30) -> np.ndarray:
    """Coefficients of L2 models of permuted labels, a column for each of ``targets``, whose classes have ``counts`` rows.

    Such models lie near the one that has an intercept alone, where all rows are equally likely; there the Hessian
    and its change follow from sums over all rows, ``cubes``, which are the same for all models.  With this Hessian steps
    need only gradients.  They go on until what is left is of the order of 1e-9; models for which a step is
    no gain are fitted by ``_fit_binary``.
    """
    d, k = targets.shape
    i, j = np.triu_indices(d)
    cube = np.zeros((d, d, d))
    cube[i, j] = cube[j, i] = cubes
    n = cube[0, 0, 0]
    w, left, hard, last = _start(counts, n, d), np.arange(k), [], np.full(k, np.inf)
    start = w.copy()
    p = 1 / (1 + np.exp(-start[0]))
    for _ in range(passes):
        at = w[:, left]
        pull = c * (gradients(at) - targets[:, left]) + at
        move = np.empty_like(at)
        for b in range(0, len(left), GRADIENT_MODELS):
            own = slice(b, b + GRADIENT_MODELS)
            share = p[left[own]]
            change = (cube.reshape(d * d, d) @ (at[:, own] - start[:, left[own]])).T.reshape(-1, d, d)
            hess = c * (share * (1 - share))[:, None, None] * (cube[:, :, 0] + (1 - 2 * share)[:, None, None] * change) + np.eye(d)
            move[:, own] = -np.linalg.solve(hess, pull[:, own].T[:, :, None])[:, :, 0].T
        size = np.abs(move).max(axis=0)
        gain = size < last[left] / 2  # also false for what is no number
        hard += left[~gain].tolist()
        left, move, size = left[gain], move[:, gain], size[gain]
        w[:, left] += move
        last[left] = size
        left = left[size >= 1e-9]
        if not len(left):
            break
    hard = np.array(sorted({*hard, *left.tolist()}), dtype=int)
    if len(hard):
        w[:, hard] = _fit_binary(sums, targets[:, hard], start[:, hard], c, False)
    return w


def _start(counts: np.ndarray, n: float, d: int) -> np.ndarray:
    """Zeros, but for the intercept the log odds of the class."""
    w = np.zeros((d, len(counts)))
    share = (np.asarray(counts) + 0.5) / (n + 1)
    w[0] = np.log(share / (1 - share))
    return w


SIGNIFICANCE = "class string, feature string, coefficient double, std_error double, lower_ci double, upper_ci double, p_value double, is_significant boolean"


def _added(table: DataFrame, columns: list[str], of: Callable[[np.ndarray, np.ndarray, object], np.ndarray], sent: object) -> np.ndarray:
    """The sum over ``table`` (columns, _id) of what ``of(ids, rows, sent)`` gives for its rows, a matrix, in one pass.

    Each task adds up its rows, then blocks of columns are added.
    """
    spark = table.sparkSession
    few = table.coalesce(spark.sparkContext.defaultParallelism)
    schema, shared = "b long, height long, part binary", spark.sparkContext.broadcast(sent)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            ids, x = batch["_id"].to_numpy(), np.column_stack([np.ones(len(batch)), batch[columns].to_numpy(dtype=float)])
            own = of(ids, x, shared.value)
            total = own if total is None else total + own
        for b in range(0, total.shape[1] if total is not None else 0, MODELS_A_BLOCK):
            yield pd.DataFrame({"b": [b], "height": [len(total)], "part": [total[:, b : b + MODELS_A_BLOCK].tobytes()]})

    def added(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p) for p in sorted(group["part"]))
        return pd.DataFrame({"b": [key[0]], "height": group["height"][:1], "part": [total.tobytes()]})

    blocks = few.mapInPandas(partial, schema).groupBy("b").applyInPandas(added, schema).orderBy("b").collect()
    shared.destroy()
    return np.hstack([np.frombuffer(r["part"]).reshape(r["height"], -1) for r in blocks])


def _bounds(ends: dict[str, tuple[int, int]], n: int) -> tuple[np.ndarray, dict[str, int]]:
    """Where the classes begin, with the end of all, and the number of each class."""
    names = sorted(ends, key=lambda k: ends[k])
    return np.array([ends[k][0] for k in names] + [n]), {k: at for at, k in enumerate(names)}


def _distributed_statistics(rows: DataFrame, columns: list[str], label: str, classes: list[str], permutations: int, c: float) -> DataFrame:
    """(class, k, seen, std_error, p_value) for a table of any size: the rows stay where they are and
    every step of all models is one pass over them."""
    numbered = dense_index(rows, [label, *columns], "_id")
    ends = {r[label]: (r["first"], r["last"] + 1) for r in numbered.groupBy(label).agg(F.min("_id").alias("first"), F.max("_id").alias("last")).collect()}
    n, d = max((end for _, end in ends.values()), default=0), len(columns) + 1
    bounds, number = _bounds(ends, n)
    table = materialize(numbered.select("_id", *columns))
    release(numbered)
    cubes = _added(table, columns, lambda ids, x, _: _cubes(x), None)
    got = _added(table, columns, lambda ids, x, _: _targets(ids, x, n, range(-1, permutations), bounds).reshape(-1, x.shape[1]).T, None).reshape(d, permutations + 1, len(bounds) - 1)
    none = np.zeros((d, permutations + 1))
    targets = np.stack([got[:, :, number[k]] if k in number else none for k in classes], axis=2)
    counts = np.array([end - first for first, end in (ends.get(k, (0, 0)) for k in classes)])
    sums, gradients = (lambda w, f=f: _added(table, columns, lambda ids, x, w: f(x, w), w) for f in (_sums, _gradients))
    seen = _fit_binary(sums, targets[:, 0], _start(counts, n, d), c, True)
    null = _fit_null(gradients, sums, cubes, targets[:, 1:].reshape(d, -1), np.tile(counts, permutations), c).reshape(d, permutations, -1)
    out = []
    for at, k in enumerate(classes):
        own, those = seen[:, at : at + 1], null[:, :, at]
        beyond = np.where(own >= 0, those >= own, those <= own)
        out += [(k, f, float(own[f, 0]), float(those[f].std()), float(beyond[f].mean())) for f in range(d)]
    release(table)
    return rows.sparkSession.createDataFrame(out, "class string, k int, seen double, std_error double, p_value double")


def permutation_test(table: DataFrame, columns: list[str], label: str, classes: list[str], permutations: int = 1000, c: float = 1.0, block: int = 25, max_rows: int = 50_000) -> DataFrame:
    """Significance of each feature for each class against permuted labels.

    The observed coefficients are those of an L1 model, the permuted ones of L2 models; the
    standard error is the population deviation of the latter, the p-value the share of them that
    lie beyond the observed one on its side.  Up to ``max_rows`` rows every task fits all classes for
    one block of permutations on the broadcast feature matrix; a larger table is not collected, and
    the same models with the same permutations are fitted by passes over it.  Rows with a null are
    left out.
    """
    spark = table.sparkSession
    rows = table.select(*[F.col(x).cast("double") for x in columns], label).na.drop()
    feature = F.get(F.array(*[F.lit(n) for n in ["intercept", *columns]]), F.col("k"))
    if not classes or rows.limit(max_rows + 1).count() > max_rows:
        stats = _distributed_statistics(rows, columns, label, classes, permutations, c) if classes else spark.createDataFrame([], "class string, k int, seen double, std_error double, p_value double")
    else:
        own = rows.orderBy(label, *columns).collect()
        names = [r[-1] for r in own]
        ends = {k: (bisect_left(names, k), bisect_right(names, k)) for k in classes}
        data = spark.sparkContext.broadcast(np.array([(1.0, *r[:-1]) for r in own], dtype=float).reshape(len(own), len(columns) + 1))
        bounds, number = _bounds({k: (bisect_left(names, k), bisect_right(names, k)) for k in set(names)}, len(own))
        some = [k for k in classes if k in number]
        missing = [k for k in classes if k not in number]
        # the observed models are a block of their own, begun first
        jobs = spark.createDataFrame([(b,) for b in range(-1, -(-permutations // block))], "block long").repartition(1 - (-permutations // block))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x = data.value
            ids, cubes = np.arange(len(x)), None
            for batch in batches:
                for b in batch["block"]:
                    places = list(range(b * block, min(permutations, (b + 1) * block))) if b >= 0 else [-1]
                    got = _targets(ids, x, len(x), places, bounds)[:, [number[k] for k in some]]
                    targets = np.concatenate([got, np.zeros((len(places), len(missing), x.shape[1]))], axis=1).reshape(-1, x.shape[1]).T
                    counts = np.tile([ends[k][1] - ends[k][0] for k in some + missing], len(places))
                    if b < 0:
                        w = _fit_binary(lambda at: _sums(x, at), targets, _start(counts, len(x), x.shape[1]), c, True)
                    else:
                        cubes = _cubes(x) if cubes is None else cubes
                        w = _fit_null(lambda at: _gradients(x, at), lambda at: _sums(x, at), cubes, targets, counts, c)
                    yield pd.DataFrame([(k, i, w[:, j].tolist()) for j, (i, k) in enumerate((i, k) for i in places for k in some + missing)], columns=["class", "i", "w"])

        fits = materialize(jobs.mapInPandas(run, "class string, i long, w array<double>")).select("class", "i", F.posexplode("w").alias("k", "w"))
        null = fits.where("i >= 0").join(fits.where("i < 0").select("class", "k", F.col("w").alias("seen")), ["class", "k"])
        beyond = F.when(F.col("seen") >= 0, F.col("w") >= F.col("seen")).otherwise(F.col("w") <= F.col("seen"))
        stats = null.groupBy("class", "k", "seen").agg(F.stddev_pop("w").alias("std_error"), F.avg(beyond.cast("double")).alias("p_value"))
    return stats.select("class", feature.alias("feature"), F.col("seen").alias("coefficient"), "std_error", (F.col("seen") - 1.96 * F.col("std_error")).alias("lower_ci"), (F.col("seen") + 1.96 * F.col("std_error")).alias("upper_ci"), "p_value", (F.col("p_value") < 0.05).alias("is_significant"))
