"""Salient terms: frequencies, TF-IDF, topic models."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.stopwords import ENGLISH
from notemill.functions.text import tokens
from notemill.operators.parts import clean_part
from notemill.operators.spread import spread


def part_tokens(parts: DataFrame, stopwords: Iterable[str] = ENGLISH, lemmas: DataFrame | None = None) -> DataFrame:
    """(notebook_id, part, term), one row per token of each part text.

    ``lemmas`` (term, lemma), if given, replaces terms after stop words and lengths were tested.
    """
    out = parts.select("notebook_id", "part", F.explode(tokens(clean_part(F.col("part"), F.col("text")), stopwords)).alias("term"))
    if lemmas is not None:
        out = out.join(lemmas, "term", "left").select("notebook_id", "part", F.coalesce("lemma", "term").alias("term"))
    return out


# Endings of verb forms and what they become, in the order in which they are tried.
VERB_ENDINGS = [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")]


def lemma_table(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(term, lemma) of the distinct ``terms`` (term) that are forms of other words of ``dictionary`` (word).

    Endings are replaced by rule; of the results that the dictionary has, and the term itself if it
    is there, the shortest is the lemma, at equal length that of the earlier rule.  Terms that stay as
    they are, and null, have no row.
    """
    distinct = terms.select("term").where("term is not null").distinct()
    bare = lambda end, new: F.when(F.col("term").endswith(end) & (F.length("term") > len(end)), F.concat(F.expr(f"substring(term, 1, length(term) - {len(end)})"), F.lit(new)))
    forms = [F.struct(F.lit(k).alias("k"), x.alias("word")) for k, x in enumerate([F.col("term"), *[bare(a, b) for a, b in VERB_ENDINGS]])]
    known = distinct.select("term", F.explode(F.array(*forms)).alias("f")).select("term", "f.k", "f.word").join(dictionary.select("word").distinct(), "word")
    best = known.groupBy("term").agg(F.min_by("word", F.struct(F.length("word"), F.col("k"))).alias("lemma"))
    return best.where("lemma <> term")


def retokenised(counts: DataFrame, stopwords: Iterable[str] = ENGLISH, least: int = 2) -> DataFrame:
    """Counts whose terms pass the second look that TF-IDF takes at them: by then lemmas may be stop words or too short."""
    return counts.where((F.length("term") >= least) & ~F.col("term").isin(list(stopwords)))


def term_counts(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Occurrences of each term by ``keys``."""
    return tokens.groupBy(*keys, "term").agg(F.count("*").alias("n"))


def top_terms(scored: DataFrame, keys: list[str], score: str, limit: int = 30) -> DataFrame:
    """The ``limit`` best terms of each document with their rank; ties go to the earlier term."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), "term")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def document_frequency(counts: DataFrame) -> DataFrame:
    """(term, df, ctf) of counts whose rows are one per document and term."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("ctf"))


def tfidf_vocabulary(counts: DataFrame, n_docs: DataFrame, max_features: int = 5000, min_df: int = 2, max_share: float = 0.95) -> DataFrame:
    """(term, idf): the most frequent terms that enough and not too many documents hold.

    ``n_docs`` has one row with the number of part texts, empty ones included; idf is smoothed,
    ln((1 + N) / (1 + df)) + 1.
    """
    df = document_frequency(counts).crossJoin(F.broadcast(n_docs))
    kept = df.where((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n_docs")))
    return kept.orderBy(F.desc("ctf"), "term").limit(max_features).select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, weight): tf x idf over the vocabulary, of length 1 within each document.

    The vocabulary is bounded by its ``max_features`` and travels by broadcast.
    """
    raw = counts.join(F.broadcast(vocabulary), "term").withColumn("_w", F.col("n") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*keys)))
    return raw.select(*keys, "term", (F.col("_w") / length).alias("weight"))


def topic_limit(vocabulary_size: Column, documents: Column, combined: bool = False) -> Column:
    """Number of topics for a notebook: min(10, max(1, V div 5, D div 2)); combined min(5, max(1, V div 10))."""
    if combined:
        return F.least(F.lit(5), F.greatest(F.lit(1), F.floor(vocabulary_size / 10)))
    return F.least(F.lit(10), F.greatest(F.lit(1), F.floor(vocabulary_size / 5), F.floor(documents / 2)))


#: Notebooks whose topic models are fitted together, words to whose multiple a vocabulary is filled up, and values that special functions take at once.
MODELS_AT_ONCE, WORDS_AT_ONCE, VALUES_AT_ONCE = 256, 16, 8192


def fit_lda(counts: np.ndarray, topics: int, passes: int = 15, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(document-topic, topic-term) distributions by variational Bayes; both priors are learned."""
    words = counts.shape[1]
    padded = np.zeros((1, len(counts), _padded(words)))
    padded[0, :, :words] = counts
    doc_topic, topic_term = fit_ldas(padded, np.array([words]), topics, passes, seed)
    return doc_topic[0], topic_term[0, :, :words]


def _padded(words: np.ndarray | int) -> np.ndarray | int:
    return -(-words // WORDS_AT_ONCE) * WORDS_AT_ONCE


def fit_ldas(counts: np.ndarray, words: np.ndarray, topics: int, passes: int = 15, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Models of many notebooks at once: ``counts`` (notebook, document, word), of which notebook i has ``words[i]`` words.

    Each is fitted as if alone, with its own number of steps: no sum goes over notebooks, and the
    widths of all sums follow from the notebook's own size.  So neither the order of the notebooks nor who
    else is among them changes a digit.  Words beyond ``words[i]`` have no share.
    """
    own, docs, width = counts.shape
    real = (np.arange(width) < words[:, None]).astype(float)
    drawn = np.random.default_rng(seed).gamma(100.0, 0.01, topics * width)
    lam = np.ones((own, topics, width))
    for n in np.unique(words):
        lam[words == n, :, :n] = drawn[: topics * n].reshape(topics, n)
    alpha, eta = np.full((own, topics), 1.0 / topics), np.full((own, width), 1.0 / topics)
    log_beta = _mean_log(lam, real[:, None])
    for _ in range(passes):
        beta = np.exp(log_beta) * real[:, None]
        gamma = np.ones((own, docs, topics))
        left, now, left_beta, left_counts, left_alpha, live = np.arange(own), gamma, beta, counts, alpha[:, None], np.ones(own, dtype=bool)
        for _ in range(50):
            theta = np.exp(_mean_log(now))
            phi = theta @ left_beta
            phi += 1e-100
            new = left_alpha + theta * (np.divide(left_counts, phi, out=phi) @ left_beta.transpose(0, 2, 1))
            moved = np.abs(new - now).reshape(len(left), -1).mean(axis=1)
            gamma[left[live]] = new[live]
            live &= moved >= 1e-3
            now = new
            if not live.any():
                break
            if live.mean() < 0.8:  # those that are done are carried along until leaving them out is worth the copy
                left, now, left_beta, left_counts, left_alpha, live = left[live], now[live], left_beta[live], left_counts[live], left_alpha[live], live[live]
        log_theta = _mean_log(gamma)
        theta = np.exp(log_theta)
        lam = eta[:, None] + beta * (theta.transpose(0, 2, 1) @ (counts / (theta @ beta + 1e-100)))
        log_beta = _mean_log(lam, real[:, None])
        alpha = _newton_priors(alpha, log_theta.mean(axis=1), docs, np.ones((own, topics)))
        eta = _newton_priors(eta, log_beta.mean(axis=1), topics, real)
    lam *= real[:, None]
    return gamma / gamma.sum(axis=2, keepdims=True), lam / lam.sum(axis=2, keepdims=True)


def _mean_log(x: np.ndarray, real: np.ndarray | float = 1.0) -> np.ndarray:
    """Mean logarithms of Dirichlet variables whose parameters are the last axis, where ``real`` is 1."""
    return _digamma(x) - _digamma((x * real).sum(axis=-1, keepdims=True))


def _newton_prior(prior: np.ndarray, observed: np.ndarray) -> np.ndarray:
    """The step of ``_newton_priors`` of one Dirichlet towards the rows of Dirichlet parameters ``observed``."""
    return _newton_priors(prior[None], _mean_log(observed).mean(axis=0)[None], len(observed), np.ones((1, len(prior))))[0]


def _newton_priors(prior: np.ndarray, mean_log: np.ndarray, n: int, real: np.ndarray) -> np.ndarray:
    """One Newton step of the parameters of Dirichlets, a row each, towards the mean logarithms of ``n`` observed ones.

    The Hessian is a diagonal plus a constant, so the step needs no inverse; it is halved until it
    stays among the positive numbers.  Parameters where ``real`` is 0 do not count and stay.
    """
    total = (prior * real).sum(axis=1, keepdims=True)
    slope = n * (_digamma(total) - _digamma(prior) + mean_log)
    diagonal, constant = -n * _trigamma(prior), n * _trigamma(total)
    with np.errstate(divide="ignore", invalid="ignore"):  # a single parameter has no step
        shift = (slope / diagonal * real).sum(axis=1, keepdims=True) / (1 / constant + (real / diagonal).sum(axis=1, keepdims=True))
        step = (slope - shift) / diagonal * real
    out, left = prior.copy(), np.arange(len(prior))
    for _ in range(20):
        new = prior[left] - step[left]
        fine = (np.isfinite(new) & (new > 1e-6)).all(axis=1)
        out[left[fine]] = new[fine]
        left = left[~fine]
        if not len(left):
            break
        step[left] /= 2
    return out


def _shifted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The product P of x .. x + 5 as a polynomial of y = x (x + 5): its first and second derivative by y, its own value, and y's derivative."""
    y = x * (x + 5)
    return (3 * y + 20) * y + 24, 6 * y + 20, ((y + 10) * y + 24) * y, 2 * x + 5


def _trigamma(x: np.ndarray) -> np.ndarray:
    first, second, product, inner = _shifted(x)
    inverse = 1 / (x + 6)
    square = inverse * inverse
    series = inverse + square / 2 + square * inverse * (1 / 6 - square * (1 / 30 - square * (1 / 42 - square / 30)))
    slope = first * inner / product
    return series + slope * slope - (second * inner * inner + 2 * first) / product


def _digamma(x: np.ndarray) -> np.ndarray:
    """By the asymptotic series at x + 6, a cache's worth of values at a time."""
    out = np.empty(x.size)
    for at in range(0, x.size, VALUES_AT_ONCE):
        own = x.reshape(-1)[at : at + VALUES_AT_ONCE]
        first, _, product, inner = _shifted(own)
        inverse = 1 / (own + 6)
        square = inverse * inverse
        series = np.log(own + 6) - inverse / 2 - square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132))))
        out[at : at + VALUES_AT_ONCE] = series - first * inner / product
    return out.reshape(x.shape)


LDA_SCHEMA = "notebook_id long, part string, terms array<struct<term: string, score: double>>"


def _fitted(counts: DataFrame, combined: bool, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(notebook_id, part, terms): terms with their scores for each document of each notebook's own topic model.

    The documents are the parts of a notebook, or if ``combined`` all its terms, without a part.
    ``score`` gives from distributions (notebook, document, topic) and (notebook, topic, word) the
    scores (notebook, document, word), NaN where a term has none.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("notebook_id"), batch.column("rows")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(rows).to_numpy())])
            flat = rows.flatten()
            book = np.repeat(np.arange(len(ids)), np.diff(ends))
            n, (terms, term), (parts, part) = flat.field("n").to_numpy(), _codes(flat.field("term")), _codes(flat.field("part"))
            # words and documents of a notebook are numbered in their order
            (words, word), (docs, doc) = (np.unique(book * len(names) + code, return_inverse=True) for names, code in ((terms, term), (parts, part)))
            first_word, first_doc = (np.searchsorted(x, np.arange(len(ids) + 1) * len(names)) for x, names in ((words, terms), (docs, parts)))
            word, doc, n_words, n_docs = word - first_word[book], doc - first_doc[book], np.diff(first_word), np.diff(first_doc)
            topics = np.clip(n_words // 10, 1, 5) if combined else np.clip(np.maximum(n_words // 5, n_docs // 2), 1, 10)
            if combined:
                doc, n_docs = np.zeros_like(doc), np.ones_like(n_docs)
            shapes = np.column_stack([n_docs, topics, _padded(n_words)])
            for shape in np.unique(shapes, axis=0):
                alike = np.flatnonzero((shapes == shape).all(axis=1))
                for at in range(0, len(alike), MODELS_AT_ONCE):
                    own = alike[at : at + MODELS_AT_ONCE]
                    docs_each, k, width = (int(v) for v in shape)
                    length = ends[own + 1] - ends[own]
                    where = np.repeat(ends[own] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                    cell = (np.repeat(np.arange(len(own)), length) * docs_each + doc[where]) * width + word[where]
                    table = np.bincount(cell, n[where], len(own) * docs_each * width).reshape(len(own), docs_each, width)
                    scores = score(*fit_ldas(table, n_words[own], k))
                    scores[np.arange(width) >= np.broadcast_to(n_words[own][:, None, None], scores.shape)] = np.nan
                    b, d, w = np.nonzero(~np.isnan(scores))
                    found = terms.take(pa.array(words[first_word[own][b] + w] % len(terms)))
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(b * docs_each + d, minlength=len(own) * docs_each))])
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([found, pa.array(scores[b, d, w])], ["term", "score"]))
                    named = pa.nulls(len(own), pa.string()) if combined else parts.take(pa.array(docs[(first_doc[own][:, None] + np.arange(docs_each)).ravel()] % len(parts)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(own, docs_each))), named, lists], ["notebook_id", "part", "terms"])

    books = counts.groupBy("notebook_id").agg(F.collect_list(F.struct("part", "term", "n")).alias("rows"))
    return spread(books).mapInArrow(fit, LDA_SCHEMA)


def _codes(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values in their order, by code points, and the number there of each value."""
    coded = values.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def lda_term_lists(counts: DataFrame, top: int = 20, least: float = 0.05) -> DataFrame:
    """Topic-model scores (notebook_id, part, terms array<struct<term, score>>) of counts (notebook_id, part, term, n).

    One small model per notebook over its parts: a term's score is the sum over the document's
    topics with probability above ``least`` of probability times the term's share among the
    topic's ``top`` terms; where no topic is that likely, the likeliest alone counts.
    """

    def score(doc_topic: np.ndarray, topic_term: np.ndarray) -> np.ndarray:
        leading = np.zeros(topic_term.shape, dtype=bool)
        np.put_along_axis(leading, np.argsort(-topic_term, axis=2, kind="stable")[:, :, :top], True, axis=2)
        likeliest = np.arange(doc_topic.shape[2]) == doc_topic.argmax(axis=2)[:, :, None]
        chosen = np.where((doc_topic > least).any(axis=2, keepdims=True), doc_topic > least, likeliest)
        out, seen = np.zeros((*doc_topic.shape[:2], topic_term.shape[2])), np.zeros((*doc_topic.shape[:2], topic_term.shape[2]), dtype=bool)
        for t in range(doc_topic.shape[2]):
            own = chosen[:, :, t, None] & leading[:, None, t]
            out += np.where(own, doc_topic[:, :, t, None] * topic_term[:, None, t], 0.0)
            seen |= own
        return np.where(seen, out, np.nan)

    return _fitted(counts, False, score)


def lda_combined_lists(counts: DataFrame) -> DataFrame:
    """(notebook_id, terms array<struct<term, score>>): one model over a notebook's whole text, a term's best topic share."""
    return _fitted(counts, True, lambda _, topic_term: topic_term.max(axis=1, keepdims=True)).drop("part")


def lda_terms(counts: DataFrame, top: int = 20, least: float = 0.05) -> DataFrame:
    """``lda_term_lists`` as rows (notebook_id, part, term, score)."""
    return lda_term_lists(counts, top, least).select("notebook_id", "part", F.inline("terms"))


def lda_combined(counts: DataFrame) -> DataFrame:
    """``lda_combined_lists`` as rows (notebook_id, term, score)."""
    return lda_combined_lists(counts).select("notebook_id", F.inline("terms"))


def top_of_lists(lists: DataFrame, keys: list[str], digits: int, limit: int = 30) -> DataFrame:
    """What ``top_terms`` gives for scores rounded to ``digits``, where a document's ``terms`` are one array: without a shuffle."""
    ordered = F.array_sort(F.transform("terms", lambda x: F.struct((-F.round(x["score"], digits)).alias("_s"), x["term"].alias("term"))))
    ranked = lists.select(*keys, F.posexplode(F.slice(ordered, 1, limit)).alias("_k", "_x"))
    return ranked.select(*keys, F.col("_x.term").alias("term"), (-F.col("_x._s")).alias("score"), (F.col("_k") + 1).cast("long").alias("rank"))
