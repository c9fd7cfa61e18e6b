"""Queries of the engine's own operators: (session, folder of tables) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions import code as C
from notemill.functions import lists as L
from notemill.functions import text as T
from notemill.functions.labels import DOMAINS
from notemill.functions.vectors import cosine
from notemill.operators import evaluate as E
from notemill.operators import importance as I
from notemill.operators import model as M
from notemill.operators import parts as P
from notemill.operators import ranking as R
from notemill.operators import salient as S
from notemill.operators import stats as X
from notemill.operators.current import current_rows
from notemill.operators.indexing import rank_within
from notemill.session import materialize, run_dir
from notemill.sources import notebooks as N
from notemill.sources import tables as W
from notemill.sources.files import write_files
from notemill.streaming.budget import trailing_sum

DOC = ["notebook_id", "part"]
METRICS = ["num_lines", "num_functions", "num_classes", "inheritance_depth", "cyclomatic_complexity", "narrative_size"]
# Reported mean precision by embedding and term type, for each part.
REPORTED = [
    ("BERT-BOW", 0.12, 0.12, 0.14, 0.10), ("BERT-LDA", 0.12, 0.10, 0.12, 0.10), ("BERT-TFIDF", 0.12, 0.10, 0.15, 0.10),
    ("GloVe-BOW", 0.06, 0.04, 0.04, 0.08), ("GloVe-LDA", 0.06, 0.10, 0.06, 0.10), ("GloVe-TFIDF", 0.08, 0.08, 0.05, 0.08),
    ("Word2Vec-BOW", 0.06, 0.06, 0.04, 0.06), ("Word2Vec-LDA", 0.06, 0.06, 0.06, 0.08), ("Word2Vec-TFIDF", 0.08, 0.08, 0.05, 0.06),
]
REPORTED_PARTS = ["all_contents", "code", "in_line_comment", "markdown_narrative"]
PART_LABELS = ["code", "comment", "markdown narrative", "all combined"]
#: Classes of the table of effects.
SHOWN = ["banking", "football", "oceanography", "radiology", "railways"]
TITLES = {"bow": "Words", "tfidf": "TF-IDF"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return P.part_texts(table(spark, folder, "nb_contents"))


def codes(spark: SparkSession, folder: str) -> DataFrame:
    """Current cleaned code of each notebook that has some."""
    return parts(spark, folder).where("part = 'code'").select("notebook_id", T.clean_text(F.col("text"), "code").alias("code"))


def counts(spark: SparkSession, folder: str) -> DataFrame:
    return S.term_counts(S.part_tokens(parts(spark, folder)), DOC)


def features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per notebook of the feature table: its variations share all features."""
    t = table(spark, folder, "code_complexity")
    measures = [c for c in t.columns if c not in ("notebook", "term_type", "embedding_type", "variation_idx", "base_notebook", "top1_domain")]
    label = F.min(F.when(F.col("top1_domain") != "unknown", F.col("top1_domain"))).alias("domain")
    return t.where("base_notebook is not null").groupBy(F.lower("base_notebook").alias("base_notebook")).agg(*[F.max(c).alias(c) for c in measures], label)


def q_part_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each part text before and after cleaning."""
    own = parts(spark, folder)
    return own.select(*DOC, T.count_lines(F.col("text")).alias("n_lines"), T.count_lines(P.clean_part(F.col("part"), F.col("text"))).alias("n_clean"))


def _new_folder(spark: SparkSession) -> str:
    return f"{run_dir(spark)}/{uuid.uuid4().hex}"


def q_file_type(spark: SparkSession, folder: str) -> DataFrame:
    """Part files written and found again: number and characters by the kind that their names tell."""
    own = parts(spark, folder).where("text <> ''")
    name = F.concat(F.lit("nb_"), F.when(F.col("part") == "narrative", "narrative_md").otherwise(F.col("part")))
    root = _new_folder(spark)
    write_files(own.select(F.concat_ws("/", F.col("notebook_id").cast("string"), F.concat(name, F.lit(".txt"))).alias("path"), F.col("text").alias("content")), root)
    found = N.read_part_files(spark, root).select(T.part_kind(F.col("stem")).alias("kind"), F.length("text").cast("long").alias("n_chars"))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def q_notebook_files(spark: SparkSession, folder: str) -> DataFrame:
    """Notebooks written as files, read two folders deep, parsed and rendered again: cells and text of each.

    Sources are texts and lists of lines in turn, as both occur on disk.
    """
    sources = F.transform(T.code_cells(F.col("text")), lambda c: c["source"])
    bare = F.transform(sources, lambda s, i: F.when(i + 1 < F.size(sources), F.regexp_replace(s, r"\n$", "")).otherwise(s))
    as_text = lambda s: F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", "")
    lines = lambda s: F.to_json(F.split(s, r"(?<=\n)"))
    cells = F.transform("bare", lambda s, i: F.concat(F.lit('{"cell_type":"code","source":'), F.when(i % 2 == 0, as_text(s)).otherwise(lines(s)), F.lit("}")))
    own = parts(spark, folder).where("part = 'code'").withColumn("bare", bare)
    notes = own.select(F.concat(F.pmod("notebook_id", F.lit(7)).cast("string"), F.lit("/n"), F.col("notebook_id").cast("string"), F.lit("/"), F.col("notebook_id").cast("string"), F.lit(".ipynb")).alias("path"), F.concat(F.lit('{"cells":['), F.array_join(cells, ","), F.lit("]}")).alias("content"))
    root = _new_folder(spark)
    write_files(notes, root)
    read = N.notebook_cells(N.read_notebooks(spark, root))
    stem = F.regexp_extract("path", r"([^/]+)\.ipynb$", 1).cast("long")
    n = read.groupBy(stem.alias("notebook_id")).agg(F.count("*").alias("n_cells"))
    rendered = P.render_parts(read).select(stem.alias("notebook_id"), F.md5("text").alias("digest"))
    return n.join(rendered, "notebook_id")


def q_metadata_files(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata files written, unreadable ones too, and read again: keywords of each notebook."""
    meta = current_rows(table(spark, folder, "kernel_metadata"), ["kernel_ref"], "scraped_at", ["keywords", "parse_error"])
    content = F.when(F.col("parse_error").isNotNull(), '{"keywords": ["a').otherwise(F.to_json(F.struct("keywords")))
    root = _new_folder(spark)
    write_files(meta.select(F.concat("kernel_ref", F.lit("/kernel-metadata.json")).alias("path"), content.alias("content")), root)
    read = N.read_metadata(spark, root)
    return read.select("account", "notebook", F.size("keywords").cast("long").alias("n"), F.array_join("keywords", "|").alias("keywords"))


def q_prediction_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions written as CSV with printed lists and read again."""
    root = _new_folder(spark)
    W.write_predictions(E.current_predictions(table(spark, folder, "domain_classification_results")).select("notebook", "part", "term_type", "embedding_type", "top_domains"), root)
    return W.read_predictions(spark, root).select("notebook", "part", "term_type", "embedding_type", F.array_join("top_domains", "|").alias("labels"))


def q_term_report(spark: SparkSession, folder: str) -> DataFrame:
    """Salient terms of whole notebooks written as reports and parsed back."""
    both = q_bow_combined(spark, folder).select("notebook_id", F.lit("bow").alias("method"), "term", F.col("n").cast("double").alias("score"), "rank")
    both = both.unionByName(q_tfidf_combined(spark, folder).select("notebook_id", F.lit("tfidf").alias("method"), "term", F.col("weight").alias("score"), "rank"))
    return W.parse_report(W.salient_report(both, TITLES), TITLES)


def q_error_log(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of unreadable metadata appended to a log twice: entries of each notebook."""
    errors = table(spark, folder, "kernel_metadata").where("parse_error is not null").select(F.col("kernel_ref").alias("ref"), F.col("parse_error").alias("error")).distinct()
    root = _new_folder(spark)
    for _ in range(2):
        W.append_errors(errors, root)
    return spark.read.csv(root, schema="ref string, error string", escape='"').groupBy("ref").agg(F.count("*").alias("n"), F.max("error").alias("last_error"))


def q_vector_files(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the domain labels written and read again; unknown ones have become zeros."""
    labels = _labels(spark).select(F.col("domain").alias("term"))
    root = _new_folder(spark)
    W.write_vectors(R.embed_terms(labels, _words(spark, folder, labels)).select(F.lit("label").alias("term_type"), F.lit("word2vec").alias("embed_type"), "term", "vec"), root)
    return W.read_vectors(spark, root).select("term", F.size("vec").cast("long").alias("width"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def q_bow_top30(spark: SparkSession, folder: str) -> DataFrame:
    return S.top_terms(counts(spark, folder), DOC, "n")


def q_part_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Part texts, and those of whole notebooks, by the names that predictions have for them."""
    own = parts(spark, folder)
    whole = own.select("notebook_id", F.lit("combined").alias("part")).distinct()
    return own.select("notebook_id", "part").unionByName(whole).groupBy(T.part_label(F.col("part")).alias("label")).agg(F.count("*").alias("n"))


def q_lemmas(spark: SparkSession, folder: str) -> DataFrame:
    """Verb forms among the terms and their lemmas, the terms themselves being the dictionary."""
    terms = counts(spark, folder).select("term")
    return S.lemma_table(terms, terms.withColumnRenamed("term", "word"))


def q_bow_lemmas(spark: SparkSession, folder: str) -> DataFrame:
    """Most frequent lemmas of each part."""
    own = S.part_tokens(parts(spark, folder), lemmas=materialize(q_lemmas(spark, folder)))
    return S.top_terms(S.retokenised(S.term_counts(own, DOC)), DOC, "n")


def q_bow_combined(spark: SparkSession, folder: str) -> DataFrame:
    return S.top_terms(S.term_counts(S.part_tokens(parts(spark, folder)), ["notebook_id"]), ["notebook_id"], "n")


def q_doc_freq(spark: SparkSession, folder: str) -> DataFrame:
    return S.document_frequency(counts(spark, folder))


def q_num_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Vocabulary size and number of topics of each notebook."""
    sizes = counts(spark, folder).groupBy("notebook_id").agg(F.countDistinct("term").alias("vocabulary"), F.countDistinct("part").alias("n_parts"))
    return sizes.select("*", S.topic_limit(F.col("vocabulary"), F.col("n_parts")).alias("topics"), S.topic_limit(F.col("vocabulary"), F.col("n_parts"), True).alias("topics_combined"))


def _vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return S.tfidf_vocabulary(S.retokenised(counts(spark, folder)), parts(spark, folder).agg(F.count("*").alias("n_docs")))


def q_tfidf_top30(spark: SparkSession, folder: str) -> DataFrame:
    weights = S.tfidf(counts(spark, folder), _vocabulary(spark, folder), DOC).withColumn("weight", F.round("weight", 9))
    return S.top_terms(weights, DOC, "weight")


def q_tfidf_combined(spark: SparkSession, folder: str) -> DataFrame:
    whole = S.term_counts(S.part_tokens(parts(spark, folder)), ["notebook_id"])
    weights = S.tfidf(whole, _vocabulary(spark, folder), ["notebook_id"]).withColumn("weight", F.round("weight", 9))
    return S.top_terms(weights, ["notebook_id"], "weight")


def q_lda_terms(spark: SparkSession, folder: str) -> DataFrame:
    return S.top_of_lists(S.lda_term_lists(counts(spark, folder)), DOC, 6)


def q_lda_combined(spark: SparkSession, folder: str) -> DataFrame:
    return S.top_of_lists(S.lda_combined_lists(counts(spark, folder)), ["notebook_id"], 6)


def q_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Comments by pattern, per cell and in order."""
    own = parts(spark, folder).where("part = 'code'").select("notebook_id", F.col("text").alias("code"))
    return P.cell_comments(own)


def q_cells(spark: SparkSession, folder: str) -> DataFrame:
    own = parts(spark, folder).where("part = 'code'")
    return own.select("notebook_id", F.size(T.code_cells(F.col("text"))).cast("long").alias("n_cells"))


def q_lib_usage(spark: SparkSession, folder: str) -> DataFrame:
    return codes(spark, folder).select("notebook_id", *C.library_flags(F.col("code")))


def q_tensor_ops_regex(spark: SparkSession, folder: str) -> DataFrame:
    return codes(spark, folder).select("notebook_id", *[C.tensor_op_count(F.col("code"), op).alias(f"n_{op}") for op in C.TENSOR_OPS])


def q_tensor_ops_ast(spark: SparkSession, folder: str) -> DataFrame:
    ops = codes(spark, folder).select("notebook_id", C.tensor_ops("code").alias("ops"))
    return ops.select("notebook_id", *[F.col("ops.flags")[k].alias(f"op_{op}") for k, op in enumerate(C.TENSOR_OPS)], "ops.num_tensor_ops")


def q_code_counts(spark: SparkSession, folder: str) -> DataFrame:
    code = F.col("code")
    return codes(spark, folder).select("notebook_id", T.count_lines(code).alias("num_lines"), C.count_functions(code).alias("num_functions"), C.count_classes(code).alias("num_classes"), C.cyclomatic(code).alias("cyclomatic_complexity"))


def q_inheritance(spark: SparkSession, folder: str) -> DataFrame:
    return codes(spark, folder).select("notebook_id", C.inheritance_depth("code").alias("inheritance_depth"))


def q_narrative_size(spark: SparkSession, folder: str) -> DataFrame:
    own = parts(spark, folder).where("part = 'narrative'")
    return own.select("notebook_id", T.count_lines(T.clean_text(F.col("text"), "narrative")).alias("narrative_size"))


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select((F.col("vec_id") % 40).alias("group_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


def q_vec_mean(spark: SparkSession, folder: str) -> DataFrame:
    means = R.vector_mean(_terms(spark, folder), ["label"], "vec")
    return means.select(F.col("label").cast("long").alias("label"), F.posexplode("vec").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 9).alias("x"))


def q_cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Labels ranked for groups of vectors, label centroids being the domains."""
    own = _terms(spark, folder)
    domains = R.vector_mean(own, ["label"], "vec").select(F.concat(F.lit("d"), F.col("label").cast("string")).alias("domain"), "vec")
    return R.rank_domains(own, domains, ["group_id"]).withColumn("score", F.round("score", 6))


def _labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in DOMAINS], "domain string")


def _words(spark: SparkSession, folder: str, terms: DataFrame) -> DataFrame:
    """Word vectors in place of a pretrained table: a word's row is told by a digest; some words have none."""
    e = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    total = e.agg(F.floor(F.count("*") * 1.1).alias("_n"))
    words = terms.select(F.explode(F.split(F.lower("term"), r"\s+")).alias("word")).distinct()
    number = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long")
    return words.crossJoin(F.broadcast(total)).select("word", (number % F.col("_n")).alias("vec_id")).join(e, "vec_id").select("word", "vec")


def q_domain_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship path: salient terms of each part, their vectors, the ten best of the domain labels."""
    terms = materialize(q_bow_top30(spark, folder).select(*DOC, "term"))
    labels = _labels(spark)
    words = _words(spark, folder, terms.select("term").unionAll(labels.select("domain")))
    return R.domains_of_terms(terms, labels, words, DOC).withColumn("score", F.round("score", 6))


def q_cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of every pair of label centroids."""
    means = R.vector_mean(_terms(spark, folder), ["label"], "vec").select(F.col("label").cast("long").alias("label"), "vec")
    a, b = means.toDF("first", "va"), means.toDF("second", "vb")
    return a.join(b, F.col("first") < F.col("second")).select("first", "second", F.round(cosine(F.col("va"), F.col("vb")), 9).alias("cosine"))


def q_pca(spark: SparkSession, folder: str) -> DataFrame:
    return R.principal_components(_terms(spark, folder), "vec").select("group_id", F.round(F.col("components")[0], 6).alias("x"), F.round(F.col("components")[1], 6).alias("y"))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    predictions = E.current_predictions(table(spark, folder, "domain_classification_results"))
    return E.evaluated(predictions, E.tags_of(table(spark, folder, "kernel_metadata")))


def q_precision_at_k(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).withColumn("p_at_k", F.round("p_at_k", 9))


def q_pk_rollups(spark: SparkSession, folder: str) -> DataFrame:
    return E.rollups(_scores(spark, folder)).withColumn("mean_p_at_k", F.round("mean_p_at_k", 9))


def q_pk_best5(spark: SparkSession, folder: str) -> DataFrame:
    mean = _scores(spark, folder).groupBy("part", "term_type", "embedding_type").agg(F.round(F.avg("p_at_k"), 9).alias("mean_p_at_k"))
    return mean.orderBy(F.desc_nulls_last("mean_p_at_k"), "part", "term_type", "embedding_type").limit(5)


def q_pk_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Mean precision by embedding and term type, with a column for each part."""
    labels = PART_LABELS
    wide = _scores(spark, folder).dropna(subset=["p_at_k"]).groupBy("embedding_type", "term_type").pivot("part", labels).agg(F.avg("p_at_k"))
    return wide.select("embedding_type", "term_type", *[F.round(F.col(f"`{x}`"), 9).alias(x.replace(" ", "_")) for x in labels]).orderBy("embedding_type", "term_type")


def q_missing_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted notebooks without metadata."""
    predicted = E.current_predictions(table(spark, folder, "domain_classification_results")).select("notebook").distinct()
    return predicted.join(E.tags_of(table(spark, folder, "kernel_metadata")), "notebook", "left_anti")


def q_tags_left(spark: SparkSession, folder: str) -> DataFrame:
    predicted = E.current_predictions(table(spark, folder, "domain_classification_results")).select("notebook").distinct()
    joined = predicted.join(E.tags_of(table(spark, folder, "kernel_metadata")), "notebook", "left")
    return joined.select("notebook", F.size(F.coalesce("tags", F.array().cast("array<string>"))).cast("long").alias("n_tags"))


def q_tag_top20(spark: SparkSession, folder: str) -> DataFrame:
    tags = E.tags_of(table(spark, folder, "kernel_metadata")).select(F.explode("tags").alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(20)


def q_unique_tags(spark: SparkSession, folder: str) -> DataFrame:
    return E.tags_of(table(spark, folder, "kernel_metadata")).select(F.explode("tags").alias("tag")).distinct()


def q_tag_status(spark: SparkSession, folder: str) -> DataFrame:
    """Notebooks with and without tags and the share of the former."""
    n = F.size("tags")
    return E.tags_of(table(spark, folder, "kernel_metadata")).agg(
        F.count_if(n > 0).alias("tagged"), F.count_if(n == 0).alias("untagged"), F.count("*").alias("total"), F.round(100.0 * F.count_if(n > 0) / F.count("*"), 6).alias("percent")
    )


def q_tag_histogram(spark: SparkSession, folder: str) -> DataFrame:
    sizes = E.tags_of(table(spark, folder, "kernel_metadata")).select(F.size("tags").cast("long").alias("n_tags"))
    return sizes.groupBy("n_tags").agg(F.count("*").alias("n")).orderBy("n_tags")


def q_tag_stats(spark: SparkSession, folder: str) -> DataFrame:
    sizes = E.tags_of(table(spark, folder, "kernel_metadata")).select(F.size("tags").cast("long").alias("n"))
    return sizes.agg(F.round(F.avg("n"), 9).alias("mean"), F.median("n").alias("median"), F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("zeros"))


def q_top_domains(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 labels that are first most often among combined parts."""
    own = E.combined_or_all(E.current_predictions(table(spark, folder, "domain_classification_results")))
    first = own.select(L.first_label(F.col("top_domains")).alias("domain"))
    return first.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(20)


def q_domain_by_type(spark: SparkSession, folder: str) -> DataFrame:
    own = E.current_predictions(table(spark, folder, "domain_classification_results"))
    first = own.select(L.first_label(F.col("top_domains")).alias("domain"), "embedding_type")
    return first.groupBy("domain").pivot("embedding_type", ["bert", "glove", "word2vec"]).count().na.fill(0)


def q_value_counts_min5(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "code_complexity").where("top1_domain is not null").groupBy("top1_domain").agg(F.count("*").alias("n")).where("n >= 5")


def q_variations(spark: SparkSession, folder: str) -> DataFrame:
    """Nine variations of each notebook from its combined predictions."""
    combined = E.current_predictions(table(spark, folder, "domain_classification_results")).where("part = 'all combined'")
    return E.variations(combined)


def q_feature_join(spark: SparkSession, folder: str) -> DataFrame:
    """Variations with the features of their notebook; notebooks without features drop out."""
    own = features(spark, folder).select(F.col("base_notebook").alias("notebook"), *METRICS)
    return q_variations(spark, folder).join(own, "notebook").select("notebook", "variation_idx", "domain", *[F.col(m).cast("long").alias(m) for m in METRICS])


def q_corr_matrix(spark: SparkSession, folder: str) -> DataFrame:
    own = features(spark, folder)
    pairs = X.correlations(own, METRICS)
    return pairs.withColumn("corr", F.round("corr", 6))


def q_uncorrelated(spark: SparkSession, folder: str) -> DataFrame:
    """Features left after correlated ones were dropped, with their variance inflation factors, largest first."""
    chosen = q_feature_selection(spark, folder).where("state <> 'correlated'")
    return chosen.select("feature", "vif").orderBy(F.desc_nulls_last("vif"), "feature")


def q_feature_selection(spark: SparkSession, folder: str) -> DataFrame:
    """What became of every candidate feature: kept, dropped as correlated, or dropped as inflated."""
    own = features(spark, folder)
    rows = M.selection(own, M.feature_columns(own))
    return spark.createDataFrame(rows, "feature string, state string, vif double").withColumn("vif", F.round("vif", 6))


def _effects(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics in the form of coefficients: mean standardised measures of each domain, its share as the intercept."""
    own = X.standardized(features(spark, folder).where("domain is not null").select("domain", *METRICS), METRICS)
    means = X.unpivot(own, ["domain"], METRICS).groupBy(F.col("domain").alias("class"), F.col("metric").alias("feature")).agg(F.round(F.avg("value"), 6).alias("coefficient"))
    shares = own.groupBy(F.col("domain").alias("class")).agg(F.lit("intercept").alias("feature"), F.count("*").cast("double").alias("coefficient"))
    return means.unionByName(shares).withColumn("is_significant", F.abs("coefficient") > 0.1)


def q_top_effects(spark: SparkSession, folder: str) -> DataFrame:
    return I.strongest(_effects(spark, folder), 3).select("class", "feature", "coefficient", "rank")


def q_busiest_classes(spark: SparkSession, folder: str) -> DataFrame:
    return I.busiest(_effects(spark, folder))


def q_effect_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Features by classes, what is missing filled with 0."""
    return I.pivot_first(_effects(spark, folder), SHOWN).na.fill(0.0)


def q_mean_std_text(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation as text, of the domains whose names begin alike."""
    own = features(spark, folder).where(F.col("domain").startswith("e-") | F.col("domain").startswith("music"))
    return own.groupBy("domain").agg(I.mean_and_deviation(F.avg("num_lines"), F.stddev_samp("num_lines"), 3).alias("num_lines"))


def _part_means(spark: SparkSession, folder: str) -> DataFrame:
    """Mean precision of each embedding and term type, a column for each part."""
    wide = _scores(spark, folder).groupBy("embedding_type", "term_type").pivot("part", PART_LABELS).agg(F.avg("p_at_k"))
    return wide.toDF("embedding_type", "term_type", *REPORTED_PARTS[1:], REPORTED_PARTS[0])


def q_paired_t(spark: SparkSession, folder: str) -> DataFrame:
    """Paired tests between parts over the kinds of embeddings and terms."""
    tests = X.paired_tests(_part_means(spark, folder), REPORTED_PARTS)
    return tests.select("first", "second", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("t", 4).alias("t"), "df")


def _reported_long(spark: SparkSession) -> DataFrame:
    reported = spark.createDataFrame(REPORTED, "kind string, " + ", ".join(f"{c} double" for c in REPORTED_PARTS))
    split = F.split("kind", "-")
    return X.unpivot(reported.withColumn("embedding", split[0]).withColumn("term_type", split[1]), ["embedding", "term_type"], REPORTED_PARTS)


def q_welch_t(spark: SparkSession, folder: str) -> DataFrame:
    tests = [X.welch_tests(_reported_long(spark), g, "value") for g in ("embedding", "term_type")]
    both = tests[0].unionByName(tests[1])
    return both.select("first", "second", *[F.round(c, 6).alias(c) for c in ("mean_diff", "t", "df")])


def q_welch_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Tests between embedding types and between term types within each part."""
    own = _scores(spark, folder)
    both = [X.welch_tests(own, g, "p_at_k", ["part"]) for g in ("embedding_type", "term_type")]
    return both[0].unionByName(both[1]).select("part", "first", "second", *[F.round(c, 6).alias(c) for c in ("mean_diff", "t", "df")])


def q_welch_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Welch tests of code sizes between domains."""
    own = features(spark, folder).withColumn("v", F.col("num_lines").cast("double"))
    return X.welch_tests(own, "domain", "v").select("first", "second", *[F.round(c, 6).alias(c) for c in ("mean_diff", "t", "df")])


def q_welch_p(spark: SparkSession, folder: str) -> DataFrame:
    """Welch tests of code sizes between domains, with p-values."""
    return X.welch_tests(features(spark, folder).withColumn("v", F.col("num_lines").cast("double")), "domain", "v").select("first", "second", F.round("t", 6).alias("t"), F.round("p", 9).alias("p"))


def q_mean_std(spark: SparkSession, folder: str) -> DataFrame:
    long = X.unpivot(features(spark, folder), ["domain"], METRICS)
    return long.groupBy("domain", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))


def q_row_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over the parts of each kind of embedding and term, parts without a score left out."""
    known = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in REPORTED_PARTS[1:]), F.when(F.col(REPORTED_PARTS[0]).isNotNull(), 1).otherwise(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in REPORTED_PARTS[1:]), F.coalesce(REPORTED_PARTS[0], F.lit(0.0)))
    return _part_means(spark, folder).select("embedding_type", "term_type", F.round(F.try_divide(total, known), 9).alias("mean"))


def q_boxplot(spark: SparkSession, folder: str) -> DataFrame:
    own = features(spark, folder).where("domain is not null")
    return X.quartiles(own, ["domain"], METRICS)


def q_iqr_filter(spark: SparkSession, folder: str) -> DataFrame:
    own = features(spark, folder)
    return X.drop_outliers(own, METRICS).select("base_notebook", *[F.col(m).cast("long").alias(m) for m in METRICS])


def q_standardize(spark: SparkSession, folder: str) -> DataFrame:
    own = X.standardized(features(spark, folder).select("base_notebook", *METRICS), METRICS)
    return own.select("base_notebook", *[F.round(m, 6).alias(m) for m in METRICS])


def _labelled(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    own = features(spark, folder)
    columns = M.feature_columns(own)
    return M.stratified_split(M.frequent_classes(own, "domain"), "domain", "base_notebook"), columns


def q_split(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each class in both parts of the stratified split."""
    split, _ = _labelled(spark, folder)
    return split.groupBy("domain").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


def q_logreg(spark: SparkSession, folder: str) -> DataFrame:
    """Report of the multinomial model on the held-out rows."""
    split, candidates = _labelled(spark, folder)
    columns = M.selected(split, candidates)
    scaled = X.standardized(split.select("domain", "is_test", *columns), columns)
    model, classes = M.fit_multinomial(scaled.where("not is_test"), columns, "domain")
    report = M.classification_report(M.predict(model, classes, columns, scaled.where("is_test")), "domain", "predicted")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def q_confusion_report(spark: SparkSession, folder: str) -> DataFrame:
    """Report on first labels of two embeddings, one taken for the truth."""
    own = E.current_predictions(table(spark, folder, "domain_classification_results")).where("part = 'all combined' and term_type = 'bow'")
    label = own.select("notebook", "embedding_type", F.get("top_domains", F.lit(0)).alias("label")).where("label is not null")
    a = label.where("embedding_type = 'bert'").select("notebook", F.col("label").alias("truth"))
    b = label.where("embedding_type = 'glove'").select("notebook", F.col("label").alias("predicted"))
    report = M.classification_report(a.join(b, "notebook"), "truth", "predicted")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def q_permutation(spark: SparkSession, folder: str) -> DataFrame:
    """Significance of the features left after selection, for every class of the training rows."""
    split, columns = _labelled(spark, folder)
    own = split.na.fill(0, columns)
    kept = M.selected(own, columns)
    train = own.where("not is_test").select("domain", *kept)
    classes = [r["domain"] for r in train.select("domain").distinct().orderBy("domain").collect()]
    return M.permutation_test(X.standardized(train, kept), kept, "domain", classes)


def q_token_window(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of values over the 60 seconds before each event, its own included."""
    e = table(spark, folder, "events")
    return trailing_sum(e.select("event_id", "ts", "value"), "ts", "value", 60).select("event_id", F.round("trailing", 6).alias("trailing"))


def q_token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.round(T.token_estimate(F.col("text")), 6).alias("tokens"))


def q_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts for the judge: each notebook's best combined domain with the texts of its parts."""
    nb = current_rows(table(spark, folder, "nb_contents"), ["notebook_id"], "scraped_at", ["notebook", "code", "markdown_narrative"])
    best = E.current_predictions(table(spark, folder, "domain_classification_results")).where("part = 'all combined' and term_type = 'tfidf' and embedding_type = 'bert'")
    best = best.select(F.col("notebook").alias("_name"), L.first_label(F.col("top_domains")).alias("domain"))
    joined = nb.withColumn("_name", E.notebook_name(F.col("notebook"))).join(best, "_name", "left")
    text = T.prompt(F.coalesce("domain", F.lit("Unknown")), F.col("code"), F.col("markdown_narrative"))
    return joined.select("notebook_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("digest"))


def q_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Page of 20 kernels that each kernel of an account is on."""
    k = table(spark, folder, "kernels").select("kernel_ref").distinct().withColumn("account", F.substring_index("kernel_ref", "/", 1))
    return rank_within(k, "account", ["kernel_ref"], "n").select("kernel_ref", F.floor(F.col("n") / 20).alias("page"))


def q_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by the categories of relevance and specificity, their texts taken for answers of a judge."""
    d = table(spark, folder, "documents")
    return d.groupBy(T.relevance(F.col("text")).alias("relevance"), T.specificity(F.col("text")).alias("specificity")).agg(F.count("*").alias("n"))


def q_printed_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of predictions printed and read again, with their first label."""
    own = table(spark, folder, "domain_classification_results").select("top_domains").distinct()
    items = L.parse_list(L.print_list(F.col("top_domains")))
    return own.select(F.array_join(items, "|").alias("items"), L.first_label(items).alias("first"))


def q_split_ref(spark: SparkSession, folder: str) -> DataFrame:
    k = table(spark, folder, "kernels").select("kernel_ref").distinct()
    own = T.split_ref(F.col("kernel_ref"))
    return k.select("kernel_ref", own["user"].alias("account"), own["slug"].alias("slug"))


def q_sample_size(spark: SparkSession, folder: str) -> DataFrame:
    """Sample that each account's kernels need for a margin of error."""
    k = table(spark, folder, "kernels").groupBy(F.substring_index("kernel_ref", "/", 1).alias("account")).agg(F.countDistinct("kernel_ref").alias("population"))
    return k.select("account", "population", X.sample_size_of(F.col("population")).alias("sample"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("q_")}
