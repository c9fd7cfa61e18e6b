"""SQL that gives the results of the queries in ``catalogue``, for those that SQL can express."""

from __future__ import annotations

from notemill.functions.code import LIBRARIES, TENSOR_LIBRARIES, TENSOR_OPS
from notemill.functions.stopwords import ENGLISH
from notemill.functions.labels import DOMAINS
from notemill.plans.catalogue import METRICS, PART_LABELS, REPORTED, REPORTED_PARTS, SHOWN

WS = r"[\s\x{00a0}\x{3000}]"


def lit(x: object) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def lines(x: str) -> str:
    return rf"string_split_regex(coalesce({x}, ''), '\r\n|\n|\r')"


def size(x: str) -> str:
    """Number of lines that are not blank."""
    return f"len(list_filter({lines(x)}, lambda l: {strip('l')} <> ''))"


def notebook(x: str) -> str:
    bare = f"regexp_replace({strip(f'lower({x})')}, '^.*/', '')"
    return rf"regexp_replace(regexp_replace({bare}, '\.ipynb$', ''), '_var\d+$', '')"


CUR = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {time} DESC NULLS LAST) AS rn FROM {table}) WHERE rn = 1"
FRAMES = {"comment": ("Comments extracted from:", "Comments from Code Cell"), "narrative": ("Markdown Narrative from:", "Markdown Cell #")}


def _framed(kind: str) -> str:
    head, cell = FRAMES[kind]
    body = f"CASE WHEN list_position(list_transform(ls, lambda l: contains(l, '{head}') OR contains(l, '{'=' * 17}')), false) > 0 THEN ls[list_position(list_transform(ls, lambda l: contains(l, '{head}') OR contains(l, '{'=' * 17}')), false):] ELSE [] END"
    kept = f"list_filter({body}, lambda l: {strip('l')} <> '' AND NOT contains(l, '{'-' * 30}') AND NOT starts_with(l, '{cell}'))"
    if kind == "comment":
        kept = f"list_transform({kept}, lambda l: regexp_replace(l, '^{WS}*-{WS}*', ''))"
    return f"list_filter(list_transform({kept}, lambda l: {strip('l')}), lambda l: l <> '')"


_UNHEADED = r"regexp_replace(l, '^Content of code cell #\d+:', '')"
_CODE = f"list_filter(list_transform(ls, lambda l: {strip(_UNHEADED)}), lambda l: l <> '')"
PARTS = f"""nb AS ({CUR.format(key="notebook_id", time="scraped_at", table="nb_contents")}),
parts AS (
  SELECT notebook_id, 'code' AS part, code AS text FROM nb WHERE code IS NOT NULL
  UNION ALL SELECT notebook_id, 'comment', in_line_comment FROM nb WHERE in_line_comment IS NOT NULL
  UNION ALL SELECT notebook_id, 'narrative', markdown_narrative FROM nb WHERE markdown_narrative IS NOT NULL
),
lined AS (SELECT *, {lines("text")} AS ls FROM parts),
cleaned AS (
  SELECT notebook_id, part, text, array_to_string(CASE part WHEN 'code' THEN {_CODE} WHEN 'comment' THEN {_framed("comment")} ELSE {_framed("narrative")} END, chr(10)) AS clean FROM lined
),
codes AS (SELECT notebook_id, clean AS code FROM cleaned WHERE part = 'code')"""
STOP = "[" + ", ".join(lit(w) for w in ENGLISH) + "]"
TOKENS = PARTS + rf""",
tokens AS (
  SELECT notebook_id, part, unnest(list_filter(regexp_extract_all(lower(clean), '[\p{{L}}_]+'),
    lambda w: length(w) BETWEEN 4 AND 15 AND NOT starts_with(w, '_') AND NOT list_contains({STOP}, w))) AS term FROM cleaned
),
counts AS (SELECT notebook_id, part, term, count(*) AS n FROM tokens GROUP BY ALL),
whole AS (SELECT notebook_id, term, count(*) AS n FROM tokens GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(n)::BIGINT AS ctf FROM counts GROUP BY 1),
total AS (SELECT count(*) AS n_docs FROM parts),
vocabulary AS (
  SELECT term, ln((1 + n_docs) / (1 + df)) + 1 AS idf FROM df, total WHERE df >= 2 AND df <= 0.95 * n_docs ORDER BY ctf DESC, term LIMIT 5000
)"""


def _lemmas() -> str:
    from notemill.operators.salient import VERB_ENDINGS

    forms = " UNION ALL ".join(["SELECT term, 0 AS k, term AS word FROM vocab", *[f"SELECT term, {k + 1}, left(term, length(term) - {len(a)}) || '{b}' FROM vocab WHERE ends_with(term, '{a}') AND length(term) > {len(a)}" for k, (a, b) in enumerate(VERB_ENDINGS)]])
    return f"vocab AS (SELECT DISTINCT term FROM counts), forms AS ({forms}), lemmas AS (SELECT term, lemma FROM (SELECT term, word AS lemma, row_number() OVER (PARTITION BY term ORDER BY length(word), k) AS r FROM forms WHERE word IN (SELECT term FROM vocab)) WHERE r = 1 AND lemma <> term)"


def ranked(table: str, keys: str, score: str, limit: int = 30) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, term) AS rank FROM {table}) WHERE rank <= {limit}"


def _tfidf(counts: str, keys: str) -> str:
    return f"""(SELECT {keys}, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY {keys})), 9) AS weight
    FROM (SELECT c.*, n * idf AS w FROM {counts} c JOIN vocabulary USING (term)))"""


def count(x: str, pattern: str, flags: str = "") -> str:
    return f"len(regexp_extract_all({x}, '{flags}{pattern}'))"


FUNCTION, CLASS = r"def\s+\w+\s*\(", r"class\s+\w+\s*[(:)]"
DECISIONS = r"\b(?:if|for|while|and|or|elif|catch|except|case|with)\b"
KEYS = "notebook, part, term_type, embedding_type"
PREDICTIONS = f"""named AS (SELECT * REPLACE ({notebook("notebook")} AS notebook) FROM domain_classification_results WHERE notebook IS NOT NULL AND part IS NOT NULL AND term_type IS NOT NULL AND embedding_type IS NOT NULL),
predictions AS ({CUR.format(key=KEYS, time="classified_at", table="named")})"""
TAGS = rf"""meta AS ({CUR.format(key="kernel_ref", time="scraped_at", table="kernel_metadata")}),
tags AS (SELECT split_part(kernel_ref, '/', 2) AS notebook,
  list_distinct(list_filter(list_transform(list_filter(coalesce(keywords, []), lambda k: k IS NOT NULL), lambda k: {strip(f"regexp_replace(lower(k), '[{WS[1:-1]}_-]+', ' ', 'g')")}), lambda k: k <> '')) AS tags FROM meta)"""
SCORES = f"""WITH {PREDICTIONS}, {TAGS},
joined AS (SELECT {KEYS}, list_transform(top_domains, lambda d: regexp_replace(lower(d), '[{WS[1:-1]}_-]+', ' ', 'g')) AS top, coalesce(tags, []) AS tags FROM predictions LEFT JOIN tags USING (notebook)),
scores AS (SELECT {KEYS}, CASE WHEN len(tags) < 3 THEN NULL WHEN top IS NULL OR len(top) = 0 THEN 0.0
  ELSE len(list_filter(top[1:3], lambda d: list_contains(tags, d)))::DOUBLE / least(3, len(top)) END AS p_at_k FROM joined)"""
COMBINED = "(SELECT * FROM predictions WHERE part = 'all combined' OR NOT EXISTS (SELECT 1 FROM predictions WHERE part = 'all combined'))"
VARIATIONS = f"""WITH {PREDICTIONS},
numbered AS (SELECT notebook, term_type, embedding_type, top_domains[1] AS domain, row_number() OVER (PARTITION BY notebook ORDER BY term_type, embedding_type) - 1 AS variation_idx
  FROM predictions WHERE part = 'all combined'),
per AS (SELECT notebook, count(*) AS n, max(CASE WHEN variation_idx = 0 THEN domain END) AS first FROM numbered GROUP BY 1),
padded AS (SELECT notebook, unnest(range(n, 9)) AS variation_idx, first FROM per WHERE n < 9),
variations AS (
  SELECT notebook, variation_idx, term_type, embedding_type, domain FROM numbered WHERE domain IS NOT NULL
  UNION ALL SELECT notebook, variation_idx, 'padded_' || variation_idx, 'padded', coalesce(first, 'unknown') FROM padded
)"""
FEATURES = "SELECT lower(base_notebook) AS base_notebook, " + ", ".join(f"max({m}) AS {m}" for m in METRICS) + ", min(CASE WHEN top1_domain <> 'unknown' THEN top1_domain END) AS domain FROM code_complexity WHERE base_notebook IS NOT NULL GROUP BY 1"
LONG = f"long AS (SELECT domain, metric, value::DOUBLE AS value FROM (UNPIVOT (SELECT domain, {', '.join(f'{m}::DOUBLE AS {m}' for m in METRICS)} FROM features) ON {', '.join(METRICS)} INTO NAME metric VALUE value))"
VECTORS = "vectors AS (SELECT vec_id, label, vec_id % 40 AS group_id, embedding::DOUBLE[64] AS vec FROM embeddings)"
MEANS = """means AS (SELECT label, list(m ORDER BY i)::DOUBLE[64] AS vec FROM (SELECT label, i, avg(vec[i]) AS m FROM vectors, range(1, 65) t(i) GROUP BY ALL) GROUP BY 1)"""
def words_of(terms: str) -> str:
    """CTEs that give the rows of ``terms`` (term) vectors, ``{name}_v`` (term, vec), by digests of their words."""
    return f"""wanted AS (SELECT DISTINCT term FROM {terms}), split AS (SELECT term, unnest(string_split_regex(lower(term), '\\s+')) AS word FROM wanted),
total_v AS (SELECT floor(count(*) * 1.1)::BIGINT AS m FROM embeddings),
word_v AS (SELECT word, vec FROM (SELECT word, ('0x' || substr(md5(word), 1, 8))::BIGINT % m AS vec_id FROM (SELECT DISTINCT word FROM split), total_v) JOIN vectors USING (vec_id)),
term_v AS (SELECT term, list(x ORDER BY i)::DOUBLE[64] AS vec FROM (SELECT term, i, avg(vec[i]) AS x FROM split JOIN word_v USING (word), range(1, 65) t(i) GROUP BY ALL) GROUP BY 1)"""


LABELS = "labels(term) AS (VALUES " + ", ".join(f"({lit(x)})" for x in DOMAINS) + ")"
PART_MEANS = "means AS (SELECT embedding_type, term_type, " + ", ".join(f"avg(p_at_k) FILTER (part = '{p}') AS {c}" for p, c in zip(PART_LABELS, [*REPORTED_PARTS[1:], REPORTED_PARTS[0]], strict=True)) + " FROM scores GROUP BY 1, 2)"
REPORT = "reported(kind, " + ", ".join(REPORTED_PARTS) + ") AS (VALUES " + ", ".join(f"({', '.join(lit(x) for x in row)})" for row in REPORTED) + ")"
WELCH = f"""{REPORT}, long AS (SELECT split_part(kind, '-', 1) AS embedding, split_part(kind, '-', 2) AS term_type, value::DOUBLE AS value FROM (UNPIVOT reported ON {", ".join(REPORTED_PARTS)} INTO NAME metric VALUE value)),
groups AS (SELECT 1 AS k, embedding AS g, value FROM long UNION ALL SELECT 2, term_type, value FROM long),
s AS (SELECT k, g, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM groups GROUP BY ALL)
SELECT a.g AS first, b.g AS second, round(a.m - b.m, 6) AS mean_diff, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t,
  round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 6) AS df
FROM s a JOIN s b ON a.k = b.k AND a.g < b.g"""


def welch(groups: str, keys: str = "") -> str:
    """Welch tests of the rows of ``groups`` (keys, g, value)."""
    own = "".join(f"a.{k}, " for k in keys.split()) if keys else ""
    same = "".join(f"a.{k} = b.{k} AND " for k in keys.split())
    return f"""s AS (SELECT {", ".join([*keys.split(), "g"])}, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM {groups} WHERE value IS NOT NULL AND g IS NOT NULL GROUP BY ALL)
SELECT {own}a.g AS first, b.g AS second, round(a.m - b.m, 6) AS mean_diff, round((a.m - b.m) / nullif(sqrt(a.v / a.n + b.v / b.n), 0), 6) AS t,
  round(pow(a.v / a.n + b.v / b.n, 2) / nullif(pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1), 0), 6) AS df
FROM s a JOIN s b ON {same}a.g < b.g WHERE a.n > 1 AND b.n > 1"""


def _effects() -> str:
    moments = ", ".join(f"avg({m}) AS m_{m}, stddev_pop({m}) AS s_{m}" for m in METRICS)
    means = " UNION ALL ".join(f"SELECT domain AS class, '{m}' AS feature, round(avg(({m} - m_{m}) / CASE WHEN s_{m} > 0 THEN s_{m} ELSE 1 END), 6) AS coefficient FROM f, moments GROUP BY 1" for m in METRICS)
    return f"WITH features AS ({FEATURES}), f AS (SELECT * FROM features WHERE domain IS NOT NULL), moments AS (SELECT {moments} FROM f), effects AS ({means}), strong AS (SELECT * FROM effects WHERE abs(coefficient) > 0.1)"


#: Depth along every way through the bases of a notebook's classes; a class that is on the way already ends it.
_DEPTH = r"""
defs AS (SELECT notebook_id, generate_subscripts(n, 1) AS k, unnest(n) AS name, unnest(b) AS listed FROM (
  SELECT notebook_id, regexp_extract_all(code, 'class\s+(\w+)\s*\((.*?)\):', 1) AS n, regexp_extract_all(code, 'class\s+(\w+)\s*\((.*?)\):', 2) AS b FROM codes)),
latest AS (SELECT notebook_id, name, arg_max(listed, k) AS listed FROM defs GROUP BY 1, 2),
bases AS (SELECT notebook_id, name, trim(unnest(string_split(listed, ','))) AS base FROM latest),
ways(notebook_id, node, seen, depth) AS (
  SELECT notebook_id, name, [name], 1 FROM latest
  UNION ALL
  SELECT w.notebook_id, CASE WHEN l.name IS NOT NULL AND NOT list_contains(w.seen, b.base) THEN b.base END, list_append(w.seen, b.base), w.depth + CASE WHEN list_contains(w.seen, b.base) THEN 0 ELSE 1 END
  FROM ways w JOIN bases b ON b.notebook_id = w.notebook_id AND b.name = w.node LEFT JOIN latest l ON l.notebook_id = w.notebook_id AND l.name = b.base
)"""


def _iqr() -> str:
    steps = [f"features AS ({FEATURES})", "s0 AS (SELECT * FROM features)"]
    for k, m in enumerate(METRICS):
        steps.append(f"q{k} AS (SELECT quantile_cont({m}, 0.25) AS a, quantile_cont({m}, 0.75) AS b FROM s{k})")
        steps.append(f"s{k + 1} AS (SELECT s{k}.* FROM s{k}, q{k} WHERE {m} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))")
    return f"WITH {', '.join(steps)} SELECT base_notebook, {', '.join(f'{m}::BIGINT AS {m}' for m in METRICS)} FROM s{len(METRICS)}"


def _flags() -> str:
    found = r"list_transform(list_concat(regexp_extract_all(code, 'import\s+(\w+)', 1), regexp_extract_all(code, 'from\s+(\w+)(?:\.\w+)?\s+import', 1)), lambda x: lower(x))"
    has = lambda x, alias: f"list_contains(names, '{x}')" + (f" OR list_contains(names, '{alias}')" if alias else "")
    libs = [f"({has(x, 'torch' if x == 'pytorch' else '')})::BIGINT AS lib_{x}" for x in LIBRARIES]
    libs += [f"({has(x, 'pytorch' if x == 'torch' else '')})::BIGINT AS tensor_lib_{x}" for x in TENSOR_LIBRARIES]
    return f"WITH {PARTS}, found AS (SELECT notebook_id, {found} AS names FROM codes) SELECT notebook_id, {', '.join(libs)} FROM found"


def _report() -> str:
    return f"""WITH {PREDICTIONS},
own AS (SELECT notebook, embedding_type, top_domains[1] AS label FROM predictions WHERE part = 'all combined' AND term_type = 'bow' AND top_domains[1] IS NOT NULL),
pairs AS (SELECT a.label AS truth, b.label AS predicted FROM own a JOIN own b USING (notebook) WHERE a.embedding_type = 'bert' AND b.embedding_type = 'glove'),
r AS (SELECT truth AS class, count(*) AS support, count(*) FILTER (truth = predicted) AS hit FROM pairs GROUP BY 1),
g AS (SELECT predicted AS class, count(*) AS given FROM pairs GROUP BY 1),
s AS (SELECT class, support, CASE WHEN coalesce(given, 0) = 0 THEN 0.0 ELSE hit / given END AS precision, hit / support AS recall FROM r LEFT JOIN g USING (class)),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM s)
SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f
UNION ALL SELECT 'macro', sum(support)::BIGINT, round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM f"""


def oracle_sql() -> dict[str, str]:
    cells = r"(SELECT notebook_id, unnest(string_split(regexp_replace(text, 'Content of code cell #(\d+):', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:]) AS c FROM parts WHERE part = 'code')"
    comments = rf"list_filter(list_transform(regexp_extract_all(c[position(chr(2) IN c) + 1:], '(?m)#\s*(.*?)$', 1), lambda x: {strip('x')}), lambda x: x <> '')"
    title = lambda name, x: f"CASE WHEN coalesce({x}, '') <> '' THEN '{name}:' || chr(10) || CASE WHEN length({x}) > 1500 THEN left({x}, 1500) || '...' ELSE {x} END END"
    prompt = f"concat_ws(chr(10) || chr(10), 'Proposed domain: ' || coalesce(domain, 'Unknown'), {title('Code', 'code')}, {title('Narrative', 'markdown_narrative')}, 'How relevant and how specific is the proposed domain for this notebook?')"
    has = lambda *words: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"
    moments = ", ".join(f"avg({m}) AS m_{m}, stddev_pop({m}) AS s_{m}" for m in METRICS)
    pairs = [(a, b) for k, a in enumerate(METRICS) for b in METRICS[k + 1 :]]
    tests = [(a, b) for k, a in enumerate(REPORTED_PARTS) for b in REPORTED_PARTS[k + 1 :]]
    return {
        "q_part_lines": f"WITH {PARTS} SELECT notebook_id, part, {size('text')} AS n_lines, {size('clean')} AS n_clean FROM cleaned",
        "q_file_type": f"WITH {PARTS} SELECT part AS kind, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM parts WHERE text <> '' GROUP BY 1",
        "q_notebook_files": f"WITH {PARTS}, c AS (SELECT notebook_id, {count('text', r'Content of code cell #\d+:')} AS n_cells, md5(chr(10) || text[position('Content of code cell #' IN text):]) AS digest FROM parts WHERE part = 'code') SELECT * FROM c WHERE n_cells > 0",
        "q_metadata_files": f"WITH {TAGS} SELECT split_part(kernel_ref, '/', 1) AS account, split_part(kernel_ref, '/', 2) AS notebook, CASE WHEN parse_error IS NOT NULL THEN 0 ELSE len(coalesce(keywords, [])) END AS n, CASE WHEN parse_error IS NOT NULL THEN '' ELSE array_to_string(list_filter(coalesce(keywords, []), lambda k: k IS NOT NULL), '|') END AS keywords FROM meta",
        "q_prediction_csv": f"WITH {PREDICTIONS} SELECT {KEYS}, coalesce(array_to_string(top_domains, '|'), '') AS labels FROM predictions",
        "q_term_report": f"WITH {TOKENS} SELECT notebook_id, 'bow' AS method, term, rank FROM ({ranked('whole', 'notebook_id', 'n')}) UNION ALL SELECT notebook_id, 'tfidf', term, rank FROM ({ranked(_tfidf('whole', 'notebook_id'), 'notebook_id', 'weight')})",
        "q_error_log": "SELECT kernel_ref AS ref, 2 * count(DISTINCT parse_error) AS n, max(parse_error) AS last_error FROM kernel_metadata WHERE parse_error IS NOT NULL GROUP BY 1",
        "q_vector_files": f"WITH {VECTORS}, {LABELS}, {words_of('labels')} SELECT term, CASE WHEN vec IS NULL THEN 300 ELSE 64 END::BIGINT AS width, round(coalesce(list_sum(vec::DOUBLE[]), 0), 6) AS total FROM labels LEFT JOIN term_v USING (term)",
        "q_domain_rank": f"""WITH {TOKENS}, {VECTORS}, {LABELS}, bow AS ({ranked('counts', 'notebook_id, part', 'n')}), terms AS (SELECT term FROM bow UNION ALL SELECT term FROM labels), {words_of('terms')},
cosines AS (SELECT t.term, d.term AS domain, greatest(0, array_cosine_similarity(t.vec, d.vec)) AS c FROM term_v t, term_v d WHERE d.term IN (SELECT term FROM labels)),
sums AS (SELECT notebook_id, part, domain, sum(c) AS score FROM bow JOIN cosines USING (term) GROUP BY ALL)
SELECT notebook_id, part, domain, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY notebook_id, part ORDER BY round(score, 9) DESC, domain) AS rank FROM sums) WHERE rank <= 10""",
        "q_inheritance": f"WITH RECURSIVE {PARTS}, {_DEPTH} SELECT notebook_id, coalesce(max(depth), 0)::BIGINT AS inheritance_depth FROM codes LEFT JOIN ways USING (notebook_id) GROUP BY 1",
        "q_top_effects": f"{_effects()} SELECT class, feature, coefficient, rank FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY abs(coefficient) DESC, feature) AS rank FROM strong) WHERE rank <= 3",
        "q_busiest_classes": f"{_effects()} SELECT class, count(*) AS n FROM strong GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
        "q_effect_pivot": f"{_effects()} SELECT feature, " + ", ".join(f"coalesce(max(coefficient) FILTER (class = '{c}'), 0.0) AS {c}" for c in SHOWN) + f" FROM strong WHERE class IN ({', '.join(map(lit, SHOWN))}) GROUP BY 1",
        "q_mean_std_text": f"WITH features AS ({FEATURES}) SELECT domain, printf('%.3f', round(avg(num_lines), 3)) || CASE WHEN stddev_samp(num_lines) IS NULL THEN '' ELSE ' ± ' || printf('%.3f', round(stddev_samp(num_lines), 3)) END AS num_lines FROM features WHERE starts_with(domain, 'e-') OR starts_with(domain, 'music') GROUP BY 1",
        "q_welch_parts": f"{SCORES}, groups AS (SELECT part, 1 AS k, embedding_type AS g, p_at_k AS value FROM scores UNION ALL SELECT part, 2, term_type, p_at_k FROM scores), {welch('groups', 'part k').replace('SELECT a.part, a.k, ', 'SELECT a.part, ')}",
        "q_welch_domains": f"WITH features AS ({FEATURES}), groups AS (SELECT domain AS g, num_lines::DOUBLE AS value FROM features), {welch('groups')}",
        "q_bow_top30": f"WITH {TOKENS} {ranked('counts', 'notebook_id, part', 'n')}",
        "q_part_labels": f"WITH {PARTS} SELECT CASE part WHEN 'narrative' THEN 'markdown narrative' ELSE part END AS label, count(*) AS n FROM parts GROUP BY 1 UNION ALL SELECT 'all combined', count(DISTINCT notebook_id) FROM parts",
        "q_lemmas": f"WITH {TOKENS}, {_lemmas()} SELECT term, lemma FROM lemmas",
        "q_bow_lemmas": f"WITH {TOKENS}, {_lemmas()}, lemmatised AS (SELECT notebook_id, part, coalesce(lemma, term) AS term, sum(n)::BIGINT AS n FROM counts LEFT JOIN lemmas USING (term) WHERE NOT list_contains({STOP}, coalesce(lemma, term)) GROUP BY 1, 2, 3) {ranked('lemmatised', 'notebook_id, part', 'n')}",
        "q_bow_combined": f"WITH {TOKENS} {ranked('whole', 'notebook_id', 'n')}",
        "q_doc_freq": f"WITH {TOKENS} SELECT * FROM df",
        "q_num_topics": f"WITH {TOKENS}, s AS (SELECT notebook_id, count(DISTINCT term) AS vocabulary, count(DISTINCT part) AS n_parts FROM counts GROUP BY 1) SELECT *, least(10, greatest(1, vocabulary // 5, n_parts // 2)) AS topics, least(5, greatest(1, vocabulary // 10)) AS topics_combined FROM s",
        "q_tfidf_top30": f"WITH {TOKENS} {ranked(_tfidf('counts', 'notebook_id, part'), 'notebook_id, part', 'weight')}",
        "q_tfidf_combined": f"WITH {TOKENS} {ranked(_tfidf('whole', 'notebook_id'), 'notebook_id', 'weight')}",
        "q_comments": f"WITH {PARTS}, f AS (SELECT notebook_id, split_part(c, chr(2), 1)::BIGINT AS cell, {comments} AS cs FROM {cells}) SELECT notebook_id, cell, generate_subscripts(cs, 1) - 1 AS pos, unnest(cs) AS comment FROM f",
        "q_cells": rf"WITH {PARTS} SELECT notebook_id, {count('text', r'Content of code cell #\d+:')} AS n_cells FROM parts WHERE part = 'code'",
        "q_lib_usage": _flags(),
        "q_tensor_ops_regex": f"WITH {PARTS} SELECT notebook_id, " + ", ".join(" + ".join(count("code", p, "(?i)") for p in (rf"\b{op}\(", rf"\.{op}\(", rf"\b{op}_")) + f" AS n_{op}" for op in TENSOR_OPS) + " FROM codes",
        "q_code_counts": f"WITH {PARTS} SELECT notebook_id, {size('code')} AS num_lines, {count('code', FUNCTION)} AS num_functions, {count('code', CLASS)} AS num_classes, {count('code', DECISIONS)} + 2 * greatest(1, {count('code', FUNCTION)} + {count('code', CLASS)}) AS cyclomatic_complexity FROM codes",
        "q_narrative_size": f"WITH {PARTS} SELECT notebook_id, {size('clean')} AS narrative_size FROM cleaned WHERE part = 'narrative'",
        "q_vec_mean": f"WITH {VECTORS} SELECT label::BIGINT AS label, i - 1 AS i, round(avg(vec[i]), 9) AS x FROM vectors, range(1, 65) t(i) GROUP BY ALL",
        "q_cosine_topk": f"""WITH {VECTORS}, {MEANS}, pairs AS (SELECT group_id, 'd' || m.label AS domain, sum(greatest(0, array_cosine_similarity(v.vec, m.vec))) AS score FROM vectors v, means m GROUP BY ALL)
SELECT group_id, domain, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY round(score, 9) DESC, domain) AS rank FROM pairs) WHERE rank <= 10""",
        "q_cosine_pairs": f"WITH {VECTORS}, {MEANS} SELECT a.label::BIGINT AS first, b.label::BIGINT AS second, round(array_cosine_similarity(a.vec, b.vec), 9) AS cosine FROM means a JOIN means b ON a.label < b.label",
        "q_precision_at_k": f"{SCORES} SELECT {KEYS}, round(p_at_k, 9) AS p_at_k FROM scores",
        "q_pk_rollups": f"""{SCORES} SELECT coalesce(part, 'all') AS part, coalesce(term_type, 'all') AS term_type, coalesce(embedding_type, 'all') AS embedding_type, round(avg(p_at_k), 9) AS mean_p_at_k, count(p_at_k) AS n
FROM scores GROUP BY GROUPING SETS ((embedding_type), (term_type), (part), (embedding_type, term_type), (part, term_type, embedding_type))""",
        "q_pk_best5": f"{SCORES} SELECT part, term_type, embedding_type, round(avg(p_at_k), 9) AS mean_p_at_k FROM scores GROUP BY 1, 2, 3 ORDER BY 4 DESC NULLS LAST, 1, 2, 3 LIMIT 5",
        "q_pk_pivot": f"{SCORES} SELECT embedding_type, term_type, " + ", ".join(f"round(avg(p_at_k) FILTER (part = '{p}'), 9) AS {p.replace(' ', '_')}" for p in ("code", "comment", "markdown narrative", "all combined")) + " FROM scores WHERE p_at_k IS NOT NULL GROUP BY 1, 2",
        "q_missing_tags": f"WITH {PREDICTIONS}, {TAGS} SELECT DISTINCT notebook FROM predictions WHERE notebook NOT IN (SELECT notebook FROM tags)",
        "q_tags_left": f"WITH {PREDICTIONS}, {TAGS} SELECT p.notebook, coalesce(len(tags), 0) AS n_tags FROM (SELECT DISTINCT notebook FROM predictions) p LEFT JOIN tags USING (notebook)",
        "q_tag_top20": f"WITH {TAGS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM tags) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
        "q_unique_tags": f"WITH {TAGS} SELECT DISTINCT unnest(tags) AS tag FROM tags",
        "q_tag_status": f"WITH {TAGS} SELECT count(*) FILTER (len(tags) > 0) AS tagged, count(*) FILTER (len(tags) = 0) AS untagged, count(*) AS total, round(100.0 * count(*) FILTER (len(tags) > 0) / count(*), 6) AS percent FROM tags",
        "q_tag_histogram": f"WITH {TAGS} SELECT len(tags) AS n_tags, count(*) AS n FROM tags GROUP BY 1",
        "q_tag_stats": f"WITH {TAGS} SELECT round(avg(len(tags)), 9) AS mean, median(len(tags)) AS median, max(len(tags)) AS most, count(*) FILTER (len(tags) = 0) AS zeros FROM tags",
        "q_top_domains": f"WITH {PREDICTIONS} SELECT coalesce(top_domains[1], 'Unknown') AS domain, count(*) AS n FROM {COMBINED} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
        "q_domain_by_type": f"WITH {PREDICTIONS} SELECT coalesce(top_domains[1], 'Unknown') AS domain, " + ", ".join(f"count(*) FILTER (embedding_type = '{e}') AS {e}" for e in ("bert", "glove", "word2vec")) + " FROM predictions GROUP BY 1",
        "q_value_counts_min5": "SELECT top1_domain, count(*) AS n FROM code_complexity WHERE top1_domain IS NOT NULL GROUP BY 1 HAVING count(*) >= 5",
        "q_variations": f"{VARIATIONS} SELECT * FROM variations",
        "q_feature_join": f"{VARIATIONS}, features AS ({FEATURES}) SELECT v.notebook, variation_idx, v.domain, {', '.join(f'{m}::BIGINT AS {m}' for m in METRICS)} FROM variations v JOIN features f ON f.base_notebook = v.notebook",
        "q_corr_matrix": f"WITH features AS ({FEATURES}), c AS (SELECT {', '.join(f'corr({a}, {b}) AS c{k}' for k, (a, b) in enumerate(pairs))} FROM features) " + " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, round(CASE WHEN isnan(c{k}) THEN NULL ELSE c{k} END, 6) AS corr FROM c" for k, (a, b) in enumerate(pairs)),
        "q_welch_t": f"WITH {WELCH}",
        "q_mean_std": f"WITH features AS ({FEATURES}), {LONG} SELECT domain, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM long GROUP BY 1, 2",
        "q_row_mean": f"{SCORES}, {PART_MEANS} SELECT embedding_type, term_type, round(list_avg(list_filter([" + ", ".join(REPORTED_PARTS) + "], lambda x: x IS NOT NULL)), 9) AS mean FROM means",
        "q_boxplot": f"""WITH features AS ({FEATURES}), {LONG}, q AS (SELECT domain, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM long WHERE domain IS NOT NULL GROUP BY 1, 2)
SELECT q.*, min(value) AS low, max(value) AS high FROM q JOIN long USING (domain, metric) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""",
        "q_iqr_filter": _iqr(),
        "q_standardize": f"WITH features AS ({FEATURES}), m AS (SELECT {moments} FROM features) SELECT base_notebook, " + ", ".join(f"round(({m} - m_{m}) / CASE WHEN s_{m} > 0 THEN s_{m} ELSE 1 END, 6) AS {m}" for m in METRICS) + " FROM features, m",
        "q_split": f"WITH features AS ({FEATURES}) SELECT domain, count(*) AS n, ceil(count(*) * 0.25)::BIGINT AS n_test FROM features WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) >= 5",
        "q_confusion_report": _report(),
        "q_token_window": "SELECT event_id, round(sum(value) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW), 6) AS trailing FROM events",
        "q_token_estimate": "SELECT doc_id, round(length(coalesce(text, '')) / 4.7, 6) AS tokens FROM documents",
        "q_prompt": f"""WITH {PARTS}, {PREDICTIONS}, best AS (SELECT notebook AS name, coalesce(top_domains[1], 'Unknown') AS domain FROM predictions WHERE part = 'all combined' AND term_type = 'tfidf' AND embedding_type = 'bert'),
p AS (SELECT notebook_id, {prompt} AS x FROM nb LEFT JOIN best ON name = {notebook("notebook")}) SELECT notebook_id, length(x) AS n_chars, md5(x) AS digest FROM p""",
        "q_chunks": "SELECT kernel_ref, (row_number() OVER (PARTITION BY split_part(kernel_ref, '/', 1) ORDER BY kernel_ref) - 1) // 20 AS page FROM (SELECT DISTINCT kernel_ref FROM kernels)",
        "q_categories": f"""SELECT CASE WHEN text IS NULL THEN 'Unknown' WHEN {has("highly relevant", "very relevant")} THEN 'Highly Relevant' WHEN {has("relevant")} AND NOT {has("partially", "somewhat")} THEN 'Relevant' WHEN {has("partially", "somewhat")} THEN 'Partially Relevant' ELSE 'Unclear/Not Relevant' END AS relevance,
CASE WHEN text IS NULL THEN 'Unknown' WHEN {has("very specific", "appropriately specific")} THEN 'Appropriately Specific' WHEN {has("general", "broad")} THEN 'Too General' WHEN {has("too specific", "overly specific")} THEN 'Too Specific' ELSE 'Unclear' END AS specificity, count(*) AS n FROM documents GROUP BY 1, 2""",
        "q_printed_lists": "SELECT coalesce(array_to_string(top_domains, '|'), '') AS items, coalesce(top_domains[1], 'Unknown') AS first FROM (SELECT DISTINCT top_domains FROM domain_classification_results)",
        "q_split_ref": "SELECT DISTINCT kernel_ref, CASE WHEN len(string_split(kernel_ref, '/')) = 2 THEN split_part(kernel_ref, '/', 1) END AS account, CASE WHEN len(string_split(kernel_ref, '/')) = 2 THEN split_part(kernel_ref, '/', 2) END AS slug FROM kernels",
        "q_sample_size": "SELECT account, population, ceil(e / (1 + (e - 1) / population))::BIGINT AS sample FROM (SELECT split_part(kernel_ref, '/', 1) AS account, count(DISTINCT kernel_ref) AS population, 2.576::DOUBLE * 2.576 * 0.25 / (0.02::DOUBLE * 0.02) AS e FROM kernels GROUP BY 1)",
        "q_paired_t": f"{SCORES}, {PART_MEANS}, s AS (SELECT " + ", ".join(f"avg({a} - {b}) AS m{k}, stddev_samp({a} - {b}) AS s{k}, count({a} - {b}) AS n{k}" for k, (a, b) in enumerate(tests)) + " FROM means) " + " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, n{k} AS n, round(m{k}, 6) AS mean_diff, round(m{k} / nullif(s{k} / sqrt(n{k}), 0), 4) AS t, n{k} - 1 AS df FROM s" for k, (a, b) in enumerate(tests)),
    }
