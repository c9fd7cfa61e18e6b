"""SQL that gives the results of the queries in ``queries`` where SQL can express them."""

from __future__ import annotations

from notemill.llm.splits import NO_AUTHOR

CURRENT = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY scraped_at DESC NULLS LAST) AS rn
FROM {table} WHERE {key} IS NOT NULL) WHERE rn = 1
"""

TERMS = "list_filter(regexp_extract_all({0}, '[\\p{{L}}\\p{{Nd}}_]+'), lambda x: NOT regexp_matches(x, '^\\p{{Nd}}'))"

_P1 = f"""
WITH tags AS ({CURRENT.format(key="kernel_ref", table="kernel_metadata")}),
code AS ({CURRENT.format(key="notebook_id", table="nb_contents")}),
tokens AS (
  SELECT 'keywords' AS field_name, kernel_ref AS record,
    trim(regexp_replace(lower(k), '[\\s_\\p{{Pd}}\\x{{00A0}}\\x{{3000}}]+', ' ', 'g')) AS term
  FROM (SELECT kernel_ref, unnest(keywords) AS k FROM tags) WHERE k IS NOT NULL
  UNION ALL
  SELECT 'code', notebook_id::VARCHAR, unnest({TERMS.format("code")}) FROM code WHERE code IS NOT NULL
), kept AS (SELECT * FROM tokens WHERE term <> ''),
holders AS (SELECT field_name, count(DISTINCT record) AS n_holders FROM kept GROUP BY 1),
counts AS (SELECT field_name, term, count(*) AS n_occurrences, count(DISTINCT record) AS n_records FROM kept GROUP BY 1, 2),
marked AS (
  SELECT c.*, h.n_holders,
    list_filter([CASE WHEN n_records < 3 THEN 'rare' END, CASE WHEN n_records > 0.2 * n_holders THEN 'common' END],
      lambda m: m IS NOT NULL) AS marks
  FROM counts c JOIN holders h USING (field_name)
)
SELECT field_name, term, n_occurrences, n_records, n_holders,
  unnest(CASE WHEN len(marks) = 0 THEN [NULL] ELSE marks END) AS mark FROM marked
"""

_P5 = f"""
WITH cur AS ({CURRENT.format(key="notebook_id", table="nb_contents")}),
parts AS (
  SELECT notebook_id, 'code' AS field_name, code AS text FROM cur
  UNION ALL SELECT notebook_id, 'in_line_comment', in_line_comment FROM cur
  UNION ALL SELECT notebook_id, 'markdown_narrative', markdown_narrative FROM cur
),
tokens AS (SELECT notebook_id, field_name, unnest({TERMS.format("lower(text)")}) AS term FROM parts WHERE text IS NOT NULL),
cells AS (SELECT notebook_id, field_name, term, count(*) AS n_here FROM tokens GROUP BY 1, 2, 3),
cols AS (SELECT field_name, term, count(*) AS n_records, sum(n_here)::BIGINT AS n_total FROM cells GROUP BY 1, 2),
rws AS (SELECT notebook_id, field_name, sum(n_here)::DOUBLE AS row_total FROM cells GROUP BY 1, 2),
grand AS (SELECT field_name, sum(row_total) AS grand FROM rws GROUP BY 1),
scored AS (
  SELECT *, row_total * n_total / grand AS e FROM cells JOIN cols USING (field_name, term)
  JOIN rws USING (notebook_id, field_name) JOIN grand USING (field_name)
)
"""

#: Token counts of the sources' texts differ from their lengths by far less than the fates could bear.
_P8 = """
WITH docs AS (
  SELECT text, regexp_replace(regexp_replace(lower(source), '^[\\s\\x{00A0}\\x{3000}]+|[\\s\\x{00A0}\\x{3000}]+$', '', 'g'), '_', '-', 'g') AS source
  FROM documents WHERE source IS NOT NULL AND text IS NOT NULL AND text <> ''
), kept AS (SELECT * FROM docs WHERE source <> ''),
own AS (SELECT source, sum(length(text)) AS own FROM (SELECT DISTINCT source, text FROM kept) GROUP BY 1),
total AS (SELECT sum(length(text)) AS total FROM kept),
quotas AS (SELECT t.source, coalesce(own, 0) AS own, total * target_share AS quota, max_repeats FROM mix_targets t LEFT JOIN own USING (source), total)
SELECT source, CASE WHEN own = 0 OR own * max_repeats < quota THEN 'short' WHEN own < quota THEN 'repeat' ELSE 'sample' END AS fate FROM quotas
"""
#: Names that join kernels: accounts, persons, forks; reached pairs grow until the closure is whole.
_P4 = """
WITH RECURSIVE rows AS (
  SELECT DISTINCT lower(trim(kernel_ref, ' /' || chr(9) || chr(10) || chr(160))) AS ref, split_part(lower(trim(kernel_ref, ' /')), '/', 1) AS account, split_part(lower(trim(kernel_ref, ' /')), '/', 2) AS slug,
    CASE WHEN contains(person, ',') THEN trim(split_part(person, ',', 2)) || ' ' || trim(split_part(person, ',', 1)) ELSE person END AS person,
    regexp_replace(trim(lower(forked_from), ' /' || chr(9) || chr(10) || chr(160)), '^(?:https?://)?(?:[^/]+\\.[^/]+/)?(?:code/|kernels/)?([^/]+/[^/]+)$', '\\1') AS origin
  FROM (SELECT *, trim(regexp_replace(lower(author), '[\\s\\x{00A0}]+', ' ', 'g')) AS person FROM kernels WHERE kernel_ref IS NOT NULL)
), named AS (SELECT * REPLACE (CASE WHEN person IN ({missing}) THEN NULL ELSE person END AS person, CASE WHEN contains(origin, '/') THEN origin END AS origin) FROM rows),
edges AS (
  SELECT DISTINCT account, 'p:' || person AS hub FROM named WHERE person IS NOT NULL
  UNION SELECT account, CASE WHEN origin IN (SELECT ref FROM named) THEN 'a:' || split_part(origin, '/', 1) ELSE 'k:' || origin END FROM named WHERE origin IS NOT NULL
  UNION SELECT account, 'a:' || account FROM named
), near AS (SELECT DISTINCT x.account AS a, y.account AS b FROM edges x JOIN edges y USING (hub)),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
groups AS (SELECT a AS account, min(b) AS group_key FROM reach GROUP BY 1),
slugs AS (SELECT slug, min(group_key) AS group_key FROM (SELECT DISTINCT slug, account FROM named) JOIN groups USING (account) GROUP BY 1),
names AS (
  SELECT notebook, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(notebook), '^[\\s\\x{00A0}\\x{3000}]+|[\\s\\x{00A0}\\x{3000}]+$', '', 'g'), '^.*/', ''), '\\.ipynb$', ''), '_var\\d+$', '') AS slug
  FROM (SELECT DISTINCT notebook FROM domain_classification_results WHERE notebook IS NOT NULL)
)
SELECT notebook, group_key FROM names JOIN slugs USING (slug)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _P4.replace("{missing}", ", ".join(f"'{x}'" for x in NO_AUTHOR)),
        "p8_found": _P8,
        "p1_term_frequency": _P1,
        "p1_found": f"SELECT field_name, term, mark FROM ({_P1}) WHERE mark IS NOT NULL",
        "p5_distinctive": _P5
        + """SELECT notebook_id, field_name, term, n_here, n_records, n_total, round(e, 6) AS expected,
  round((n_here - e) / sqrt(e), 6) AS residual,
  round((n_here - e) / sqrt(e) / sqrt((1 - row_total / grand) * (1 - n_total / grand)), 6) AS adjusted FROM scored""",
        "p5_found": _P5 + "SELECT notebook_id, field_name, term FROM scored WHERE n_here >= 4 AND n_records BETWEEN 2 AND 5",
    }
