"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from kestrelix.llm.license_scan import BASE_PHRASES, LOWER, TEMPLATES, UPPER
from kestrelix.llm.topk_search import OP2_SQL

_SPLIT = r"'[^\x20\x09-\x0D]+'"
_BLANK = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP4_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {_SPLIT}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
twoway AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM twoway UNION SELECT reach.doc_id, twoway.b FROM reach JOIN twoway ON twoway.a = reach.r),
c AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.r, d.doc_id) AS component_id, coalesce(c.r, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def _grams() -> str:
    rows = []
    for base, listed in (("true", BASE_PHRASES), ("false", TEMPLATES)):
        for label, phrase in listed:
            w = phrase.split()
            k = min(3, len(w))
            total = len(w) - k + 1
            rows += [f"('{label}', {base}, {k}, {o}, {total}, '{w[o]}', '{w[o + 1]}', '{w[o + 2] if k == 3 else ''}')" for o in range(total)]
    return ", ".join(rows)


OP7_SQL = rf"""
WITH g AS (SELECT * FROM (VALUES {_grams()}) t(label, base, k, o, total, a, b, c)),
t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
placed AS (SELECT doc_id, i - 1 AS p, w[i] AS w0, w[i + 1] AS w1, w[i + 2] AS w2 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
h AS (SELECT doc_id, label, base, total, k, o, p, p - o AS d FROM placed JOIN g ON w0 = a AND w1 = b AND (k = 2 OR w2 = c)),
n AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY doc_id, label, base ORDER BY d, o) <= 2 THEN 0 ELSE 1 END AS new, count(*) OVER (PARTITION BY doc_id, label, base, d) AS votes FROM h),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, label, base ORDER BY d, o ROWS UNBOUNDED PRECEDING) AS run FROM n),
q AS (SELECT *, o - max(o) OVER (PARTITION BY doc_id, label, base, run ORDER BY p, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS behind, base AND votes = total AND o = 0 AS start FROM r),
s AS (SELECT doc_id, label, base, count(*) FILTER (coalesce(behind, 1) > 0)::DOUBLE / any_value(total) AS share, sum(least(k, coalesce(behind, k))) FILTER (coalesce(behind, 1) > 0) AS own,
  max(p + k) FILTER (coalesce(behind, 1) > 0) - min(p) FILTER (coalesce(behind, 1) > 0) AS reach,
  count(*) FILTER (start) AS places, min(d) FILTER (start) AS first, max(d) FILTER (start) AS last FROM q GROUP BY doc_id, label, base, run),
x AS (SELECT doc_id, sum(places) AS n_base, min(first) AS first_word, max(last) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base AND places > 0)), ',') AS base_labels,
  array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE CASE WHEN base THEN places > 0 ELSE share >= 0.75 AND own >= 0.75 * reach END)), ',') AS labels, max(share) AS score FROM s GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM t LEFT JOIN x USING (doc_id)
"""

OP8_SQL = f"""
WITH l AS (SELECT doc_id, k, x[k] AS raw, trim(x[k], {_BLANK}) AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))),
d AS (SELECT line, min((doc_id, k)) AS f, any_value(regexp_extract_all(line, {_SPLIT})) AS w FROM l WHERE line <> '' GROUP BY 1),
s AS (SELECT line, f, w, array_to_string(w, ' ') AS v FROM d),
del AS (SELECT line, f, p, array_to_string(list_concat(w[1:p], w[p + 2:]), ' ') AS v FROM (SELECT line, f, w, unnest(range(len(w))) AS p FROM s WHERE len(w) >= 8)),
e AS (SELECT v, p, min(f) AS m FROM del GROUP BY ALL),
near AS (SELECT line FROM del JOIN e USING (v, p) WHERE m < f
  UNION SELECT del.line FROM del JOIN s ON s.v = del.v WHERE s.f < del.f
  UNION SELECT s.line FROM s JOIN (SELECT v, min(f) AS m FROM del GROUP BY 1) USING (v) WHERE m < f),
k AS (SELECT l.doc_id, l.k, l.raw, l.line = '' OR (d.f = (l.doc_id, l.k) AND near.line IS NULL) AS keep FROM l LEFT JOIN d ON d.line = l.line LEFT JOIN near ON near.line = l.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_removed, sha256(coalesce(string_agg(raw, chr(10) ORDER BY k) FILTER (WHERE keep), '')) AS kept_sha256 FROM k GROUP BY 1
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""

OP9_SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPLIT}) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS m FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN m USING (h) WHERE m < doc_id),
word AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM t),
k AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
"""

ORACLES = {
    "op2_topk_search": OP2_SQL,
    "op4_minhash_near_dedup": OP4_SQL,
    "op7_license_scan": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
}
