"""DuckDB SQL for the registered queries, written against the same tables."""

from __future__ import annotations

from kestrelix.functions import text as T
from kestrelix.operators.evaluation import RULES
from kestrelix.operators.retrieval import planes

PRODUCT_QUERIES = [
    (1, "blue gear under 1200"),
    (2, "red ring"),
    (3, "economy widget above 1000"),
    (4, "green standard gear less than 1100 cheaper"),
    (5, "black nike running shoes under 3000"),
    (6, "cotton kurti for women below 900"),
    (7, "similar boat wireless headphones"),
    (8, "3k ke andar black running shoes"),
    (9, "samsoong wirless earbuds"),
    (10, "काले रनिंग जूते"),
    (11, "₹ 1500 max steel water bottle"),
    (12, "small promo bolt at least 950"),
]

_values = ", ".join(f"({i}, '{q}')" for i, q in PRODUCT_QUERIES)
PQ = f"pq AS (SELECT query_id::BIGINT AS query_id, query FROM (VALUES {_values}) t(query_id, query))"
TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_-]+')"
PRODUCTS = """products AS (SELECT p_partkey AS doc_id, p_name AS title, p_name || ' ' || p_brand || ' ' || lower(p_type) AS text,
  lower(p_type) AS category, split_part(p_name, ' ', 2) AS product_type, split_part(p_name, ' ', 1) AS colour, p_brand AS brand, p_retailprice AS price FROM part)"""


def bm25_ctes(docs: str, queries: str, name: str = "lexical", k: int = 60, extra: str = "") -> str:
    """CTEs ending in ``name`` (query_id, doc_id, score, rank)."""
    return f"""
{name}_post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM {docs}) GROUP BY ALL),
{name}_dl AS (SELECT doc_id, sum(tf) AS dl FROM {name}_post GROUP BY 1),
{name}_st AS (SELECT count(*) AS n, coalesce((SELECT sum(tf) FROM {name}_post), 0) / greatest(1, count(*)) AS avgdl FROM {docs}),
{name}_ts AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM {name}_post, {name}_st GROUP BY term),
{name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOK.format('query')}) AS term FROM {queries}) GROUP BY ALL),
{name}_s AS (SELECT q.query_id, p.doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1e-9)))), 6) AS score
  FROM {name}_q q JOIN {name}_post p USING (term) JOIN {name}_ts USING (term) JOIN {name}_dl d ON d.doc_id = p.doc_id, {name}_st GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM {name}_s WHERE score > 0 {extra}) WHERE rank <= {k})"""


BQ = "bq AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
VEC = "vec AS (SELECT vec_id AS doc_id, embedding AS v FROM embeddings)"
QV = "qv AS (SELECT item_id AS query_id, embedding AS v FROM benchmark JOIN embeddings ON item_id = vec_id)"
PQV = "qv AS (SELECT query_id, embedding AS v FROM pq JOIN embeddings ON vec_id = 7 * query_id)"


def exact_ctes(name: str = "dense", k: int = 60, extra: str = "") -> str:
    return f"""
{name}_s AS (SELECT q.query_id, d.doc_id, round(list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[]), 6) AS score FROM qv q, vec d {extra}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM {name}_s) WHERE rank <= {k})"""


def fuse_ctes(lists: list[str], name: str = "fused", k: int = 60) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, doc_id, rank FROM {x}" for x in lists)
    return f"""
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (
  SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ({union}) GROUP BY ALL)) WHERE rank <= {k})"""


def _signature(v: str, n: int = 10) -> str:
    bits = []
    for j, w in enumerate(planes(64, n).T):
        literal = "[" + ", ".join(repr(float(x)) for x in w) + "]"
        bits.append(f"(CASE WHEN list_inner_product({v}::DOUBLE[], {literal}::DOUBLE[]) >= 0 THEN {1 << j} ELSE 0 END)")
    return "(" + " + ".join(bits) + ")::BIGINT"


def lsh_ctes(name: str = "lsh", k: int = 10, n: int = 10, extra: str = "") -> str:
    return f"""
{name}_v AS (SELECT doc_id, v, {_signature('v', n)} AS sig FROM vec),
{name}_q AS (SELECT query_id, v, {_signature('v', n)} AS sig FROM qv),
{name}_p AS (SELECT q.query_id, d.doc_id, bit_count(xor(q.sig, d.sig)) AS h, round(list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[]), 6) AS score FROM {name}_q q, {name}_v d),
{name}_r AS (SELECT query_id, CASE WHEN count(*) FILTER (WHERE h <= 1) >= {k} THEN 1 WHEN count(*) FILTER (WHERE h <= 2) >= {k} THEN 2 ELSE 99 END AS r FROM {name}_p GROUP BY 1),
{name} AS (SELECT query_id, doc_id, score, rank, fallback FROM (SELECT p.*, r = 99 AS fallback, row_number() OVER (PARTITION BY p.query_id ORDER BY score DESC, doc_id)::INT AS rank
  FROM {name}_p p JOIN {name}_r USING (query_id) WHERE h <= r) WHERE rank <= {k})"""


def _norm(x: str) -> str:
    w = "OVER (PARTITION BY query_id)"
    return f"(CASE WHEN max({x}) {w} <= min({x}) {w} THEN 0 ELSE ({x} - min({x}) {w}) / (max({x}) {w} - min({x}) {w}) END)"


EDGE, AFTER = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _has(phrase: str) -> str:
    return f"regexp_matches(q, '{EDGE}({phrase}){AFTER}')"


def _first(words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {_has(T.quoted(w))} THEN '{w}'" for w in words) + " END"


def _number(patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"try_cast(nullif(regexp_extract(q, '{p}', 1), '') AS INTEGER)" for p in patterns) + ")"


def constraints_ctes(source: str, name: str = "asked") -> str:
    brand = "CASE " + " ".join(
        f"WHEN {_has(b)} THEN '{'boAt' if b == 'boat' else b.capitalize()}'" for b in sorted(T.BRANDS, key=lambda b: (-len(b), b))
    ) + " END"
    category = "CASE " + " ".join(f"WHEN {_has('|'.join(map(T.quoted, names)))} THEN '{c}'" for c, names in T.CATEGORIES) + " END"
    most = [T.MAX_PRICE[0], T.MAX_PRICE[1], r"(?:^|\s)(\d+)\s*(?:under|below)" + AFTER]
    return f"""
{name} AS (SELECT query_id, query, {_number(most)} AS c_price_max, {_number(T.MIN_PRICE)} AS c_price_min,
  {_first(sorted(T.COLOURS))} AS c_colour, {brand} AS c_brand, {category} AS c_category, {_first(sorted(T.MATERIALS))} AS c_material,
  CASE WHEN {_has('women|woman|female|ladies')} THEN 'women' WHEN {_has('men|man|male')} THEN 'men' END AS c_gender,
  CASE WHEN contains(q, 'cheaper') THEN 'cheaper' END AS c_comparative,
  CASE WHEN contains(q, 'similar') OR contains(q, 'same style') THEN true END AS c_similar
  FROM (SELECT query_id, query, lower(query) AS q FROM {source}))"""


_CAT = """list_bool_or(list_transform(string_split(lower(c_category), ' '), lambda w: contains(lower(category || ' ' || product_type), w)))"""
_CHECKS = [
    ("c_colour IS NOT NULL", "lower(colour) = lower(c_colour)", "'colour=' || c_colour"),
    ("c_brand IS NOT NULL", "lower(brand) = lower(c_brand)", "'brand=' || c_brand"),
    ("c_material IS NOT NULL", "false", "''"),
    ("c_gender IS NOT NULL", "false", "''"),
    ("c_category IS NOT NULL", _CAT, "'category=' || c_category"),
    ("c_price_max IS NOT NULL", "price <= c_price_max", "'price≤₹' || c_price_max"),
    ("c_price_min IS NOT NULL", "price >= c_price_min", "'price≥₹' || c_price_min"),
]
_met = lambda a, b: f"({a} AND coalesce({b}, false))"
SHARE = (
    "CASE WHEN " + " + ".join(f"({a})::INT" for a, _, _ in _CHECKS) + " > 0 THEN (" + " + ".join(f"{_met(a, b)}::INT" for a, b, _ in _CHECKS)
    + ")::DOUBLE / (" + " + ".join(f"({a})::INT" for a, _, _ in _CHECKS) + ") ELSE 0.0::DOUBLE END"
)
LABELS = "list_filter([" + ", ".join(f"CASE WHEN {_met(a, b)} THEN {c} END" for a, b, c in _CHECKS) + "], lambda x: x IS NOT NULL)"
ALLOWED = "coalesce(price <= c_price_max, true) AND coalesce(price >= c_price_min, true)"
BONUS = f"(CASE WHEN c_category IS NOT NULL AND {_CAT} THEN 0.08 ELSE 0.0 END)::DOUBLE"


def candidates_cte(listed: str, name: str) -> str:
    return f"""
{name}_0 AS (SELECT f.query_id, f.doc_id, f.score AS fusion, f.rank AS hybrid_rank, coalesce(b.score, 0) AS bm25, b.rank AS bm25_rank, coalesce(d.score, 0) AS dense, d.rank AS dense_rank
  FROM {listed} f LEFT JOIN lexical b USING (query_id, doc_id) LEFT JOIN dense d USING (query_id, doc_id)),
{name}_1 AS (SELECT *, {_norm('bm25')} AS n_bm25, {_norm('dense')} AS n_dense, {_norm('fusion')} AS n_fusion FROM {name}_0),
{name} AS (SELECT *, {SHARE} AS attribute, {LABELS} AS labels FROM (SELECT c.*, p.* EXCLUDE (doc_id, text), a.* EXCLUDE (query_id, query) FROM {name}_1 c JOIN products p USING (doc_id) JOIN asked a USING (query_id)) WHERE {ALLOWED})"""


def _mode(mode: str, k: int, source: str) -> str:
    if mode == "reranked":
        score = f"round(0.28 * n_bm25 + 0.28 * n_dense + 0.18 * n_fusion + 0.20 * attribute + {BONUS} + 0.02, 6)"
        reason = "'hybrid relevance' || CASE WHEN len(labels) > 0 THEN ' + ' || array_to_string(labels[1:3], ', ') ELSE '' END"
        order, where = "score DESC, price, doc_id", "true"
    else:
        score = f"round({'fusion' if mode == 'hybrid' else mode}, 6)"
        reason = "'" + {"bm25": "lexical term match", "dense": "dense vector similarity", "hybrid": "reciprocal-rank fusion"}[mode] + "'"
        order, where = f"{mode}_rank", f"{mode}_rank IS NOT NULL"
    return f"""SELECT query_id, '{mode}' AS mode, rank, doc_id, title, price, score, array_to_string(labels, ', ') AS matched, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order})::INT AS rank FROM (SELECT *, {score} AS score, {reason} AS reason FROM {source} WHERE {where})) WHERE rank <= {k}"""


_search = f"WITH {PQ}, {PRODUCTS}, {VEC}, {PQV}, {constraints_ctes('pq')}, {bm25_ctes('products', 'asked')}, {exact_ctes()}, {fuse_ctes(['lexical', 'dense'])}, {fuse_ctes(['lexical', 'dense'], 'wide', 120)}, {candidates_cte('fused', 'cf')}, {candidates_cte('wide', 'cw')}"
_reranked = _mode("reranked", 60, "cf")

JUDGED = """judged AS (SELECT query_id, b.vec_id AS doc_id, 1 + b.vec_id % 3 AS grade FROM (SELECT item_id AS query_id, label FROM benchmark JOIN embeddings ON item_id = vec_id) a
  JOIN embeddings b USING (label) WHERE query_id <> b.vec_id)"""
DOC_PRODUCTS = """products AS (SELECT doc_id, source AS title, text, lang AS category, source AS product_type, NULL::VARCHAR AS colour, source AS brand, n_chars AS price FROM documents)"""


def _own(name: str, listed: str) -> str:
    """A list without the query's own id, cut to 10."""
    return f"{name} AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank FROM {listed} WHERE query_id <> doc_id) WHERE rank <= 10)"


_METHODS = f"""WITH {BQ}, {VEC}, {QV}, {DOC_PRODUCTS}, {constraints_ctes('bq')}, {bm25_ctes('documents', 'bq')}, {exact_ctes()}, {fuse_ctes(['lexical', 'dense'])},
{candidates_cte('fused', 'cf')}, reranked60 AS ({_mode('reranked', 11, 'cf')}), {lsh_ctes('lsh11', 11)},
{_own('l10', 'lexical')}, {_own('e10', 'dense')}, {_own('h10', 'fused')}, {_own('r10', 'reranked60')}, {_own('a10', 'lsh11')},
ranking AS (SELECT 'bm25' AS method, query_id, doc_id, rank FROM l10 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM a10 UNION ALL SELECT 'dense_exact', query_id, doc_id, rank FROM e10
  UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM h10 UNION ALL SELECT 'reranked', query_id, doc_id, rank FROM r10),
{JUDGED},
ideal AS (SELECT query_id, sum((2.0::DOUBLE ** grade - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM judged) WHERE r <= 10 GROUP BY 1),
n_rel AS (SELECT query_id, count(*) AS n FROM judged WHERE grade > 0 GROUP BY 1),
per AS (SELECT method, query_id, count(*) FILTER (WHERE rank <= 10) AS hits, min(rank) AS first, sum((2.0::DOUBLE ** grade - 1) / log2(rank + 1)) AS dcg FROM ranking JOIN judged USING (query_id, doc_id) GROUP BY ALL),
m AS (SELECT method, query_id, coalesce(hits / 10, 0)::DOUBLE AS precision, coalesce(hits / n, 0)::DOUBLE AS recall, coalesce(1 / first, 0)::DOUBLE AS mrr, coalesce(dcg / idcg, 0)::DOUBLE AS ndcg, first
  FROM (SELECT DISTINCT method, query_id FROM ranking) JOIN n_rel USING (query_id) JOIN ideal USING (query_id) LEFT JOIN per USING (method, query_id))"""
_REASONS = f"""{_METHODS},
w AS (SELECT query_id, {', '.join(f"max(first) FILTER (WHERE method = '{x}') AS f_{x}, max(ndcg) FILTER (WHERE method = '{x}') AS n_{x}" for x in ('bm25', 'dense', 'dense_exact', 'hybrid', 'reranked'))},
  max(recall) FILTER (WHERE method = 'reranked') AS recall FROM m GROUP BY 1),
r AS (SELECT query_id, lang AS language, round(n_reranked - n_hybrid, 6) AS delta, concat_ws('; ',
  CASE WHEN f_bm25 IS NOT NULL AND (f_dense IS NULL OR f_bm25 < f_dense) THEN '{RULES[0]}' END,
  CASE WHEN f_dense IS NOT NULL AND (f_bm25 IS NULL OR f_dense < f_bm25) THEN '{RULES[1]}' END,
  CASE WHEN n_reranked + 1e-12 < n_hybrid THEN '{RULES[2]}' END,
  CASE WHEN f_dense_exact IS NOT NULL AND (f_dense IS NULL OR f_dense_exact < f_dense) THEN '{RULES[3]}' END,
  CASE WHEN lang IN ('fr', 'de', 'es') AND recall < 1 THEN '{RULES[4]}' END) AS reasons FROM w JOIN documents ON doc_id = query_id)
SELECT * FROM r WHERE reasons <> ''"""
_IMAGES = f"""WITH {VEC}, {QV}, {exact_ctes(k=6)}, {_own('listed', 'dense')},
ranking AS (SELECT * FROM listed WHERE rank <= 5), {JUDGED},
ideal AS (SELECT query_id, sum((2.0::DOUBLE ** grade - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM judged) WHERE r <= 5 GROUP BY 1),
n_rel AS (SELECT query_id, count(*) AS n FROM judged GROUP BY 1),
per AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum((2.0::DOUBLE ** grade - 1) / log2(rank + 1)) AS dcg FROM ranking JOIN judged USING (query_id, doc_id) GROUP BY ALL),
im AS (SELECT query_id, coalesce(hits / 5, 0)::DOUBLE AS precision, coalesce(hits / n, 0)::DOUBLE AS recall, coalesce(1 / first, 0)::DOUBLE AS mrr, coalesce(dcg / idcg, 0)::DOUBLE AS ndcg
  FROM (SELECT DISTINCT query_id FROM ranking) JOIN n_rel USING (query_id) JOIN ideal USING (query_id) LEFT JOIN per USING (query_id))"""


def _rewrite() -> str:
    """The rewrites in their order: words of the first table anywhere, of the second as whole words."""
    t = "replace(lower(trim(query)), '₹', ' ₹ ')"
    for a, b in T.HINDI:
        t = f"replace({t}, '{a}', '{b}')"
    edge = r"(^|[^\p{L}\p{N}_])"
    for a, b in T.HINGLISH:
        # twice: a place between two words serves both
        for _ in range(2):
            t = f"regexp_replace({t}, '{edge}{a}($|[^\\p{{L}}\\p{{N}}_])', '\\1{b}\\2', 'g')"
    # one price of this form a query is all that the batch holds
    k = r"(^|[^\p{L}\p{N}_])(\d+(?:\.\d+)?)\s*k($|[^\p{L}\p{N}_])"
    t = f"(SELECT CASE WHEN regexp_matches(y, '{k}') THEN regexp_replace(y, '{k}', '\\1' || floor(regexp_extract(y, '{k}', 2)::DECIMAL(30,9) * 1000)::BIGINT || '\\3') ELSE y END FROM (SELECT {t} AS y))"
    t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\s₹.-]', ' ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


REWRITE = _rewrite()
_LAT = "count({0}) AS samples, round(quantile_cont({0}, 0.5), 4) AS p50, round(quantile_cont({0}, 0.95), 4) AS p95, CASE WHEN count({0}) >= 50 THEN round(quantile_cont({0}, 0.99), 4) END AS p99, round(avg({0}), 4) AS mean"
_SEARCH_DOC = "concat_ws(' ', p_name, '', lower(p_type), p_brand, split_part(p_name, ' ', 1), p_type || ' ' || p_size, p_type, '')"
_HASH = """WITH d AS (SELECT p_partkey::VARCHAR || ':' || h AS d, h[1:2] AS slot FROM (SELECT p_partkey, sha256(concat_ws(chr(31), p_partkey::VARCHAR, p_name, p_brand, p_type, p_size::VARCHAR)) AS h FROM part)),
s AS (SELECT slot, sha256(string_agg(d, chr(10) ORDER BY d)) AS h, count(*) AS n FROM d GROUP BY slot)"""

ORACLES = {
    "token_stats": f"WITH {BQ}, {bm25_ctes('documents', 'bq')} SELECT n, round(avgdl, 6) AS avgdl, (SELECT sum(tf)::BIGINT FROM lexical_post) AS tokens, (SELECT count(DISTINCT term) FROM lexical_post) AS terms FROM lexical_st",
    "term_idf": f"WITH {BQ}, {bm25_ctes('documents', 'bq')} SELECT term, df, round(idf, 6) AS idf FROM lexical_ts",
    "bm25_topk": f"WITH {BQ}, {bm25_ctes('documents', 'bq')} SELECT query_id, doc_id, score, rank FROM lexical",
    "vocab_len_gt2": f"SELECT DISTINCT word FROM (SELECT unnest({TOK.format('text')}) AS word FROM documents) WHERE length(word) > 2",
    "tfidf_weights": r"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+'), lambda x: length(x) > 1) AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
r AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM r""",
    "exact_ip_topk": f"WITH {VEC}, {QV}, {exact_ctes(k=10)} SELECT query_id, doc_id, score, rank FROM dense",
    "lsh_signature": f"WITH {VEC} SELECT doc_id, {_signature('v')} AS sig FROM vec",
    "lsh_topk": f"WITH {VEC}, {QV}, {lsh_ctes()} SELECT * FROM lsh",
    "ann_overlap_recall": f"WITH {VEC}, {QV}, {lsh_ctes()}, {exact_ctes(k=10)} SELECT d.query_id, round(count(l.doc_id) / count(*), 4) AS recall FROM dense d LEFT JOIN lsh l USING (query_id, doc_id) GROUP BY 1",
    "lsh_sweep": " UNION ALL ".join(
        f"SELECT * FROM (WITH {VEC}, {QV}, {lsh_ctes(n=n)}, {exact_ctes(k=10)}, r AS (SELECT d.query_id, count(l.doc_id) / count(*) AS recall FROM dense d LEFT JOIN lsh l USING (query_id, doc_id) GROUP BY 1) "
        f"SELECT {n} AS planes, round(avg(recall), 4) AS recall, (SELECT round(avg(f), 4) FROM (SELECT max(fallback::INT) AS f FROM lsh GROUP BY query_id)) AS fallback_share FROM r)"
        for n in (10, 12, 16)
    ),
    "rrf_fusion": f"WITH {BQ}, {VEC}, {QV}, {bm25_ctes('documents', 'bq')}, {exact_ctes()}, {fuse_ctes(['lexical', 'dense'])} SELECT query_id, doc_id, score, rank FROM fused",
    "rank_trace": f"WITH {BQ}, {VEC}, {QV}, {bm25_ctes('documents', 'bq')}, {exact_ctes()}, {fuse_ctes(['lexical', 'dense'])} SELECT f.query_id, f.doc_id, f.rank AS hybrid_rank, f.score AS fusion_score, b.rank AS bm25_rank, d.rank AS dense_rank FROM fused f LEFT JOIN lexical b USING (query_id, doc_id) LEFT JOIN dense d USING (query_id, doc_id)",
    "minmax_rerank": f"""WITH {BQ}, {VEC}, {QV}, {bm25_ctes('documents', 'bq')}, {exact_ctes()}, {fuse_ctes(['lexical', 'dense'])},
c AS (SELECT f.query_id, f.doc_id, f.score AS fusion, coalesce(b.score, 0) AS bm25, coalesce(d.score, 0) AS dense FROM fused f LEFT JOIN lexical b USING (query_id, doc_id) LEFT JOIN dense d USING (query_id, doc_id)),
s AS (SELECT query_id, doc_id, round(0.28 * {_norm('bm25')} + 0.28 * {_norm('dense')} + 0.18 * {_norm('fusion')} + 0.02, 6) AS score FROM c)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 10""",
    "search_lab": f"{_search} {' UNION ALL '.join(_mode(x, 8, 'cf' if x in ('hybrid', 'reranked') else 'cw') for x in ('bm25', 'dense', 'hybrid', 'reranked'))}",
    "hybrid_search": f"{_search} {_mode('hybrid', 12, 'cf')}",
    "reranked_search": f"{_search} {_mode('reranked', 12, 'cf')}",
    "price_filter_after_topk": f"""WITH {PQ}, {PRODUCTS}, {constraints_ctes('pq')}, {bm25_ctes('products', 'asked')}
SELECT * FROM (SELECT query_id, doc_id, l.rank AS list_rank, row_number() OVER (PARTITION BY query_id ORDER BY l.rank)::INT AS rank, price FROM lexical l JOIN products USING (doc_id) JOIN asked USING (query_id) WHERE {ALLOWED}) WHERE rank <= 12""",
    "exact_filter_before_cut": f"""WITH {PQ}, {PRODUCTS}, {VEC}, {PQV}, {constraints_ctes('pq')}, {exact_ctes(k=1 << 60)}
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM dense_s JOIN products USING (doc_id) JOIN asked USING (query_id) WHERE {ALLOWED}) WHERE rank <= 12""",
    "parse_constraints": f"""WITH {PQ}, every AS (SELECT * FROM pq UNION ALL SELECT conv_id * 1000 + turn + 1000, text FROM conversations), {constraints_ctes('every')}
SELECT query_id, {', '.join(f'c_{n} AS {n}' for n in ('price_max', 'price_min', 'colour', 'brand', 'category', 'material', 'gender', 'comparative', 'similar'))} FROM asked""",
    "attribute_match": f"WITH {PQ}, {PRODUCTS}, {constraints_ctes('pq')} SELECT * FROM (SELECT query_id, doc_id, round({SHARE}, 6) AS share, array_to_string({LABELS}, ', ') AS matched FROM products, asked) WHERE share > 0",
    "search_documents": f"SELECT p_partkey AS doc_id, {_SEARCH_DOC} AS text FROM part",
    "retrieval_metrics": f"{_METHODS} SELECT method, query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM m",
    "metrics_by_slice": f"""{_METHODS} SELECT method, lang, query_type, count(*) AS queries, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg
FROM (SELECT m.*, lang, source AS query_type FROM m JOIN documents ON doc_id = query_id) GROUP BY GROUPING SETS ((method), (method, lang), (method, query_type))""",
    "first_relevant_rank": f"{_METHODS} SELECT method, query_id, first FROM m WHERE first IS NOT NULL",
    "ablation_delta": " UNION ALL ".join(
        f"SELECT * FROM ({_METHODS} SELECT '{c}' AS metric, '{a}' AS better, '{b}' AS base, round(round(avg({c}) FILTER (WHERE method = '{a}'), 4) - round(avg({c}) FILTER (WHERE method = '{b}'), 4), 4) AS delta FROM m)"
        for c, a, b in (("recall", "hybrid", "dense"), ("mrr", "reranked", "hybrid"), ("ndcg", "reranked", "hybrid"))
    ),
    "error_reasons": _REASONS,
    "worst_failures": f"{_REASONS} ORDER BY delta, query_id LIMIT 20",
    "latency_percentiles": f"SELECT event_type, {_LAT.format('value')} FROM events GROUP BY 1",
    "stage_latency": f"SELECT method, stage, {_LAT.format('ms')} FROM (SELECT event_type AS method, 'retrieval' AS stage, value AS ms FROM events UNION ALL SELECT event_type, 'ranking', value / 2 FROM events) GROUP BY ALL",
    "image_knn_self_excluded": f"WITH {VEC}, {QV}, {exact_ctes(k=6)} SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM dense WHERE query_id <> doc_id) WHERE rank <= 5",
    "multimodal_fusion": f"""{_search}, texts AS ({_reranked}), best AS (SELECT query_id, max(score) AS best FROM texts GROUP BY 1),
v AS (SELECT s.query_id, s.doc_id, s.score AS raw, p.* EXCLUDE (doc_id, text), a.* EXCLUDE (query_id, query) FROM dense_s s JOIN products p USING (doc_id) JOIN asked a USING (query_id)),
anchor AS (SELECT query_id, arg_min(category, (-raw, doc_id)) AS anchor FROM v GROUP BY 1),
f AS (SELECT *, {SHARE} AS share, {LABELS} AS labels FROM v JOIN anchor USING (query_id) WHERE (c_category IS NOT NULL OR category = anchor) AND {ALLOWED}),
s AS (SELECT f.*, coalesce(t.score, 0) / greatest(coalesce(best, 1.0), 1e-9) AS ts FROM f LEFT JOIN texts t USING (query_id, doc_id) LEFT JOIN best USING (query_id)),
z AS (SELECT *, round(0.5::DOUBLE / (0.5::DOUBLE + 0.2 + 0.1) * greatest(raw, 0) + 0.2::DOUBLE / (0.5::DOUBLE + 0.2 + 0.1) * ts + 0.1::DOUBLE / (0.5::DOUBLE + 0.2 + 0.1) * share, 6) AS score FROM s)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, price, doc_id)::INT AS rank, doc_id, title, price, score, round(greatest(raw, 0), 6) AS visual, round(ts, 6) AS text_score, round(share, 6) AS attribute, array_to_string(labels, ', ') AS matched FROM z) WHERE rank <= 12""",
    "search_log": f"""{_search}, found AS ({_mode('hybrid', 12, 'cf')})
SELECT query_id, query AS original_query, query AS normalized_query, 'hybrid' AS mode, count(doc_id) AS results, max(score) AS best FROM pq LEFT JOIN found USING (query_id) GROUP BY ALL""",
    "stored_index_topk": f"WITH {VEC}, {QV}, {lsh_ctes()} SELECT * FROM lsh",
    "image_metrics": f"{_IMAGES} SELECT 'image' AS modality, query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM im",
    "weakest_images": f"{_IMAGES} SELECT row_number() OVER (ORDER BY recall, query_id)::INT AS place, query_id, round(recall, 6) AS recall FROM (SELECT * FROM im ORDER BY recall, query_id LIMIT 5)",
    "rewrite_queries": f"WITH {PQ} SELECT query_id, {REWRITE} AS normalized FROM pq",
    "idempotent_seed": "SELECT p_partkey, p_name FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, p_name FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey = a.p_partkey AND b.p_size <= 25)",
    "golden_builder": """WITH g AS (SELECT item_id, b.text AS query, CASE WHEN item_id % 2 = 0 THEN 'hindi' ELSE 'exact' END AS type, row_number() OVER (ORDER BY item_id) AS n FROM benchmark b JOIN labels l ON l.doc_id = item_id WHERE quality = 1)
SELECT printf('text-%03d', n) AS query_id, query, CASE type WHEN 'hindi' THEN 'hi' ELSE 'en' END AS language, 'text' AS modality, type AS query_type, NULL::VARCHAR AS query_image_id, item_id::VARCHAR AS relevant FROM g
UNION ALL SELECT printf('telugu-%03d', n), query, 'te', 'text', type, NULL, item_id::VARCHAR FROM g
UNION ALL SELECT printf('image-%03d', n), '', 'none', 'image', 'image_to_image', 'img-' || item_id, item_id::VARCHAR FROM g
UNION ALL SELECT printf('multimodal-%03d', n), query, 'en', 'multimodal', 'image_plus_text', 'img-' || item_id, item_id::VARCHAR FROM g""",
    "golden_validate": """WITH r AS (SELECT 'c-' || conv_id AS query_id, CASE WHEN turn = 0 THEN '' ELSE text END AS query, CASE WHEN role = 'user' THEN 'text' ELSE 'image' END AS modality, CASE WHEN turn % 2 = 1 THEN 'img' END AS image FROM conversations),
v AS (SELECT query_id, 'text query has no text' AS violation FROM r WHERE modality = 'text' AND coalesce(trim(query) = '', true)
UNION ALL SELECT query_id, 'query needs query_image_id' FROM r WHERE modality = 'image' AND image IS NULL
UNION ALL SELECT query_id, 'duplicate query_id' FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT query_id, violation, count(*) AS n FROM v GROUP BY ALL""",
    "catalog_hash": f"{_HASH} SELECT sum(n)::BIGINT AS rows, sha256(string_agg(h, chr(10) ORDER BY slot)) AS content_hash FROM s",
    "index_manifest": f"{_HASH} SELECT 1 AS version, 'lightweight' AS mode, sum(n)::BIGINT AS rows, sha256(string_agg(h, chr(10) ORDER BY slot)) AS content_hash, 64 AS dim, 'hyperplane' AS backend FROM s",
    "index_status": "SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS vectors, max(len(embedding))::INT AS dim, sum(len(embedding) * 4)::BIGINT AS vector_bytes, 10 AS planes FROM embeddings",
    "product_lookup": "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part WHERE p_partkey IN (SELECT doc_id FROM labels)",
}
