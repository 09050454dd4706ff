"""Lexical and vector retrieval for batches of queries in one plan."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelix.functions.text import tokens
from kestrelix.sources.store import staged

CANDIDATES = 60
K1, B = 1.5, 0.75
K0 = 60
SEED = 23
QUERY_CELLS = 1 << 22  # numbers of 8 bytes in the queries of one scan: 32 MB
BROADCAST_ROWS = 500_000  # query terms of about 40 bytes


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf)."""
    terms = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, post: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row: n (all documents, token-less ones included) and avgdl."""
    total = post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("t")).scalar()
    return docs.agg(F.count("*").alias("n")).select("n", (total / F.greatest(F.lit(1), "n")).alias("avgdl"))


def term_stats(post: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    n = stats.select("n").scalar()
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def top(df: DataFrame, k: int, by: list[Column], group: str = "query_id") -> DataFrame:
    """The first k rows of each query with their 1-based ``rank``."""
    w = Window.partitionBy(group).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def matched(terms: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl): the postings of the given distinct terms, and one row with an empty
    term for every document, in one pass over the texts. dl counts all words of a document.

    Only these rows leave the pass; the statistics of the whole corpus follow from them.
    """
    words = docs.select(F.col(id_col).alias("doc_id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    words = words.select("doc_id", F.size("w").alias("size"), F.explode(F.concat("w", F.array(F.lit("")))).alias("term"))
    wanted = terms.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string"))
    wanted = F.broadcast(wanted) if terms.count() <= BROADCAST_ROWS else wanted
    found = words.join(wanted, "term").groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.sum(F.when(F.col("term") == "", F.col("size"))).alias("size"))
    return found.select("doc_id", "term", "tf", F.sum("size").over(Window.partitionBy("doc_id")).alias("dl"))


def _counted(batches, known):
    """(doc_id, dl, term numbers, counts) from (doc_id, words): how often each document has the known terms."""
    for batch in batches:
        words = batch.column(1)
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        found = pc.index_in(words.flatten(), value_set=known)
        has = found.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(words)), np.diff(ends))[has]
        both, tf = np.unique(row * len(known) + found.drop_null().to_numpy().astype(np.int64), return_counts=True)
        row, term = np.divmod(both, max(1, len(known)))
        at = pa.array(np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (term, tf)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), *lists], names=["doc_id", "dl", "terms", "tfs"])


def _best_scores(batches, matrix, avgdl, k):
    """(q, doc_id, score): rows that may be among the k best, from (doc_id, dl, terms, tfs) and weights by term and query.

    A score below the k-th best that the task has met cannot be among them; equal ones stay.
    """
    least = np.full(matrix.shape[1], -np.inf)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            dl, ends = part.column(1).to_numpy(), part.column(2).offsets.to_numpy()
            row = np.repeat(np.arange(len(dl)), np.diff(ends))
            tf = part.column(3).flatten().to_numpy().astype(np.float64)
            cells = np.zeros((len(dl), matrix.shape[0]))
            cells[row, part.column(2).flatten().to_numpy()] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl))
            scores = np.round(cells @ matrix, 6)
            if len(dl) >= k:
                least = np.maximum(least, np.partition(scores, len(dl) - k, axis=0)[len(dl) - k])
            i, q = np.nonzero((scores > 0) & (scores >= least))
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), part.column(0).take(pa.array(i)), pa.array(scores[i, q])], names=["q", "doc_id", "score"])


def _bm25_in_place(asked: DataFrame, known: list, ids: list, docs: DataFrame, k: int) -> DataFrame:
    """:func:`bm25` for a batch whose weights every task may hold: documents are counted and scored where they are read."""
    spark, key = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    words = docs.select("doc_id", tokens(F.coalesce(F.col("text"), F.lit(""))).alias("w"))
    rows = staged(words.mapInArrow(partial(_counted, known=pa.array(known, pa.string())), f"doc_id {key}, dl long, terms array<int>, tfs array<int>"), "postings")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("id"))
    if not (twice := staged(twice, "repeated")).isEmpty():
        # rows of one id are one document
        same = F.col("doc_id").eqNullSafe(F.col("id"))
        each = rows.join(twice, same, "left_semi").select("doc_id", "dl", F.explode(F.concat(F.arrays_zip("terms", "tfs"), F.array(F.struct(F.lit(-1).alias("terms"), F.lit(0).alias("tfs"))))).alias("x"))
        each = each.groupBy("doc_id", F.col("x.terms").alias("term")).agg(F.sum("x.tfs").cast("int").alias("tf"), F.sum("dl").alias("dl"))
        inside = lambda c: F.collect_list(F.when(F.col("term") >= 0, F.col(c)))
        each = each.groupBy("doc_id").agg(F.max(F.when(F.col("term") < 0, F.col("dl"))).alias("dl"), inside("term").alias("terms"), inside("tf").alias("tfs"))
        rows = staged(rows.join(twice, same, "left_anti").unionByName(each), "merged")
    n = total["n"]
    df = {r["term"]: r["c"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("c")).collect()}
    term, query = ({x: i for i, x in enumerate(xs)} for xs in (known, ids))
    matrix = np.zeros((len(known), len(ids)))
    for r in asked.toLocalIterator():
        c = df.get(term[r["term"]], 0)
        matrix[term[r["term"]], query[r["query_id"]]] = r["qtf"] * np.log(1 + (n - c + 0.5) / (c + 0.5))
    best = rows.mapInArrow(partial(_best_scores, matrix=matrix, avgdl=max(total["t"] / max(1, n), 1e-9), k=k), f"q int, doc_id {key}, score double")
    names = spark.createDataFrame([(i, x) for x, i in query.items()], f"q int, query_id {dict(asked.dtypes)['query_id']}")
    return top(best.join(F.broadcast(names), "q").select("query_id", "doc_id", "score"), k, [F.desc("score"), F.asc("doc_id")])


def bm25(queries: DataFrame, docs: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, doc_id, score, rank): repeated query terms count again, ties to smaller ids.

    The texts are read once: the postings that hold a query term are written with the lengths
    of all documents, and counts, idf and scores follow from that table. A batch of up to
    QUERY_CELLS terms by queries is scored where the documents lie, a larger one by joins. Scores
    are rounded before ranking so that the order of summation cannot swap ties.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = staged(asked, "asked")
    size = asked.agg(F.countDistinct("term").alias("terms"), F.countDistinct("query_id").alias("queries"), F.count(F.when(F.col("query_id").isNull(), 1)).alias("unnamed")).first()
    if 0 < size["terms"] * size["queries"] <= QUERY_CELLS // 4 and not size["unnamed"]:
        known, ids = ([r[0] for r in asked.select(c).distinct().orderBy(c).collect()] for c in ("term", "query_id"))
        return _bm25_in_place(asked, known, ids, docs, k)
    rows = staged(matched(asked.select("term").distinct(), docs), "postings")
    total = rows.where("term = ''").agg(F.sum("tf").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
    n = total["n"] or 0
    avgdl = max(total["t"] / max(1, n), 1e-9)
    post = rows.where("term <> ''")
    idf = post.groupBy("term").agg(F.ln(1 + (n - F.count("*") + 0.5) / (F.count("*") + 0.5)).alias("idf"))
    weighted = staged(asked.join(idf, "term"), "weights")
    weighted = F.broadcast(weighted) if weighted.count() <= BROADCAST_ROWS else weighted
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl)
    score = F.sum(F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / norm)
    scored = post.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.round(score, 6).alias("score")).where("score > 0")
    return top(scored, k, [F.desc("score"), F.asc("doc_id")])


def _best_rows(batches, ids, matrix, k):
    """The k best rows of each batch for each query, by one matrix product."""
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        rows = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        for at in range(0, len(ids), 512):
            scores = np.round(matrix[at : at + 512] @ rows.T, 6)
            pick = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids[at : at + 512], pick.shape[1])), pa.array(keys[pick].reshape(-1)), pa.array(np.take_along_axis(scores, pick, 1).reshape(-1))],
                names=["query_id", "doc_id", "score"],
            )


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) by inner product of (query_id, v) with (doc_id, v).

    Queries travel to the vectors, which are scanned in place without a shuffle, once for
    QUERY_CELLS numbers of queries; only k rows a query and batch go on to the final ranking.
    """
    asked = queries.select(F.col("query_id").cast("long"), "v").where("v is not null").toLocalIterator()
    data = vectors.select(F.col("doc_id").cast("long"), "v").where("v is not null")
    out, ids, rows = None, [], []

    def flush(out):
        part = data.mapInArrow(partial(_best_rows, ids=np.array(ids, np.int64), matrix=np.array(rows, np.float64), k=k), "query_id long, doc_id long, score double")
        return part if out is None else out.unionByName(part)

    for r in asked:
        ids.append(r["query_id"]), rows.append(r["v"])
        if len(ids) * max(1, len(rows[0])) >= QUERY_CELLS:
            out, ids, rows = flush(out), [], []
    if ids or out is None:
        if not ids:
            return queries.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
        out = flush(out)
    return top(out, k, [F.desc("score"), F.asc("doc_id")])


def plane_count(dim: int) -> int:
    return min(24, max(10, dim // 16))


def planes(dim: int, n: int | None = None, seed: int = SEED) -> np.ndarray:
    """Random hyperplanes [dim, n]; the same for the same seed."""
    return np.random.default_rng(seed).standard_normal((dim, n or plane_count(dim)), dtype=np.float32)


def signature(v: Column, hyperplanes: np.ndarray) -> Column:
    """One bit a plane: is the projection not negative?"""
    bits = []
    for j in range(hyperplanes.shape[1]):
        weights = F.array(*[F.lit(float(x)) for x in hyperplanes[:, j]])
        dot = F.aggregate(F.zip_with(v, weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
        bits.append(F.when(dot >= 0, F.lit(1 << j)).otherwise(F.lit(0)))
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total.cast("bigint")


def signed(rows: DataFrame, hyperplanes: np.ndarray) -> DataFrame:
    """Adds ``sig`` to rows with a vector ``v``: the bits of :func:`signature`, one matrix product a batch."""
    weights = (1 << np.arange(hyperplanes.shape[1])).astype(np.int64)
    at, names = rows.columns.index("v"), [*rows.columns, "sig"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.stack(batch.column(at).to_numpy(zero_copy_only=False)).astype(np.float64)
                sig = (v @ hyperplanes.astype(np.float64) >= 0) @ weights
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sig.astype(np.int64))], names=names)

    shape = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.where("v is not null").mapInArrow(run, f"{shape}, sig bigint")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def lsh_topk(queries: DataFrame, vectors: DataFrame, k: int, hyperplanes: np.ndarray) -> DataFrame:
    """(query_id, doc_id, score, rank, fallback): hashed search with an exact fallback.

    A query takes the vectors whose signature differs in at most one bit, if these are
    fewer than k in at most two, and else all of them (``fallback``). Probing enumerates
    the signatures within two bits, so candidates come from an equi-join. Vectors that bring
    their ``sig`` (a stored index) are not signed again.
    """
    n = hyperplanes.shape[1]
    masks = [(0, 0)] + [(1 << i, 1) for i in range(n)] + [((1 << i) | (1 << j), 2) for i in range(n) for j in range(i)]
    asked = signed(queries.select("query_id", "v"), hyperplanes)
    probe = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(r).alias("r")) for m, r in masks])
    probes = asked.select("query_id", "v", F.explode(probe).alias("x"), "sig").select("query_id", F.col("v").alias("q"), F.col("sig").bitwiseXOR(F.col("x.m")).alias("sig"), "x.r")
    filed = vectors if "sig" in vectors.columns else staged(signed(vectors.select("doc_id", "v"), hyperplanes), "signatures")
    sizes = filed.groupBy("sig").agg(F.count("*").alias("c"))
    near = probes.join(sizes, "sig").groupBy("query_id").agg(F.sum(F.when(F.col("r") <= 1, F.col("c")).otherwise(0)).alias("one"), F.sum("c").alias("two"))
    radius = F.when(F.coalesce("one", F.lit(0)) >= k, 1).when(F.coalesce("two", F.lit(0)) >= k, 2)
    chosen = asked.select("query_id").join(near, "query_id", "left").select("query_id", radius.alias("radius"))
    pool = probes.join(chosen.where("radius is not null"), "query_id").where(F.col("r") <= F.col("radius")).join(filed, "sig")
    pool = pool.select("query_id", "doc_id", F.round(dot(F.col("q"), F.col("v")), 6).alias("score"))
    hashed = top(pool, k, [F.desc("score"), F.asc("doc_id")]).withColumn("fallback", F.lit(False))
    rest = asked.join(chosen.where("radius is null"), "query_id", "left_semi").select("query_id", "v")
    return hashed.unionByName(exact_topk(rest, vectors, k).withColumn("fallback", F.lit(True)))


def fuse(rankings: list[DataFrame], k: int = CANDIDATES, k0: int = K0) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, doc_id, rank) lists; ties to smaller ids."""
    both = rankings[0].select("query_id", "doc_id", "rank")
    for r in rankings[1:]:
        both = both.union(r.select("query_id", "doc_id", "rank"))
    fused = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (k0 + F.col("rank"))), 9).alias("score"))
    return top(fused, k, [F.desc("score"), F.asc("doc_id")])


def minmax(x: Column, group: str = "query_id") -> Column:
    """(x - min) / (max - min) over the candidates of a query, 0 where they are all equal."""
    w = Window.partitionBy(group)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(hi <= lo, F.lit(0.0)).otherwise((x - lo) / (hi - lo))
