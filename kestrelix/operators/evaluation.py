"""Ranking metrics, latency summaries and error analysis as DataFrame aggregations.

Rankings are (method, query_id, doc_id, rank); judgements are (query_id, doc_id, grade).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_k(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def query_metrics(ranking: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(method, query_id, precision, recall, mrr, ndcg) for every method and judged query.

    Precision divides by k however short the list; recall and nDCG are 0 without a relevant
    document; MRR looks at the whole list; the ideal order is grade, then id.
    """
    check_k(k)
    relevant = judged.where("grade > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), F.asc("doc_id"))
    ideal = judged.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    totals = judged.groupBy("query_id").agg(F.count(F.when(F.col("grade") > 0, 1)).alias("n_rel"))
    totals = totals.join(ideal.groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("r"))).alias("idcg")), "query_id", "left")
    hits = ranking.join(relevant, ["query_id", "doc_id"])
    inside = F.col("rank") <= k
    per = hits.groupBy("method", "query_id").agg(
        F.count(F.when(inside, 1)).alias("hits"),
        F.min("rank").alias("first"),
        F.sum(F.when(inside, gain(F.col("grade"), F.col("rank")))).alias("dcg"),
    )
    every = ranking.select("method", "query_id").distinct().join(totals, "query_id")
    rows = every.join(per, ["method", "query_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "method",
        "query_id",
        zero(F.col("hits") / k).alias("precision"),
        zero(F.when(F.col("n_rel") > 0, F.col("hits") / F.col("n_rel"))).alias("recall"),
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg"),
        "first",
    )


METRICS = ("precision", "recall", "mrr", "ndcg")


def metric_slices(metrics: DataFrame, slices: list[str]) -> DataFrame:
    """Rounded means overall and by each slice column, for every method, in one aggregation."""
    sets = [[F.col("method")]] + [[F.col("method"), F.col(s)] for s in slices]
    means = [F.round(F.avg(m), 4).alias(m) for m in METRICS]
    return metrics.groupingSets(sets, "method", *slices).agg(F.count("*").alias("queries"), *means)


def overlap_recall(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of the exact k nearest that the approximate k hold."""
    check_k(k)
    a = approx.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("found"))
    e = exact.where(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    return e.join(a, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.count("found") / F.count("*")).alias("recall"))


def latency_summary(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """samples, p50, p95, p99 (null below 50 samples) and mean, interpolated, to 4 places."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    rows = samples.groupBy(*by).agg(F.count(value).alias("samples"), q.alias("q"), F.avg(value).alias("mean"))
    part = lambda i: F.round(F.get("q", F.lit(i)), 4)
    return rows.select(
        *by, "samples", F.coalesce(part(0), F.lit(0.0)).alias("p50"), F.coalesce(part(1), F.lit(0.0)).alias("p95"),
        F.when(F.col("samples") >= 50, part(2)).alias("p99"), F.coalesce(F.round("mean", 4), F.lit(0.0)).alias("mean"),
    )


def stage_latency(runs: DataFrame) -> DataFrame:
    """Summary for each stage of each method from (method, timings map)."""
    return latency_summary(runs.select("method", F.explode("timings").alias("stage", "ms")), ["method", "stage"], "ms")


def pivoted(metrics: DataFrame, column: str, methods: list[str]) -> DataFrame:
    """(query_id, one column for each method)."""
    return metrics.groupBy("query_id").pivot("method", methods).agg(F.first(column))


def ablation(metrics: DataFrame, steps: list[tuple[str, str, str]]) -> DataFrame:
    """(metric, better, base, delta): difference of the means of two methods, to 4 places."""
    out = None
    for column, better, base in steps:
        mean = lambda m: F.round(F.avg(F.when(F.col("method") == m, F.col(column))), 4)  # noqa: B023, E731
        row = metrics.agg(F.round(mean(better) - mean(base), 4).alias("delta"))
        row = row.select(F.lit(column).alias("metric"), F.lit(better).alias("better"), F.lit(base).alias("base"), "delta")
        out = row if out is None else out.unionByName(row)
    return out


# fixed values: the rules of the error analysis
RULES = [
    "lexical search finds a relevant document earlier than dense search",
    "dense search finds a relevant document earlier than lexical search",
    "reranking lowers the nDCG of the query",
    "approximate search ranks the first relevant document below exact search",
    "a multilingual query misses labelled documents",
]


def error_reasons(metrics: DataFrame, languages: DataFrame, most: int | None = None, multilingual=("hi", "te", "hinglish")) -> DataFrame:
    """(query_id, language, delta, reasons) of the queries that a rule catches, worst first.

    Methods: bm25, dense, dense_exact, hybrid and reranked; ``languages``: (query_id, language).
    """
    methods = ["bm25", "dense", "dense_exact", "hybrid", "reranked"]
    first = pivoted(metrics, "first", methods).select("query_id", *[F.col(m).alias(f"f_{m}") for m in methods])
    ndcg = pivoted(metrics, "ndcg", methods).select("query_id", *[F.col(m).alias(f"n_{m}") for m in methods])
    recall = metrics.where("method = 'reranked'").select("query_id", "recall")
    rows = first.join(ndcg, "query_id").join(recall, "query_id", "left").join(languages, "query_id")
    earlier = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) < F.col(b)))
    caught = [
        earlier("f_bm25", "f_dense"),
        earlier("f_dense", "f_bm25"),
        F.col("n_reranked") + 1e-12 < F.col("n_hybrid"),
        earlier("f_dense_exact", "f_dense"),
        F.col("language").isin(list(multilingual)) & (F.col("recall") < 1),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in zip(caught, RULES)]))
    out = rows.select("query_id", "language", F.round(F.col("n_reranked") - F.col("n_hybrid"), 6).alias("delta"), F.array_join(reasons, "; ").alias("reasons"))
    out = out.where("reasons <> ''")
    return out.orderBy("delta", "query_id").limit(most) if most else out
