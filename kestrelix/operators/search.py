"""Hybrid text search, image search and image-with-text search over a product catalogue.

Products are rows (doc_id, text, title, category, product_type, colour, brand, material,
gender, price); vectors are (doc_id, v); a batch of queries is one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelix.functions.text import attribute_match, category_hit, constraints, correct, price_allowed, tokens
from kestrelix.operators.retrieval import CANDIDATES, bm25, dot, exact_topk, fuse, lsh_topk, minmax, top
from kestrelix.sources.store import staged

QUERIES = 4096  # vectors of a query batch that every task may hold
MODES = ("bm25", "dense", "hybrid", "reranked")
# fixed values: weights of the ranking formulas
RERANK = {"bm25": 0.28, "dense": 0.28, "fusion": 0.18, "attribute": 0.20, "category": 0.08, "confidence": 0.02}
MULTIMODAL = {"visual": 0.50, "text": 0.20, "crossmodal": 0.20, "attribute": 0.10}
PRODUCT = ["price", "colour", "brand", "material", "gender", "category", "product_type"]


def check_request(mode: str, k: int, most: int = 50, query: str | None = None) -> None:
    """What a request may ask for: a known mode, 1 to ``most`` results, 1 to 300 characters."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if query is not None and not 1 <= len(query) <= 300:
        raise ValueError("query must have 1 to 300 characters")
    if not 1 <= k <= most:
        raise ValueError(f"k must be between 1 and {most}")


def vocabulary(products: DataFrame) -> DataFrame:
    """Distinct catalogue tokens of more than two letters: (word)."""
    words = products.select(F.explode(tokens(F.col("text"))).alias("word"))
    return words.where(F.length("word") > 2).distinct()


def understood(queries: DataFrame, products: DataFrame, normalize: bool = True) -> DataFrame:
    """Corrected queries with a column for each constraint they state."""
    if normalize:
        q = correct(queries, vocabulary(products)).select("query_id", F.col("corrected").alias("query"), "confidence")
    else:
        q = queries.select("query_id", "query", F.lit(1.0).alias("confidence"))
    return q.select("query_id", "query", "confidence", *[c.alias(f"c_{n}") for n, c in constraints(F.col("query")).items()])


def _c() -> dict:
    return {n: F.col(f"c_{n}") for n in ("price_max", "price_min", "colour", "brand", "category", "material", "gender")}


def _p() -> dict:
    return {n: F.col(n) for n in PRODUCT}


def rankings(queries: DataFrame, products: DataFrame, vectors: DataFrame, query_vectors: DataFrame, hyperplanes=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The capped lexical, dense and fused lists that all modes share."""
    lexical = bm25(queries, products)
    if hyperplanes is None:
        dense = exact_topk(query_vectors, vectors, CANDIDATES)
    else:
        dense = lsh_topk(query_vectors, vectors, CANDIDATES, hyperplanes)
    lexical, dense = staged(lexical, "lexical"), staged(dense, "dense")
    return lexical, dense, staged(fuse([lexical, dense]), "fused")


def valid_queries(queries: DataFrame) -> DataFrame:
    """The rows of a batch whose query has 1 to 300 characters; the others are not searched."""
    return queries.where(F.length("query").between(1, 300))


def candidates(asked: DataFrame, lexical: DataFrame, dense: DataFrame, fused: DataFrame, products: DataFrame) -> DataFrame:
    """Fused candidates with all scores and ranks (0 and null where a list lacks them).

    Minima and maxima are those of all candidates, before any filter.
    """
    rows = fused.select("query_id", "doc_id", F.col("score").alias("fusion"), F.col("rank").alias("hybrid_rank"))
    for name, listed in (("bm25", lexical), ("dense", dense)):
        rows = rows.join(listed.select("query_id", "doc_id", F.col("score").alias(name), F.col("rank").alias(f"{name}_rank")), ["query_id", "doc_id"], "left")
        rows = rows.withColumn(name, F.coalesce(name, F.lit(0.0)))
    for name in ("bm25", "dense", "fusion"):
        rows = rows.withColumn(f"n_{name}", minmax(F.col(name)))
    return rows.join(products.select("doc_id", "title", *PRODUCT), "doc_id").join(asked, "query_id")


def ranked(rows: DataFrame, mode: str, k: int) -> DataFrame:
    """Results of one mode from :func:`candidates`; price filter after the cap, then top k."""
    share, labels = attribute_match(_c(), _p())
    rows = rows.withColumn("attribute", share).withColumn("matched", labels)
    bonus = F.when(F.col("c_category").isNotNull() & category_hit(F.col("c_category"), _p()), F.lit(RERANK["category"])).otherwise(F.lit(0.0))
    rows = rows.where(price_allowed(_c(), F.col("price")))
    if mode == "reranked":
        score = (
            RERANK["bm25"] * F.col("n_bm25") + RERANK["dense"] * F.col("n_dense") + RERANK["fusion"] * F.col("n_fusion")
            + RERANK["attribute"] * F.col("attribute") + bonus + RERANK["confidence"] * F.col("confidence")
        )
        reason = F.concat_ws(" + ", F.lit("hybrid relevance"), F.nullif(F.array_join(F.slice("matched", 1, 3), ", "), F.lit("")))
        order = [F.desc("score"), F.asc("price"), F.asc("doc_id")]
    else:
        rows = rows.where(F.col(f"{mode}_rank").isNotNull())
        score = F.col("fusion" if mode == "hybrid" else mode)
        reason = F.lit({"bm25": "lexical term match", "dense": "dense vector similarity", "hybrid": "reciprocal-rank fusion"}[mode])
        order = [F.asc(f"{mode}_rank")]
    rows = rows.withColumn("score", F.round(score, 6))
    return top(rows, k, order).select(
        "query_id", F.lit(mode).alias("mode"), "rank", "doc_id", "title", "price", "score", F.array_join("matched", ", ").alias("matched"), reason.alias("reason"),
        "bm25_rank", "dense_rank", "hybrid_rank", F.round("attribute", 6).alias("attribute"),
    )


def search_text(queries, products, vectors, query_vectors, mode: str = "reranked", k: int = 12, normalize: bool = True, hyperplanes=None) -> DataFrame:
    """Text search in one of the four modes.

    The single-list modes rank their own capped list, the others the fused one.
    """
    check_request(mode, k)
    return _search(queries, products, vectors, query_vectors, [mode], k, normalize, hyperplanes)


def search_lab(queries, products, vectors, query_vectors, k: int = 8, normalize: bool = True, hyperplanes=None) -> DataFrame:
    """All four modes side by side; they share the ranked lists."""
    check_request("bm25", k, 20)
    return _search(queries, products, vectors, query_vectors, MODES, k, normalize, hyperplanes)


def _search(queries, products, vectors, query_vectors, modes, k, normalize, hyperplanes):
    asked = staged(understood(queries, products, normalize), "understood")
    lexical, dense, fused = rankings(asked, products, vectors, query_vectors, hyperplanes)
    out = None
    for mode in modes:
        listed = fused if mode in ("hybrid", "reranked") else fuse([lexical, dense], 2 * CANDIDATES)
        rows = ranked(candidates(asked, lexical, dense, listed, products), mode, k)
        out = rows if out is None else out.unionByName(rows)
    return out


def search_image(query_vectors: DataFrame, vectors: DataFrame, k: int = 12, exclude_self: bool = False, hyperplanes=None) -> DataFrame:
    """Nearest images; for evaluation the query item itself can be left out (k + 1 are found)."""
    wide = k + 1 if exclude_self else k
    found = exact_topk(query_vectors, vectors, wide) if hyperplanes is None else lsh_topk(query_vectors, vectors, wide, hyperplanes)
    if exclude_self:
        found = found.where("query_id <> doc_id")
    return top(found.select("query_id", "doc_id", "score"), k, [F.desc("score"), F.asc("doc_id")])


def fusion_weights(has_text: bool, has_crossmodal: bool, weights: dict | None = None) -> dict[str, float]:
    """Weights of the active terms, scaled to sum to 1."""
    w = dict(weights or MULTIMODAL)
    if not has_text:
        w["text"] = w["attribute"] = w["crossmodal"] = 0.0
    if not has_crossmodal:
        w["crossmodal"] = 0.0
    total = sum(w.values())
    if total <= 0:
        raise ValueError("weights must sum to a positive value")
    return {n: x / total for n, x in w.items()}


def search_multimodal(queries, products, vectors, image_vectors, text_vectors, k: int = 12, normalize: bool = True, crossmodal=None, weights=None) -> DataFrame:
    """Image and text together for (query_id, query); ``crossmodal``: (query_id, doc_id, score).

    Every product that the filters leave is scored against the query image where it is read,
    and each task passes on its best k rows a query. Without a stated category only those of
    the category of the nearest image compete. Text scores are those of a reranked search
    with no cut but its candidate cap, rounded, relative to the best of the query.
    """
    asked = understood(queries.withColumn("query", F.when(F.col("query") == "", "similar").otherwise(F.col("query"))), products, normalize)
    texted = queries.where(F.trim("query") != "")
    asked = staged(asked, "understood")
    known = products.select("doc_id", "title", *PRODUCT)
    nearest = exact_topk(image_vectors.select("query_id", "v"), vectors.join(known.select("doc_id"), "doc_id", "left_semi"), 1)
    anchor = nearest.select("query_id", "doc_id").join(known.select("doc_id", F.col("category").alias("anchor")), "doc_id").select("query_id", "anchor")
    wanted = image_vectors.select("query_id", F.col("v").alias("qv")).join(asked, "query_id").join(anchor, "query_id")
    wanted = wanted.join(texted.select("query_id", F.lit(True).alias("has_text")), "query_id", "left")
    allowed = (F.col("c_category").isNotNull() | (F.col("category") == F.col("anchor"))) & price_allowed(_c(), F.col("price"))
    rows = scored(staged(wanted, "wanted"), vectors.join(known, "doc_id"), allowed)
    text = _search(texted, products, vectors, text_vectors, ["reranked"], CANDIDATES, normalize, None).select("query_id", "doc_id", F.col("score").alias("text_raw"))
    best = text.groupBy("query_id").agg(F.max("text_raw").alias("best"))
    text = F.broadcast(staged(text.join(best, "query_id"), "texts"))  # CANDIDATES rows a query
    rows = rows.join(text, ["query_id", "doc_id"], "left")
    rows = rows.withColumn("text_score", F.coalesce("text_raw", F.lit(0.0)) / F.greatest(F.coalesce("best", F.lit(1.0)), F.lit(1e-9)))
    if crossmodal is not None:
        rows = rows.join(crossmodal.select("query_id", "doc_id", F.col("score").alias("cross")), ["query_id", "doc_id"], "left")
        cross = F.greatest(F.coalesce("cross", F.lit(0.0)), F.lit(0.0))
    else:
        cross = F.lit(0.0)
    share, labels = attribute_match(_c(), _p())
    rows = rows.withColumn("attribute", share).withColumn("matched", labels)
    with_text, without = fusion_weights(True, crossmodal is not None, weights), fusion_weights(False, False, weights)
    w = {n: F.when(F.col("has_text"), with_text[n]).otherwise(without[n]) for n in with_text}
    seen = F.greatest(F.col("visual_raw"), F.lit(0.0))
    score = w["visual"] * seen + w["text"] * F.col("text_score") + w["crossmodal"] * cross + w["attribute"] * F.col("attribute")
    rows = rows.withColumn("score", F.round(score, 6)).withColumn("visual", F.round(seen, 6))
    return top(rows, k, [F.desc("score"), F.asc("price"), F.asc("doc_id")]).select(
        "query_id", "rank", "doc_id", "title", "price", "score", "visual", F.round("text_score", 6).alias("text_score"), F.round("attribute", 6).alias("attribute"), F.array_join("matched", ", ").alias("matched")
    )


def scored(wanted: DataFrame, items: DataFrame, allowed) -> DataFrame:
    """Every allowed item (doc_id, v, ...) with every query (query_id, qv, ...): adds ``visual_raw``.

    The filter comes before the product. A batch of at most QUERIES queries travels to the
    items, which are never shuffled; a larger one is dealt over the tasks that read them.
    """
    wanted = F.broadcast(wanted) if wanted.count() <= QUERIES else wanted
    pairs = items.join(wanted, allowed).where("v is not null and qv is not null")
    return pairs.withColumn("visual_raw", F.round(dot(F.col("qv"), F.col("v")), 6)).drop("v", "qv")


def trace(lexical: DataFrame, dense: DataFrame, fused: DataFrame) -> DataFrame:
    """Ranks of every document in each list, for debugging."""
    rows = fused.select("query_id", "doc_id", F.col("rank").alias("hybrid_rank"), F.col("score").alias("fusion_score"))
    for name, listed in (("bm25", lexical), ("dense", dense)):
        rows = rows.join(listed.select("query_id", "doc_id", F.col("rank").alias(f"{name}_rank")), ["query_id", "doc_id"], "left")
    return rows
