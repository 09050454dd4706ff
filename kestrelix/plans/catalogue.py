"""Registry of the queries that cover the engine's own operators, with their SQL.

``documents`` stand for the searchable corpus, ``benchmark`` for the query batch,
``embeddings`` for text and image vectors (by id; equal labels are relevant), ``part`` for
the product catalogue and ``events`` for latency samples.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelix.functions import text as T
from kestrelix.operators import evaluation as E
from kestrelix.operators import lsi, retrieval, search
from kestrelix.plans.oracles import ORACLES, PRODUCT_QUERIES
from kestrelix.operators import reporting
from kestrelix.sources import catalog, index
from kestrelix.sources.store import shared_dir, staged

DIM = 64


def _read(spark, sf_dir: str, name: str) -> DataFrame:
    # a union must not promise its inputs' partitioning: adaptive execution may still change it
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


def _asked(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))


def _asked_vectors(spark, sf_dir):
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(_vectors(spark, sf_dir), F.col("query_id") == F.col("doc_id")).select("query_id", "v")


def _products(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    none = F.lit(None).cast("string")
    return part.select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_name", "p_brand", F.lower("p_type")).alias("text"),
        F.lower("p_type").alias("category"), F.get(words, F.lit(1)).alias("product_type"), F.get(words, F.lit(0)).alias("colour"),
        F.col("p_brand").alias("brand"), none.alias("material"), none.alias("gender"), F.col("p_retailprice").alias("price"),
    )


def _product_queries(spark):
    return spark.createDataFrame(PRODUCT_QUERIES, "query_id long, query string")


def _product_query_vectors(spark, sf_dir):
    ids = spark.createDataFrame([(i, 7 * i) for i, _ in PRODUCT_QUERIES], "query_id long, doc_id long")
    return ids.join(_vectors(spark, sf_dir), "doc_id").select("query_id", "v")


def token_stats(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    post = retrieval.postings(docs)
    totals = post.agg(F.sum("tf").alias("tokens"), F.countDistinct("term").alias("terms"))
    return retrieval.corpus_stats(docs, post).select("n", F.round("avgdl", 6).alias("avgdl"), totals.select("tokens").scalar().alias("tokens"), totals.select("terms").scalar().alias("terms"))


def term_idf(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    post = retrieval.postings(docs)
    return retrieval.term_stats(post, retrieval.corpus_stats(docs, post)).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf_dir):
    return retrieval.bm25(_asked(spark, sf_dir), _docs(spark, sf_dir)).select("query_id", "doc_id", "score", "rank")


def vocab_len_gt2(spark, sf_dir):
    return search.vocabulary(_docs(spark, sf_dir))


def tfidf_weights(spark, sf_dir):
    return lsi.tfidf(_docs(spark, sf_dir)).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def lsi_neighbours(spark, sf_dir):
    """The ten nearest documents of each query in the latent space of all terms."""
    docs = _docs(spark, sf_dir)
    model = lsi.LatentModel().fit_texts(docs)
    asked = _asked(spark, sf_dir).select(F.col("query_id").alias("doc_id"), F.col("query").alias("text"))
    queries = model.encode(lsi.tfidf(asked), asked).select(F.col("doc_id").alias("query_id"), "v")
    return retrieval.exact_topk(queries, model.documents(docs), 10)


def exact_ip_topk(spark, sf_dir):
    return retrieval.exact_topk(_asked_vectors(spark, sf_dir), _vectors(spark, sf_dir), 10).select("query_id", "doc_id", "score", "rank")


def lsh_signature(spark, sf_dir):
    return _vectors(spark, sf_dir).select("doc_id", retrieval.signature(F.col("v"), retrieval.planes(DIM)).alias("sig"))


def lsh_topk(spark, sf_dir):
    return retrieval.lsh_topk(_asked_vectors(spark, sf_dir), _vectors(spark, sf_dir), 10, retrieval.planes(DIM)).select("query_id", "doc_id", "score", "rank", "fallback")


def ann_overlap_recall(spark, sf_dir):
    q, v = _asked_vectors(spark, sf_dir), _vectors(spark, sf_dir)
    found = E.overlap_recall(retrieval.lsh_topk(q, v, 10, retrieval.planes(DIM)), retrieval.exact_topk(q, v, 10), 10)
    return found.select("query_id", F.round("recall", 4).alias("recall"))


def lsh_sweep(spark, sf_dir):
    """Recall against exact search for several numbers of planes."""
    q, v = _asked_vectors(spark, sf_dir), _vectors(spark, sf_dir)
    exact, out = retrieval.exact_topk(q, v, 10), None
    for n in (10, 12, 16):
        approx = retrieval.lsh_topk(q, v, 10, retrieval.planes(DIM, n))
        share = approx.groupBy("query_id").agg(F.max(F.col("fallback").cast("int")).alias("f")).agg(F.round(F.avg("f"), 4)).scalar()
        row = E.overlap_recall(approx, exact, 10).agg(F.round(F.avg("recall"), 4).alias("recall")).select(F.lit(n).alias("planes"), "recall", share.alias("fallback_share"))
        out = row if out is None else out.unionByName(row)
    return out


def synthetic_ann_scale(spark, sf_dir):
    """Hashed against exact search over generated vectors, one row a size; reads no table."""
    out = None
    for n in (10_000, 50_000):
        row = reporting.ann_scale(spark, n).select("vectors", "queries", "recall", "vector_bytes")
        out = row if out is None else out.unionByName(row)
    return out


def _lists(spark, sf_dir):
    q = _asked(spark, sf_dir)
    lexical = staged(retrieval.bm25(q, _docs(spark, sf_dir)), "lexical")
    dense = staged(retrieval.exact_topk(_asked_vectors(spark, sf_dir), _vectors(spark, sf_dir), retrieval.CANDIDATES), "dense")
    return lexical, dense, staged(retrieval.fuse([lexical, dense]), "fused")


def rrf_fusion(spark, sf_dir):
    return _lists(spark, sf_dir)[2].select("query_id", "doc_id", "score", "rank")


def rank_trace(spark, sf_dir):
    return search.trace(*_lists(spark, sf_dir))


def minmax_rerank(spark, sf_dir):
    """Feature reranking of the fused document lists without product attributes."""
    lexical, dense, fused = _lists(spark, sf_dir)
    rows = fused.select("query_id", "doc_id", F.col("score").alias("fusion"))
    for name, listed in (("bm25", lexical), ("dense", dense)):
        rows = rows.join(listed.select("query_id", "doc_id", F.col("score").alias(name)), ["query_id", "doc_id"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    w = search.RERANK
    score = sum((w[n] * retrieval.minmax(F.col(n)) for n in ("dense", "fusion")), w["bm25"] * retrieval.minmax(F.col("bm25"))) + w["confidence"]
    return retrieval.top(rows.withColumn("score", F.round(score, 6)), 10, [F.desc("score"), F.asc("doc_id")]).select("query_id", "doc_id", "score", "rank")


def _catalogue_search(spark, sf_dir, modes, k, normalize=False):
    args = _product_queries(spark), _products(spark, sf_dir), _vectors(spark, sf_dir), _product_query_vectors(spark, sf_dir)
    if len(modes) > 1:
        return search.search_lab(*args, k=k, normalize=normalize)
    return search.search_text(*args, mode=modes[0], k=k, normalize=normalize)


RESULT = ["query_id", "mode", "rank", "doc_id", "title", "price", "score", "matched", "reason"]


def search_lab(spark, sf_dir):
    return _catalogue_search(spark, sf_dir, search.MODES, 8).select(*RESULT)


def hybrid_search(spark, sf_dir):
    return _catalogue_search(spark, sf_dir, ["hybrid"], 12).select(*RESULT)


def reranked_search(spark, sf_dir):
    return _catalogue_search(spark, sf_dir, ["reranked"], 12).select(*RESULT)


def normalized_search(spark, sf_dir):
    """Reranked search with spelling correction (its block ratio is beyond SQL)."""
    return _catalogue_search(spark, sf_dir, ["reranked"], 12, normalize=True).select(*RESULT)


def price_filter_after_topk(spark, sf_dir):
    """The price limit drops rows of the capped list; it never lets others move up into it."""
    asked = search.understood(_product_queries(spark), None, normalize=False)
    listed = retrieval.bm25(asked, _products(spark, sf_dir))
    rows = listed.join(_products(spark, sf_dir).select("doc_id", "price"), "doc_id").join(asked, "query_id").where(T.price_allowed(search._c(), F.col("price")))
    return retrieval.top(rows.withColumnRenamed("rank", "list_rank"), 12, [F.asc("list_rank")]).select("query_id", "doc_id", "list_rank", "rank", "price")


def exact_filter_before_cut(spark, sf_dir):
    """The exhaustive baseline filters all products by price before it cuts."""
    asked = search.understood(_product_queries(spark), None, normalize=False)
    wanted = _product_query_vectors(spark, sf_dir).withColumnRenamed("v", "qv").join(asked, "query_id")
    items = _vectors(spark, sf_dir).join(_products(spark, sf_dir).select("doc_id", "price"), "doc_id")
    rows = search.scored(wanted, items, T.price_allowed(search._c(), F.col("price")))
    return retrieval.top(rows, 12, [F.desc("visual_raw"), F.asc("doc_id")]).select("query_id", "doc_id", F.col("visual_raw").alias("score"), "rank")


def parse_constraints(spark, sf_dir):
    talk = _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("query_id"), F.col("text").alias("query"))
    both = _product_queries(spark).unionByName(talk)
    return both.select("query_id", *[c.alias(n) for n, c in T.constraints(F.col("query")).items()])


def attribute_match(spark, sf_dir):
    """Products that meet a stated constraint of each query."""
    asked = search.understood(_product_queries(spark), None, normalize=False)
    share, labels = T.attribute_match(search._c(), search._p())
    # a fixed handful of queries against every product
    pairs = _products(spark, sf_dir).join(F.broadcast(asked), F.lit(True))
    return pairs.select("query_id", "doc_id", F.round(share, 6).alias("share"), F.array_join(labels, ", ").alias("matched")).where("share > 0")


def rewrite_queries(spark, sf_dir):
    return _product_queries(spark).select("query_id", T.rewrite(F.col("query")).alias("normalized"))


def normalize_queries(spark, sf_dir):
    fixed = T.correct(_product_queries(spark), search.vocabulary(_products(spark, sf_dir)))
    return fixed.withColumn("corrections", F.to_json("corrections")).withColumn("confidence", F.round("confidence", 6))


def search_documents(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    attributes = F.create_map(F.lit("product_type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    text = T.search_document(F.col("p_name"), none, F.lower("p_type"), F.col("p_brand"), F.split("p_name", " ")[0], attributes, F.array(F.col("p_type")), none)
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def _judged(spark, sf_dir):
    """Vectors of the query's label are relevant, with a grade of 1 to 3."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "label")
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    asked = items.join(e, F.col("query_id") == F.col("vec_id")).select("query_id", "label")
    return asked.join(e.withColumnRenamed("vec_id", "doc_id"), "label").where("query_id <> doc_id").select("query_id", "doc_id", (1 + F.col("doc_id") % 3).cast("int").alias("grade"))


def _doc_products(spark, sf_dir):
    """Documents in the role of products: language, source and length are their attributes."""
    none = F.lit(None).cast("string")
    return _read(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("source").alias("title"), F.col("lang").alias("category"), F.col("source").alias("product_type"), none.alias("colour"),
        F.col("source").alias("brand"), none.alias("material"), none.alias("gender"), F.col("n_chars").alias("price"),
    )


def _methods(spark, sf_dir):
    """Five ranked lists of vectors and documents for each query, cut to 10, the query's own id left out.

    All come from the shared lexical and dense lists; ``reranked`` is the search engine's own reranker.
    """
    q, v = _asked_vectors(spark, sf_dir), _vectors(spark, sf_dir)
    lexical, dense, fused = _lists(spark, sf_dir)
    hashed = search.search_image(q, v, 10, exclude_self=True, hyperplanes=retrieval.planes(DIM))
    asked = search.understood(_asked(spark, sf_dir), None, normalize=False)
    rows = search.candidates(asked, lexical, dense, fused, _doc_products(spark, sf_dir))
    own = lambda listed: retrieval.top(listed.where("query_id <> doc_id").withColumnRenamed("rank", "was"), 10, [F.asc("was")])
    out = None
    for name, listed in (
        ("bm25", own(lexical)), ("dense", hashed), ("dense_exact", own(dense)), ("hybrid", own(fused)), ("reranked", own(search.ranked(rows, "reranked", 11))),
    ):
        part = listed.select(F.lit(name).alias("method"), "query_id", "doc_id", "rank")
        out = part if out is None else out.unionByName(part)
    return staged(out, "methods")


def _query_metrics(spark, sf_dir):
    return staged(E.query_metrics(_methods(spark, sf_dir), _judged(spark, sf_dir), 10), "metrics")


def retrieval_metrics(spark, sf_dir):
    return _query_metrics(spark, sf_dir).select("method", "query_id", *[F.round(m, 6).alias(m) for m in E.METRICS])


def metrics_by_slice(spark, sf_dir):
    slices = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "lang", F.col("source").alias("query_type"))
    return E.metric_slices(_query_metrics(spark, sf_dir).join(slices, "query_id"), ["lang", "query_type"])


def first_relevant_rank(spark, sf_dir):
    return _query_metrics(spark, sf_dir).where("first is not null").select("method", "query_id", "first")


def ablation_delta(spark, sf_dir):
    steps = [("recall", "hybrid", "dense"), ("mrr", "reranked", "hybrid"), ("ndcg", "reranked", "hybrid")]
    return E.ablation(_query_metrics(spark, sf_dir), steps)


def _languages(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("language"))


def error_reasons(spark, sf_dir):
    return E.error_reasons(_query_metrics(spark, sf_dir), _languages(spark, sf_dir), multilingual=("fr", "de", "es"))


def worst_failures(spark, sf_dir):
    """The report of the twenty worst failing queries."""
    return E.error_reasons(_query_metrics(spark, sf_dir), _languages(spark, sf_dir), 20, ("fr", "de", "es"))


def latency_percentiles(spark, sf_dir):
    return E.latency_summary(_read(spark, sf_dir, "events"), ["event_type"], "value")


def stage_latency(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    timings = F.create_map(F.lit("retrieval"), F.col("value"), F.lit("ranking"), F.col("value") / 2)
    return E.stage_latency(e.select(F.col("event_type").alias("method"), timings.alias("timings")))


def image_knn_self_excluded(spark, sf_dir):
    return search.search_image(_asked_vectors(spark, sf_dir), _vectors(spark, sf_dir), 5, exclude_self=True).select("query_id", "doc_id", "score", "rank")


def multimodal_fusion(spark, sf_dir):
    v = _product_query_vectors(spark, sf_dir)
    return search.search_multimodal(_product_queries(spark), _products(spark, sf_dir), _vectors(spark, sf_dir), v, v, k=12, normalize=False).select(
        "query_id", "rank", "doc_id", "title", "price", "score", "visual", "text_score", "attribute", "matched"
    )


def search_log(spark, sf_dir):
    """A batch of searches is logged and the log read back: what was asked and what was found."""
    results = staged(_catalogue_search(spark, sf_dir, ["hybrid"], 12), "results")
    asked = _product_queries(spark)
    path = f"{shared_dir(spark)}/search-log-{uuid.uuid4().hex}"
    events = results.select("query_id", F.col("doc_id").cast("string").alias("product_id"), "rank", "score")
    if not catalog.append_log(catalog.log_rows(asked, search.understood(asked, None, normalize=False), "hybrid"), events, path):
        raise RuntimeError("the log could not be written")
    found = spark.read.parquet(f"{path}/search_events").groupBy("query_id").agg(F.count("*").alias("results"), F.max("score").alias("best"))
    rows = spark.read.parquet(f"{path}/search_queries").where("created_at is not null").join(found, "query_id", "left")
    return rows.select("query_id", "original_query", "normalized_query", "mode", F.coalesce("results", F.lit(0)).alias("results"), "best")


def stored_index_topk(spark, sf_dir):
    """The hashed search over an index that was stored, refused for another catalogue, built and opened again."""
    v = _vectors(spark, sf_dir)
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.VectorIndex(spark, path).open(v, "an earlier catalogue")
    if index.VectorIndex(spark, path).open(v, "this catalogue").loaded or not index.VectorIndex(spark, path).open(v, "this catalogue").loaded:
        raise RuntimeError("the stored index does not follow its manifest")
    found = index.VectorIndex(spark, path).open(v, "this catalogue").search(_asked_vectors(spark, sf_dir), 10)
    return found.select("query_id", "doc_id", "score", "rank", "fallback")


def _image_metrics(spark, sf_dir):
    q, v = _asked_vectors(spark, sf_dir), _vectors(spark, sf_dir)
    found = retrieval.exact_topk(q, v, 6)
    modality = q.select("query_id", F.lit("image").alias("modality"), F.col("query_id").alias("query_image_id"))
    return reporting.modality_metrics(found, _judged(spark, sf_dir), modality)


def image_metrics(spark, sf_dir):
    """Precision, recall, MRR and nDCG of image search at 5, the query image left out."""
    return _image_metrics(spark, sf_dir).select("modality", "query_id", *[F.round(m, 6).alias(m) for m in E.METRICS])


def weakest_images(spark, sf_dir):
    """The five image queries with the lowest recall."""
    return reporting.weakest(staged(_image_metrics(spark, sf_dir), "image-metrics")).select("place", "query_id", F.round("recall", 6).alias("recall"))


def idempotent_seed(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return catalog.seed(part.where("p_size <= 25"), part, "p_partkey")


def golden_builder(spark, sf_dir):
    """Judged queries of all four kinds: text, Telugu text, image, and image with text."""
    b, labels = _read(spark, sf_dir, "benchmark"), _read(spark, sf_dir, "labels")
    grades = labels.where("quality = 1").select(F.col("doc_id").alias("item_id"), F.create_map(F.col("doc_id").cast("string"), F.col("quality")).alias("relevance"))
    text = b.join(grades, "item_id").select("item_id", F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 0, "hindi").otherwise("exact").alias("type"), "relevance")
    image = F.concat(F.lit("img-"), "item_id")
    pictures = text.select("item_id", image.alias("query_product_id"), F.map_keys("relevance").alias("relevant_product_ids"), F.lit("same label").alias("label_rule"))
    golden = catalog.golden_union(
        catalog.golden_text(text, "text", ["item_id"]),
        catalog.golden_text(text, "telugu", ["item_id"], "te"),
        catalog.golden_images(pictures, ["item_id"]),
        catalog.golden_multimodal(text.withColumn("query_image_id", image), ["item_id"]),
    )
    return golden.select("query_id", "query", "language", "modality", "query_type", "query_image_id", F.array_join("relevant_document_ids", ",").alias("relevant"))


def golden_validate(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    rows = c.select(
        F.concat(F.lit("c-"), "conv_id").alias("query_id"), F.when(F.col("turn") == 0, "").otherwise(F.col("text")).alias("query"), F.lit("en").alias("language"),
        F.when(F.col("role") == "user", "text").otherwise("image").alias("modality"), F.lit("exact").alias("query_type"),
        F.when(F.col("turn") % 2 == 1, "img").alias("query_image_id"), F.array(F.lit("a")).alias("relevant_document_ids"),
        F.lit(None).cast("map<string,int>").alias("graded_relevance"), F.lit(None).cast("string").alias("notes"),
    )
    return catalog.golden_violations(catalog.coerce_golden(rows)).groupBy("query_id", "violation").agg(F.count("*").alias("n"))


def catalog_hash(spark, sf_dir):
    return catalog.content_hash(_read(spark, sf_dir, "part"), "p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])


def index_manifest(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    return catalog.manifest(part, "p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], "lightweight", DIM, "hyperplane")


def index_status(spark, sf_dir):
    """Sizes of the searchable collections and of the vector index in bytes."""
    v = _vectors(spark, sf_dir)
    docs = _docs(spark, sf_dir)
    rows = v.agg(F.count("*").alias("vectors"), F.max(F.size("v")).alias("dim"), F.sum(F.size("v") * 4).alias("vector_bytes"))
    return rows.select(docs.agg(F.count("*")).scalar().alias("documents"), "vectors", "dim", "vector_bytes", F.lit(retrieval.plane_count(DIM)).alias("planes"))


def product_lookup(spark, sf_dir):
    """Products by id: each judged document that the catalogue holds."""
    ids = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("p_partkey")).distinct()
    return _read(spark, sf_dir, "part").join(ids, "p_partkey").select("p_partkey", "p_name", "p_brand", "p_retailprice")


NAMES = [
    token_stats, term_idf, bm25_topk, vocab_len_gt2, tfidf_weights, lsi_neighbours, exact_ip_topk, lsh_signature, lsh_topk,
    ann_overlap_recall, lsh_sweep, synthetic_ann_scale, rrf_fusion, rank_trace, minmax_rerank, search_lab, hybrid_search,
    reranked_search, normalized_search, price_filter_after_topk, exact_filter_before_cut, parse_constraints, attribute_match,
    rewrite_queries, normalize_queries, search_documents, retrieval_metrics, metrics_by_slice, first_relevant_rank,
    ablation_delta, error_reasons, worst_failures, latency_percentiles, stage_latency, image_knn_self_excluded, multimodal_fusion,
    search_log, stored_index_topk, image_metrics, weakest_images, idempotent_seed, golden_builder, golden_validate, catalog_hash, index_manifest, index_status, product_lookup,
]


def flagship(spark, sf_dir):
    """Hybrid retrieval, rank fusion and reranking of the whole query batch."""
    return minmax_rerank(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
