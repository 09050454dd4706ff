"""Known answers for the engine's own operators."""

import json
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kestrelix.functions import text as T
from kestrelix.operators import evaluation as E
from kestrelix.operators import lsi, reporting, retrieval, search, service
from kestrelix.sources import catalog, images, index


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def ranking(spark):
    listed = spark.createDataFrame([("m", 1, d, i) for i, d in enumerate("abcd", 1)], "method string, query_id long, doc_id string, rank int")
    judged = spark.createDataFrame([(1, "b", 3), (1, "c", 1), (1, "z", 2)], "query_id long, doc_id string, grade int")
    return listed, judged


def test_metrics(ranking):
    r = E.query_metrics(*ranking, k=2).first()
    assert (r["precision"], r["mrr"], r["first"]) == (0.5, 0.5, 2)
    assert r["recall"] == pytest.approx(1 / 3)


def test_ndcg_of_ideal_and_reversed_order(spark):
    judged = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (1, "c", 1)], "query_id long, doc_id string, grade int")
    listed = [("ideal", 1, d, i) for i, d in enumerate("abc", 1)] + [("reversed", 1, d, i) for i, d in enumerate("cba", 1)] + [("miss", 1, "x", 1)]
    got = {r["method"]: r["ndcg"] for r in E.query_metrics(spark.createDataFrame(listed, "method string, query_id long, doc_id string, rank int"), judged).collect()}
    assert got["ideal"] == pytest.approx(1) and 0 < got["reversed"] < 1 and got["miss"] == 0


def test_overlap(spark):
    lists = [spark.createDataFrame([(1, d, i) for i, d in enumerate(x, 1)], "query_id long, doc_id string, rank int") for x in ("acx", "abc")]
    assert E.overlap_recall(*lists, 3).first()["recall"] == pytest.approx(2 / 3)


def test_k_must_be_positive(ranking):
    with pytest.raises(ValueError):
        E.query_metrics(*ranking, k=0)
    with pytest.raises(ValueError):
        E.overlap_recall(ranking[0], ranking[0], -1)


def test_fusion_uses_ranks_only(spark):
    a = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 1, 1), (1, 0, 2)], "query_id long, doc_id long, rank int")
    got = rows(retrieval.fuse([a, b]).select("doc_id", "score", "rank").orderBy("rank"))
    assert got[0][1] == got[1][1] and [g[0] for g in got] == [0, 1]


def test_minmax(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 10.0), (2, 3.0), (2, 3.0)], "query_id long, x double")
    got = sorted(rows(df.select("query_id", retrieval.minmax(F.col("x")))))
    assert got == [(1, 0.0), (1, 0.5), (1, 1.0), (2, 0.0), (2, 0.0)]


def test_exact_search_and_hashing_agree(spark):
    eye = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "doc_id long, v array<float>")
    asked = eye.where("doc_id = 0").withColumnRenamed("doc_id", "query_id")
    first = rows(retrieval.exact_topk(asked, eye, 2).orderBy("rank"))
    assert first == rows(retrieval.exact_topk(asked, eye, 2).orderBy("rank")) and first[0] == (0, 0, 1.0, 1)
    rng = np.random.default_rng(7)
    v = rng.standard_normal((64, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(v)], "doc_id long, v array<float>")
    one = table.where("doc_id = 11").withColumnRenamed("doc_id", "query_id")
    approx = retrieval.lsh_topk(one, table, 5, retrieval.planes(16)).orderBy("rank").collect()
    assert approx[0]["doc_id"] == 11 and len(approx) == 5 and not approx[0]["fallback"]
    wide = retrieval.lsh_topk(one, table, 64, retrieval.planes(16))
    assert wide.where("fallback").count() == 64  # too few near signatures: the exact scan
    assert rows(wide.drop("fallback").orderBy("rank")) == rows(retrieval.exact_topk(one, table, 64).orderBy("rank"))
    assert rows(search.search_image(one, table, 3, exclude_self=True).select("doc_id").where("doc_id = 11")) == []


def parsed(spark, query, vocabulary=("running", "shoes")):
    queries = spark.createDataFrame([(1, query)], "query_id long, query string")
    fixed = T.correct(queries, spark.createDataFrame([(w,) for w in vocabulary], "word string"))
    return fixed.select("*", *[c.alias(n) for n, c in T.constraints(F.col("corrected")).items()]).first()


def test_query_understanding(spark):
    r = parsed(spark, "3k ke andar black running shoes")
    assert r["price_max"] == 3000 and r["colour"] == "black" and r["category"] == "running shoes" and r["confidence"] == 1.0
    r = parsed(spark, "samsoong wirless earbuds")
    assert r["corrected"] == "samsung wireless earbuds" and r["confidence"] == pytest.approx(0.99) and r["brand"] == "Samsung"
    assert r["corrections"] == {"samsoong": "samsung", "wirless": "wireless", "earbuds": "earbuds"}
    assert parsed(spark, "काले रनिंग जूते")["corrected"] == "black running shoes"
    telugu = "నల్ల రన్నింగ్ షూస్"
    assert parsed(spark, telugu)["normalized"] == telugu
    assert parsed(spark, "runnning shooes")["corrected"] == "running shoes"
    r = parsed(spark, "similar boat for women above 500 below 2.5k cheaper")
    assert (r["brand"], r["gender"], r["price_min"], r["price_max"], r["similar"], r["comparative"]) == ("boAt", "women", 500, 2500, True, "cheaper")
    assert parsed(spark, "  ")["corrected"] == ""


def test_request_checks():
    for mode, k in (("other", 5), ("bm25", 0), ("bm25", 51)):
        with pytest.raises(ValueError):
            search.check_request(mode, k)
    assert search.fusion_weights(False, False) == {"visual": 1.0, "text": 0.0, "crossmodal": 0.0, "attribute": 0.0}
    assert sum(search.fusion_weights(True, False).values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        search.fusion_weights(False, False, {"visual": 0.0, "text": 1.0, "crossmodal": 1.0, "attribute": 1.0})
    with pytest.raises(RuntimeError):
        lsi.make_encoder("full")


def test_latency(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 5)] + [("b", float(i)) for i in range(101)], "method string, ms double")
    got = {r["method"]: r for r in E.latency_summary(df, ["method"], "ms").collect()}
    assert got["a"]["p50"] == 2.5 and got["a"]["p99"] is None and got["b"]["p99"] == 99.0 and got["b"]["mean"] == 50.0


def golden(**x):
    base = {"query_id": "q1", "query": "a", "modality": "text", "relevant_document_ids": ["d1", "d2"]}
    return json.dumps({**base, **x})


def test_golden_queries(spark, tmp_path):
    path = tmp_path / "golden.jsonl"
    path.write_text("\n".join([golden(), "", golden(query_id="q2", modality="image", query="", query_image_id="i", relevant_document_ids=[], graded_relevance={"d3": 2})]))
    got = {r["query_id"]: r for r in catalog.load_golden(spark, str(path)).collect()}
    assert got["q1"]["graded_relevance"] == {"d1": 1, "d2": 1} and got["q2"]["relevant_document_ids"] == ["d3"] and got["q1"]["language"] == "unknown"
    assert sorted(rows(catalog.judgements(catalog.load_golden(spark, str(path))))) == [("q1", "d1", 1), ("q1", "d2", 1), ("q2", "d3", 2)]
    for bad in (golden(query=" "), golden(modality="sound"), golden(relevant_document_ids=[]), golden(modality="image"), "\n".join([golden(), golden()])):
        path.write_text(bad)
        with pytest.raises(ValueError):
            catalog.load_golden(spark, str(path))


def test_hash_seed_log_index(spark, tmp_path):
    a = spark.createDataFrame([(i, f"n{i}") for i in range(30)], "id long, name string")
    h = lambda df: catalog.content_hash(df, "id", ["id", "name"]).first()
    assert h(a) == h(a.repartition(7)) and h(a) != h(a.withColumn("name", F.lit("x")))
    assert catalog.seed(a.where("id < 10"), a, "id").count() == 30
    m = catalog.manifest(a, "id", ["id", "name"], "lightweight", 4, "hyperplane")
    assert catalog.manifest_matches(m, m) and not catalog.manifest_matches(m, catalog.manifest(a.limit(3), "id", ["id"], "lightweight", 4, "hyperplane"))
    assert catalog.append_log(a, a, str(tmp_path / "log")) and catalog.append_log(a, a, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log/search_events")).count() == 60
    assert not catalog.append_log(a, a.select(F.lit(None)), "/proc/nowhere")


def test_latent_vectors_keep_neighbours(spark):
    texts = ["red shoe run", "red shoe walk", "blue kettle water", "blue kettle steel", "red shoe"]
    weights = lsi.tfidf(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert all(r["n"] == pytest.approx(1) for r in weights.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect())
    model = lsi.LatentModel(dim=2).fit(weights)
    v = {r["doc_id"]: np.array(r["v"]) for r in model.encode(weights).collect()}
    assert v[0] @ v[1] > 0.9 and abs(v[0] @ v[2]) < 0.1


def test_bm25_in_place_and_by_joins_agree(spark, monkeypatch):
    """Repeated and null ids, null texts, ties and unknown words; only rows near the best leave the tasks that read the documents."""
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 12)))) for i in range(700)]
    docs = spark.createDataFrame([*docs, (5, "a a b"), (6, ""), (None, "a c"), (None, "b"), (701, None)], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "a a q"), (2, "b c"), (3, "q"), (4, "")], "query_id long, query string")
    got = sorted(rows(retrieval.bm25(asked, docs, 5)), key=str)
    known, weights = pa.array(list("abc"), pa.string()), np.array([[1.0], [0.5], [0.2]])
    batches = [pa.record_batch({"doc_id": np.arange(700), "w": [[w] * 3 for w in "abcd" * 175]})]
    assert sum(b.num_rows for b in retrieval._best_scores(retrieval._counted(batches, known), weights, 3.0, 5)) < 525  # of 525 with a score
    monkeypatch.setattr(retrieval, "QUERY_CELLS", 0)
    assert len(got) == 10 and got == sorted(rows(retrieval.bm25(asked, docs, 5)), key=str)


def test_weights_stay_with_their_documents(spark, monkeypatch):
    """Many groups, repeated and null ids, null texts: right weights, and no shuffle by term or document of the matrix."""
    monkeypatch.setattr(lsi, "GROUP_CHARS", 20)
    texts = [(0, "red shoe red"), (1, "blue kettle"), (1, "red kettle"), (None, "blue shoe"), (2, None), (3, ""), *[(i, f"red w{i}") for i in range(4, 30)]]
    weights = lsi.tfidf(spark.createDataFrame(texts, "doc_id long, text string"))
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and "Exchange" in plan
    tf = {}
    for d, text in texts:
        w = (text or "").split()
        for t in [*w, *map(" ".join, zip(w, w[1:]))]:
            tf[d, t] = tf.get((d, t), 0) + 1
    df = {t: sum(x == t for _, x in tf) for _, t in tf}
    raw = {(d, t): (1 + np.log(n)) * (np.log((1 + len(texts)) / (1 + df[t])) + 1) for (d, t), n in tf.items()}
    norm = {d: sum(w * w for (x, _), w in raw.items() if x == d) ** 0.5 for d, _ in raw}
    got = {(d, t): w for d, t, w in rows(weights)}
    assert got.keys() == raw.keys() and all(got[k] == pytest.approx(raw[k] / norm[k[0]]) for k in raw)


def test_latent_model_is_the_truncated_decomposition(spark):
    """Against numpy on the whole matrix: singular values, subspace, and encoded documents."""
    rng = random.Random(5)
    topics = [0] * 25 + [1] * 18 + [2] * 13 + [3] * 8 + [4] * 6  # five themes of their own words stand out
    texts = [" ".join(rng.choices([f"t{t}w{j}" for j in range(6)], k=40)) for t in topics] + [""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = lsi.tfidf(docs)
    terms = sorted({r["term"] for r in weights.collect()})
    at = {t: i for i, t in enumerate(terms)}
    a = np.zeros((len(texts), len(terms)))
    for r in weights.collect():
        a[r["doc_id"], at[r["term"]]] = r["weight"]
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    model = lsi.LatentModel(dim=5, more=10, rounds=6).fit(weights)
    assert np.allclose(model.values, s[:5], rtol=1e-3)
    v = np.zeros((len(terms), 5))
    for r in model.basis.collect():
        v[at[r["term"]]] = r[1:]
    assert model.basis.count() == len(terms)  # no term is left out
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-8)
    assert np.linalg.svd(vt[:5] @ v)[1].min() > 0.999
    got = {r["doc_id"]: np.array(r["v"]) for r in model.encode(weights, docs).collect()}
    assert len(got) == len(texts) and not got[70].any()
    want = a @ v
    for i in range(70):
        assert np.allclose(got[i], want[i] / np.linalg.norm(want[i]), atol=1e-5)


def test_latent_model_in_slices(spark, monkeypatch):
    """Few columns travel at once; the fitted documents have the vectors that encoding gives, repeated and empty ones too."""
    monkeypatch.setattr(lsi, "SLICE_CELLS", 100)
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choices([f"t{i % 3}w{j}" for j in range(5)], k=9))) for i in range(30)] + [(30, ""), (31, None), (5, "t0w1 t0w2")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = lsi.LatentModel(dim=4, more=3).fit_texts(docs)
    got, want = (sorted((r["doc_id"], *r["v"]) for r in df.collect()) for df in (model.documents(docs), model.encode(lsi.tfidf(docs), docs)))
    assert len(got) == 33 and np.allclose(got, want, atol=1e-5)


def test_latent_model_of_few_documents(spark):
    """Fewer documents than dimensions: as many vectors as there are."""
    weights = lsi.tfidf(spark.createDataFrame([(0, "a red shoe"), (1, "blue kettle"), (2, "blue kettle")], "doc_id long, text string"))
    model = lsi.LatentModel().fit(weights)
    v = {r["doc_id"]: np.array(r["v"]) for r in model.encode(weights).collect()}
    assert len(model.values) == 2 and v[1] @ v[2] == pytest.approx(1, abs=1e-5) and abs(v[0] @ v[1]) < 1e-5


def test_image_descriptor():
    def picture(h, w):
        y, x = np.meshgrid((np.arange(h) + 0.5) / h, (np.arange(w) + 0.5) / w, indexing="ij")
        return np.stack([128 + 100 * np.sin(5 * x + 3 * y + c) for c in range(3)], axis=2)

    v = lsi.image_descriptor(picture(96, 96))
    assert v.shape == (124,) and np.linalg.norm(v) == pytest.approx(1, rel=1e-5)
    assert lsi.image_descriptor(np.zeros((4, 4, 3))).shape == (124,)
    for size in ((48, 60), (300, 200)):  # the size of an image does not show
        assert v @ lsi.image_descriptor(picture(*size)) > 0.99


def test_resampling():
    flat = np.full((7, 5), 77.0)
    assert (lsi.resized(flat, 96, 96) == 77).all()
    ramp = np.tile(np.arange(0, 200, 10.0), (4, 1))
    assert (lsi.resized(ramp, 4, 20) == ramp).all()  # its own size: unchanged
    half = lsi.resized(ramp, 4, 10)
    assert np.allclose(half[0, 2:-2], np.arange(5, 200, 20)[2:-2], atol=1)


def png(pixels):
    """A PNG file of an RGB array, written by hand."""
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_are_read_with_a_limit(spark, tmp_path):
    rng = np.random.default_rng(4)
    pixels = rng.integers(0, 256, (20, 31, 3))
    (tmp_path / "good.png").write_bytes(png(pixels))
    (tmp_path / "bad.png").write_bytes(b"no image at all")
    (tmp_path / "large.png").write_bytes(png(rng.integers(0, 256, (200, 200, 3))))
    got = {r["key"].rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path), 50_000).collect()}
    assert {n: r["problem"] for n, r in got.items()} == {"good.png": None, "bad.png": images.UNSUPPORTED, "large.png": images.TOO_LARGE}
    r = got["good.png"]
    assert (r["height"], r["width"]) == (20, 31) and (np.frombuffer(r["rgb"], np.uint8).reshape(20, 31, 3) == pixels).all() and got["large.png"]["rgb"] is None
    table = images.read_images(spark, str(tmp_path), 50_000).where("problem is null")
    assert np.allclose(lsi.describe_images(table).first()["v"], lsi.image_descriptor(pixels), atol=1e-6)


def unit_table(spark, n=64, dim=16):
    v = np.random.default_rng(7).standard_normal((n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(v)], "doc_id long, v array<float>")


def test_stored_index(spark, tmp_path):
    table, path = unit_table(spark), str(tmp_path / "index")
    built = index.VectorIndex(spark, path).open(table, "h1")
    assert not built.loaded and index.VectorIndex(spark, path).open(table, "h1").loaded
    found = index.VectorIndex(spark, path, backend="hnsw").open(table, "h1")  # no graph index: the true backend is named
    assert found.loaded and found.status().first()["vector_index"] == "hyperplane"
    asked = table.where("doc_id < 5").withColumnRenamed("doc_id", "query_id")
    want = sorted(rows(retrieval.lsh_topk(asked, table, 4, retrieval.planes(16))))
    assert sorted(rows(found.search(asked, 4))) == want
    # another catalogue, another order or set of ids, other models, or a corrupt manifest: built again
    for other in (dict(table=table, digest="h2"), dict(table=table.where("doc_id <> 3"), digest="h2"), dict(table=table, digest="h1", dense_model="another")):
        model = {"dense_model": other["dense_model"]} if "dense_model" in other else {}
        assert not index.VectorIndex(spark, path, **model).open(other["table"], other["digest"]).loaded
    index.VectorIndex(spark, path).open(table, "h1")
    for f in (tmp_path / "index" / "manifest").glob("part-*"):
        f.write_text('{"version": 1, "mode"')
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    again = index.VectorIndex(spark, path).open(table, "h1")
    assert not again.loaded and index.VectorIndex(spark, path).open(table, "h1", force=True).loaded is False
    status = again.status().first()
    assert (status["indexed_items"], status["embedding_dimension"], status["numeric_vector_bytes"]) == (64, 16, 4096) and status["index_bytes"] > 0 and status["last_rebuild_at"]
    exact = index.VectorIndex(spark, str(tmp_path / "exact"), backend="exact").open(table, "h1")
    assert sorted(rows(exact.search(asked, 4).drop("fallback"))) == sorted(rows(retrieval.exact_topk(asked, table, 4)))
    with pytest.raises(ValueError):
        index.choose_backend("other")
    part = spark.createDataFrame([(1, "a")], "id long, name string")
    assert index.build_status(spark, part, "id", ["id", "name"], table, str(tmp_path / "third")).first()["catalog_hash"]


def test_service(spark, tmp_path):
    products = spark.createDataFrame([(i, f"red shoe {i}", f"t{i}", "shoes", "shoe", "red", "Nike", None, None, 100.0 + i) for i in range(8)], "doc_id long, text string, title string, category string, product_type string, colour string, brand string, material string, gender string, price double")
    table = unit_table(spark, 8)
    opened = index.VectorIndex(spark, str(tmp_path / "i"), backend="exact").open(table, "h")
    encode = lambda asked: asked.select("query_id", F.array(*[F.lit(0.25)] * 16).cast("array<float>").alias("v"))
    served = service.SearchService(spark, products, opened, encode, str(tmp_path / "log"), admin_key="k")
    first = served.search("red shoe under 105", 3)
    assert len(first) == 3 and served.search("red shoe under 105", 3) is first  # the second from the cache
    log, events = spark.read.parquet(str(tmp_path / "log/search_queries")).collect(), spark.read.parquet(str(tmp_path / "log/search_events")).collect()
    assert len(log) == 1 and log[0]["original_query"] == "red shoe under 105" and json.loads(log[0]["parsed_attributes"])["price_max"] == 105 and log[0]["created_at"]
    assert sorted(e["rank"] for e in events) == [1, 2, 3] and {e["query_id"] for e in events} == {log[0]["query_id"]}
    assert served.debug(log[0]["query_id"])["results"] == first and served.debug("x") is None
    assert served.health()["status"] == "ok" and served.health()["vector_index"] == "exact"
    with pytest.raises(PermissionError):
        served.reindex("wrong", table, "h")
    assert not served.reindex("k", table, "h").first()["loaded_from_persisted_index"] and served.cache.get(served.cache.key("lightweight", "red shoe under 105", 3, "reranked")) is None
    for bad in ("", "x" * 301):
        with pytest.raises(ValueError):
            served.search(bad)


def test_cache():
    now = [0.0]
    cache = service.ResultCache(ttl=120, most=2, clock=lambda: now[0])
    for i in range(3):
        cache.set(str(i), [i])
    assert cache.get("0") is None and cache.get("2") == [2]
    now[0] = 121
    assert cache.get("2") is None
    assert cache.key("a", "q", 1, "m") == cache.key("a", "q", 1, "m") != cache.key("a", "q", 2, "m")


def test_reports(spark, tmp_path):
    golden = catalog.coerce_golden(spark.createDataFrame([("a", "x", "text"), ("b", "", "image")], "query_id string, query string, modality string").select(
        "*", *[F.lit(None).cast(t).alias(n) for n, t in (("language", "string"), ("query_type", "string"), ("query_image_id", "string"), ("relevant_document_ids", "array<string>"), ("graded_relevance", "map<string,int>"), ("notes", "string"))]
    ))
    assert {m: t.count() for m, t in reporting.by_modality(golden).items()} == {"text": 1, "image": 1, "multimodal": 0}
    found = spark.createDataFrame([("b", "me", 1), ("b", "d1", 2), ("b", "d2", 3), ("c", "me", 1)], "query_id string, doc_id string, rank int")
    judged = spark.createDataFrame([("b", "d1", 1), ("c", "me", 1)], "query_id string, doc_id string, grade int")
    kinds = spark.createDataFrame([("b", "image", "me"), ("c", "multimodal", "me")], "query_id string, modality string, query_image_id string")
    got = {r["query_id"]: r for r in reporting.modality_metrics(found, judged, kinds).collect()}
    assert got["b"]["mrr"] == 1.0 and got["b"]["precision"] == pytest.approx(0.2) and got["c"]["mrr"] == 1.0
    weak = reporting.weakest(spark.createDataFrame([(i, 1 - i % 3 / 2) for i in range(9)], "query_id long, recall double"), 4)
    assert [(r["place"], r["query_id"]) for r in weak.orderBy("place").collect()] == [(1, 2), (2, 5), (3, 8), (4, 1)]
    notes = reporting.annotated(spark.createDataFrame([(1, "r"), (2, "r")], "query_id long, reasons string"), spark.createDataFrame([(1, "x"), (2, "X")], "query_id long, query string"), spark.createDataFrame([("x", "seen")], "query string, note string"))
    assert {r["query_id"]: r["note"] for r in notes.collect()} == {1: "seen", 2: None}
    summary = E.latency_summary(spark.createDataFrame([("hybrid", 10.0), ("reranked", 13.5)], "method string, ms double"), ["method"], "ms")
    assert reporting.latency_delta(summary, "reranked", "hybrid").first()["delta"] == 3.5
    assert "| hybrid | 1 | 10.0000 |" in reporting.markdown(summary.orderBy("method"), "Latency")
    speed = reporting.throughput(lambda q: None, list(range(30)))
    assert speed["queries"] == 24 and speed["qps"] > 0 and reporting.throughput(len, [])["qps"] == 0.0
    with pytest.raises(FileNotFoundError):
        reporting.read_artifact(spark, str(tmp_path / "none"), "full")
    path = str(tmp_path / "artifacts")
    reporting.write_artifact(summary, path, "lightweight")
    assert not reporting.read_artifact(spark, path, "full").first()["artifact_mode_matches_runtime"]
    reporting.write_artifact(summary, path, "full")
    assert reporting.read_artifact(spark, path, "full").first()["artifact_mode_matches_runtime"] and reporting.read_artifact(spark, path, "lightweight").first()["artifact_mode"] == "lightweight"
    row = reporting.ann_scale(spark, 300, dim=32, queries=5).first()
    assert row["queries"] == 5 and 0 < row["recall"] <= 1 and row["build_seconds"] > 0


def test_tables_and_catalogue_file(spark, tmp_path):
    path = tmp_path / "catalog.jsonl"
    path.write_text('{"id": "a", "title": "t", "price": 3, "attributes": {"material": "steel"}, "tags": ["x"]}\n\n')
    row = catalog.read_catalog(spark, str(path)).first()
    assert row["attributes"] == {"material": "steel"} and row["search_text_hi"] is None
    path.write_text('{"id": 1')
    with pytest.raises(Exception):
        catalog.read_catalog(spark, str(path)).collect()
    spark.sql(f"CREATE DATABASE shop LOCATION '{tmp_path}/shop'")
    catalog.create_tables(spark, "shop.")
    catalog.create_tables(spark, "shop.")
    assert {r["tableName"] for r in spark.sql("SHOW TABLES IN shop").collect()} == {"products", "product_images", "search_queries", "search_events", "index_versions"}
    spark.sql("INSERT INTO shop.index_versions VALUES (1, 82, 'd', 'v', 0.5, current_timestamp())")
    assert spark.table("shop.index_versions").first()["product_count"] == 82
    spark.sql("DROP DATABASE shop CASCADE")


def test_hash_slots_deepen(spark, monkeypatch):
    a = spark.createDataFrame([(i, f"n{i}") for i in range(300)], "id long, name string")
    monkeypatch.setattr(catalog, "SLOT_ROWS", 1)
    assert catalog.content_hash(a, "id", ["id"]).first() == catalog.content_hash(a.repartition(5), "id", ["id"]).first()
    assert catalog.content_hash(a, "id", ["id"]).first()["rows"] == 300


def test_search_modes(spark):
    products = spark.createDataFrame(
        [(1, "black running shoes mesh", "b shoes", "shoes", "running", "black", "Nike", "mesh", "men", 2500.0), (2, "blue running shoes", "c shoes", "shoes", "running", "blue", "Puma", None, None, 3500.0), (3, "steel kettle", "kettle", "home", "kettle", "grey", "Bajaj", "steel", None, 900.0)],
        "doc_id long, text string, title string, category string, product_type string, colour string, brand string, material string, gender string, price double",
    )
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.4]), (3, [0.0, 1.0])], "doc_id long, v array<float>")
    queries = spark.createDataFrame([(1, "black runing shoes under 3000")], "query_id long, query string")
    asked = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, v array<float>")
    lab = search.search_lab(queries, products, vectors, asked).collect()
    assert {r["mode"] for r in lab} == set(search.MODES) and all(r["price"] <= 3000 for r in lab)
    top = search.search_text(queries, products, vectors, asked, "reranked").orderBy("rank").collect()
    assert top[0]["doc_id"] == 1 and top[0]["reason"].startswith("hybrid relevance + colour=black")
    assert top == search.search_text(queries, products, vectors, asked, "reranked").orderBy("rank").collect()
    both = search.search_multimodal(queries, products, vectors, asked, asked).orderBy("rank").collect()
    assert both[0]["doc_id"] == 1 and 2 not in {r["doc_id"] for r in both}
    picture = search.search_multimodal(queries.withColumn("query", F.lit("")), products, vectors, asked, asked).orderBy("rank").collect()
    assert [r["doc_id"] for r in picture] == [1, 2]
