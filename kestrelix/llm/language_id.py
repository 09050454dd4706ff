"""Language identification by nearest clustered centroid.

A text is a vector of byte bigram and trigram counts (letters lower-cased, runs of
anything else a blank) hashed into a fixed number of features, weighted by
``(1 + ln tf) * idf`` and L2-normalised. Each language has several centroids
(spherical k-means); a text takes the language of the centroid with the largest
cosine, and is marked rejected if it lies farther from that centroid than nearly
all texts that formed it.

Document frequencies cover every training text. The centroids are fitted on at
most ``sample`` texts a language (a documented bound); all else covers all rows.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelix.llm.textops import pieces, text_buffer

FEATURES = 4096
DRAW = 1 << 48
UNDETERMINED = "und"
_LETTER = re.compile("[A-Za-z]")  # the quick case; numerals and signs are no letters
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def term_counts(column: pa.Array) -> np.ndarray:
    """Counts [texts, FEATURES] of the hashed bigrams and trigrams of whole texts."""
    buf, offsets = text_buffer(column)
    n = len(offsets) - 1
    x = _FOLD[buf].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64) * FEATURES, np.diff(offsets))
    out = np.zeros(n * FEATURES, np.int32)
    for width in (2, 3):
        m = len(x) - width + 1
        if m <= 0:
            continue
        code = x[:m].copy()
        for j in range(1, width):
            code = (code << np.uint32(8)) | x[j : j + m]
        code *= np.uint32(2654435761)
        code >>= np.uint32(20)
        inside = doc[:m] == doc[width - 1 :]
        code = code + (doc[:m]).astype(np.int64)
        out += np.bincount(code[inside], minlength=len(out)).astype(np.int32)
    return out.reshape(n, FEATURES)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts, dtype=np.float32)
    v *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    v /= np.maximum(norm, 1e-12)[:, None]
    return v


def has_letter(text: str | None) -> bool:
    """Does the text hold a character of a Unicode letter category?"""
    return text is not None and (_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def _slices(batch: pa.RecordBatch, column: str):
    for part in pieces(batch, column, 2 << 20):
        for at in range(0, part.num_rows, 512):
            yield part.slice(at, min(512, part.num_rows - at))


def _document_frequency(batches, text: str):
    total = np.zeros(FEATURES, np.int64)
    for batch in batches:
        for part in _slices(batch, text):
            total += (term_counts(part.column(text)) > 0).sum(axis=0)
    yield pa.RecordBatch.from_pydict({"feature": np.arange(FEATURES, dtype=np.int32), "df": total})


def cluster(vectors: np.ndarray, clusters: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, started from the farthest points; centroids and members."""
    chosen = [0]
    best = vectors @ vectors[0]
    while len(chosen) < min(clusters, len(vectors)):
        far = int(best.argmin())
        chosen.append(far)
        best = np.maximum(best, vectors @ vectors[far])
    centroids = vectors[chosen].copy()
    for _ in range(rounds):
        member = (vectors @ centroids.T).argmax(axis=1)
        for c in range(len(centroids)):
            if (member == c).any():
                s = vectors[member == c].sum(axis=0)
                centroids[c] = s / max(float(np.linalg.norm(s)), 1e-12)
    return centroids, (vectors @ centroids.T).argmax(axis=1)


def _fit(pdf: pd.DataFrame, idf: np.ndarray, clusters: int, sample: int, slack: float) -> pd.DataFrame:
    pdf = pdf.sort_values(["draw", "text"]).head(sample)
    col = pa.array(pdf["text"].tolist(), pa.string())
    batch = pa.RecordBatch.from_arrays([col], ["text"])
    vectors = np.concatenate([unit_vectors(term_counts(p.column("text")), idf) for p in _slices(batch, "text")])
    centroids, member = cluster(vectors, clusters)
    rows = []
    for c, centroid in enumerate(centroids):
        own = vectors[member == c] @ centroid
        reach = float(1 - own.min()) * slack if len(own) else 0.0
        rows.append((pdf["lang"].iloc[0], c, centroid.astype(np.float32).tobytes(), reach))
    return pd.DataFrame(rows, columns=["lang", "cluster", "vector", "reach"])


def _predict(batches, names, matrix, reach, idf, text):
    for batch in batches:
        for part in _slices(batch, text):
            col = part.column(text)
            lettered = np.array([has_letter(x) for x in col.to_pylist()], bool)
            if len(names):
                cos = unit_vectors(term_counts(col), idf) @ matrix.T
                best = cos.argmax(axis=1)
                score = np.clip(cos[np.arange(len(best)), best].astype(np.float64), 0.0, 1.0)
                lang = np.where(lettered, np.array(names, object)[best], UNDETERMINED)
                far = (1 - score > reach[best]) | ~lettered
            else:
                lang = np.full(part.num_rows, UNDETERMINED, object)
                score, far = np.zeros(part.num_rows), np.ones(part.num_rows, bool)
            score = np.where(lettered, score, 0.0)
            kept = [part.column(c) for c in part.schema.names if c != text]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(far)],
                names=[c for c in part.schema.names if c != text] + ["lang_pred", "score", "rejected"],
            )


def identify_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    clusters: int = 4,
    sample: int = 400,
    slack: float = 1.25,
) -> DataFrame:
    """One row a document: id, held_out, lang_pred, score, rejected.

    Centroids are fitted on distinct texts: all of a language up to 2 * ``sample`` + 200, else
    about 1.5 * ``sample`` + 100 of them drawn by a hash of the text, of which the first
    ``sample`` count; a language with any training text has a centroid.

    Training rows have a language and a text, and ``crc32(id as text) mod 4`` other
    than 2; ``held_out`` marks the remainder 2 (a null id is not held out). A null text
    or one without a letter (a character of a Unicode letter category) gives ``und``, score 0, rejected. With no training row at
    all every text is ``und``. Equal cosines take the first language in sorted order.
    Repeated rows are answered once each; other columns are ignored.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held.alias("held_out"))
    train = rows.where("not held_out and lang is not null and text is not null")

    df = train.select("text").mapInArrow(partial(_document_frequency, text="text"), "feature int, df long")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(FEATURES)
    for r in df.groupBy("feature").agg(F.sum("df").alias("df")).collect():
        counts[r["feature"]] = r["df"]
    n = sum(sizes.values())
    idf = (np.log((1 + n) / (1 + counts)) + 1).astype(np.float32)

    names, matrix, reach = [], np.zeros((0, FEATURES), np.float32), np.zeros(0)
    if sizes:
        # drawn by a hash of the text among distinct texts, so that copies count once
        keyed = train.select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(DRAW)).alias("draw"))
        distinct = {r["lang"]: r["n"] for r in keyed.select("lang", "draw").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
        share = [(lang, DRAW if m <= 2 * sample + 200 else int(DRAW * (1.5 * sample + 100) / m)) for lang, m in sorted(distinct.items())]
        share = F.create_map(*[F.lit(x) for lang, m in share for x in (lang, m)])
        picked = keyed.where(F.col("draw") < share[F.col("lang")]).groupBy("lang", "draw").agg(F.min("text").alias("text"))
        fit = picked.groupBy("lang").applyInPandas(
            lambda pdf: _fit(pdf, idf, clusters, sample, slack), "lang string, cluster int, vector binary, reach double"
        )
        model = sorted(fit.collect(), key=lambda r: (r["lang"], r["cluster"]))
        names = [r["lang"] for r in model]
        matrix = np.stack([np.frombuffer(r["vector"], np.float32) for r in model])
        reach = np.array([r["reach"] for r in model])
    out = rows.select("doc_id", "held_out", "text").mapInArrow(
        partial(_predict, names=names, matrix=matrix, reach=reach, idf=idf, text="text"),
        f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean",
    )
    return out


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify_languages(docs)
