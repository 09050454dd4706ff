"""The stored vector index: vectors with signatures, hyperplanes, ids and a manifest.

An index serves only if its manifest equals the one of the present catalogue and models, ids in
order included; anything else, an unreadable manifest too, means that it is built again.
"""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelix.operators import retrieval
from kestrelix.sources import catalog

VERSION = 1
BACKENDS = ("exact", "hyperplane")
MANIFEST = "version int, mode string, catalog_hash string, dense_model string, visual_model string, backend string, dim int, planes int, seed int, ids_hash string, items long"


def choose_backend(preferred: str) -> str:
    """The backend that really serves: graph indexes do not exist here and become hyperplanes."""
    if preferred in BACKENDS:
        return preferred
    if preferred == "hnsw":
        return "hyperplane"
    raise ValueError(f"unknown vector backend: {preferred}")


def ids_hash(vectors: DataFrame) -> str:
    """A digest of the ids in order, from sums of hashes that hold for any number of rows."""
    row = F.xxhash64(F.col("doc_id").cast("string"))
    half = lambda s: F.sum(F.shiftrightunsigned(row, s).bitwiseAND(0xFFFFFFFF))
    found = vectors.agg(F.count("*").alias("n"), half(0).alias("lo"), half(32).alias("hi"), F.bit_xor(row).alias("x")).first()
    return ":".join(str(x or 0) for x in found)


class VectorIndex:
    """Vectors (doc_id, v) under a path, opened if they still serve and built if not."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "lightweight", backend: str = "hyperplane", dense_model: str = "lsi-v1", visual_model: str = "descriptor-v1", planes: int | None = None):
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode
        self.backend, self.models, self.n_planes = choose_backend(backend), (dense_model, visual_model), planes
        self.loaded, self.built_at, self.seconds = False, None, 0.0

    def _manifest(self, vectors: DataFrame, catalog_hash: str) -> tuple:
        shape = vectors.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
        dim = shape["dim"] or 0
        planes = (self.n_planes or retrieval.plane_count(dim)) if self.backend == "hyperplane" else 0
        return (VERSION, self.mode, catalog_hash, *self.models, self.backend, dim, planes, retrieval.SEED, ids_hash(vectors), shape["n"])

    def stored(self) -> tuple | None:
        """The manifest under the path, None if there is none that can be read."""
        try:
            found = self.spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(f"{self.path}/manifest").collect()
        except Exception:  # missing or corrupt: the index is built again
            return None
        return tuple(found[0]) if len(found) == 1 else None

    def open(self, vectors: DataFrame, catalog_hash: str, force: bool = False) -> "VectorIndex":
        """Serves what is stored if its manifest matches and ``force`` is not set, else builds."""
        began = time.time()
        self.manifest = self._manifest(vectors, catalog_hash)
        self.loaded = not force and self.stored() == self.manifest
        if not self.loaded:
            self._build(vectors)
        self.vectors = self.spark.read.parquet(f"{self.path}/vectors")
        self.planes = None
        if self.backend == "hyperplane":
            rows = self.spark.read.parquet(f"{self.path}/planes").orderBy("plane").collect()
            self.planes = np.array([r["weights"] for r in rows], np.float32).T
        self.built_at = self.spark.read.parquet(f"{self.path}/built").first()["created_at"]
        self.seconds = time.time() - began
        return self

    def _build(self, vectors: DataFrame) -> None:
        dim, n = self.manifest[6], self.manifest[7]
        # an index without a manifest never serves: it goes first and comes back last
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        rows = vectors.select("doc_id", "v")
        if self.backend == "hyperplane":
            planes = retrieval.planes(dim, n)
            rows = retrieval.signed(rows, planes)
            table = [(i, [float(x) for x in planes[:, i]]) for i in range(n)]
            self.spark.createDataFrame(table, "plane int, weights array<float>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/planes")
        rows.write.mode("overwrite").parquet(f"{self.path}/vectors")
        self.spark.range(1).select(F.current_timestamp().alias("created_at")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/built")
        self.spark.createDataFrame([self.manifest], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank, fallback) by the backend of the index."""
        if self.backend == "exact":
            return retrieval.exact_topk(queries, self.vectors, k).withColumn("fallback", F.lit(False))
        return retrieval.lsh_topk(queries, self.vectors, k, self.planes)

    def bytes_on_disk(self) -> int:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

    def status(self) -> DataFrame:
        """One row: label, versions, models, backend, sizes, and whether the index was loaded."""
        version, mode, catalog_hash, dense, visual, backend, dim, planes, _, _, items = self.manifest
        row = (
            "FULL ML" if mode == "full" else "LIGHTWEIGHT", mode, version, items, "bm25-v1", dense, visual, backend, dim, planes, self.loaded, self.built_at,
            round(self.seconds, 3), items * dim * 4, self.bytes_on_disk(), catalog_hash,
        )
        return self.spark.createDataFrame(
            [row],
            "runtime_label string, mode string, index_version int, indexed_items long, lexical_index string, dense_model string, visual_model string, vector_index string, "
            "embedding_dimension int, planes int, loaded_from_persisted_index boolean, last_rebuild_at timestamp, startup_seconds double, numeric_vector_bytes long, index_bytes long, catalog_hash string",
        )


def build_status(spark: SparkSession, rows: DataFrame, key: str, columns: list[str], vectors: DataFrame, path: str, force: bool = False, **options) -> DataFrame:
    """Builds or opens the index of a catalogue and returns its status, for a job that keeps it as a file."""
    digest = catalog.content_hash(rows, key, columns).first()["content_hash"]
    return VectorIndex(spark, path, **options).open(vectors, digest, force).status()
