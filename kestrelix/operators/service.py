"""What a long-running search process needs around the engine: cache, debug ring, health, reindexing."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections import OrderedDict, deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelix.operators import search
from kestrelix.sources import catalog


class ResultCache:
    """The last results by request for ``ttl`` seconds; a bounded number of them."""

    def __init__(self, ttl: float = 120, most: int = 1000, clock=time.monotonic):
        self.ttl, self.most, self.clock = ttl, most, clock
        self.held: OrderedDict[str, tuple[float, list]] = OrderedDict()

    @staticmethod
    def key(runtime: str, query: str, k: int, mode: str) -> str:
        return "search:" + hashlib.sha256("|".join([runtime, query, str(k), mode]).encode()).hexdigest()

    def get(self, key: str):
        found = self.held.get(key)
        if found is None or found[0] < self.clock():
            self.held.pop(key, None)
            return None
        return found[1]

    def set(self, key: str, value: list) -> None:
        self.held[key] = (self.clock() + self.ttl, value)
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)


class SearchService:
    """One query at a time over a catalogue: checks, cache, log, debug ring and reindexing.

    ``encode`` turns (query_id, query) into (query_id, v); ``index`` is an opened vector index.
    """

    def __init__(self, spark: SparkSession, products: DataFrame, index, encode, log_path: str | None = None, admin_key: str | None = None):
        self.spark, self.products, self.index, self.encode = spark, products, index, encode
        self.log_path, self.admin_key = log_path, admin_key
        self.cache, self.ring = ResultCache(), deque(maxlen=200)

    def search(self, query: str, k: int = 12, mode: str = "reranked") -> list[dict]:
        search.check_request(mode, k, query=query)
        key = self.cache.key(self.index.mode, query, k, mode)
        found = self.cache.get(key)
        if found is not None:
            return found
        began = time.time()
        asked = self.spark.createDataFrame([(1, query)], "query_id long, query string")
        rows = search.search_text(asked, self.products, self.index.vectors, self.encode(asked), mode, k, hyperplanes=self.index.planes)
        found = [r.asDict() for r in rows.orderBy("rank").collect()]
        ms = (time.time() - began) * 1000
        name = uuid.uuid4().hex
        self.ring.append({"query_id": name, "query": query, "mode": mode, "latency_ms": ms, "results": found})
        if self.log_path:
            understood = search.understood(asked, self.products).withColumn("query_id", F.lit(name))
            events = [(name, str(r["doc_id"]), r["rank"], float(r["score"])) for r in found]
            events = self.spark.createDataFrame(events, "query_id string, product_id string, rank int, score double")
            catalog.append_log(catalog.log_rows(asked.withColumn("query_id", F.lit(name)), understood, mode, ms), events, self.log_path)
        self.cache.set(key, found)
        return found

    def debug(self, query_id: str) -> dict | None:
        """One of the last 200 searches."""
        return next((x for x in self.ring if x["query_id"] == query_id), None)

    def health(self) -> dict:
        return {"status": "ok", "mode": self.index.mode, "vector_index": self.index.backend, "spark": self.spark.version}

    def reindex(self, key: str | None, vectors: DataFrame, catalog_hash: str) -> DataFrame:
        """Builds the index again whatever is stored; needs the admin key if one is set."""
        if self.admin_key is not None and key != self.admin_key:
            raise PermissionError("reindexing needs the admin key")
        self.index.open(vectors, catalog_hash, force=True)
        self.cache.held.clear()
        return self.index.status()
