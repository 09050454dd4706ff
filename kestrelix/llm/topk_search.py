"""Exact maximum-inner-product search with the threshold algorithm.

Vectors are cut into blocks. For a block each dimension has its vectors in sorted
order; a query walks all lists in parallel (from the top where its component is
positive, from the bottom where negative), scores what it meets by random access,
and stops once its k-th best score exceeds the bound that the list heads still
allow. Query blocks are broadcast behind a check of their number, and candidates
are searched where they are read; beyond it both sides are dealt onto a salted grid of
tasks, so that no join key holds more than its cell. k + 1 rows a query and block go on to
the final ranking, which leaves out the query's own row.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrelix.llm.scratch import tidy, written

BLOCK, QUERY_BLOCK = 4096, 1024
BROADCAST_CELLS = 1 << 22  # numbers of 8 bytes in query blocks that every task may hold: 32 MB
CELL_BLOCKS = 64  # candidate blocks in one cell of the grid


def quantise(vectors: np.ndarray, scale: float = 256.0) -> np.ndarray:
    return np.floor(scale * vectors.astype(np.float64)).astype(np.int64)


def _blocks(batches, size: int, every: int | None):
    """Packs usable vectors into (dim, n, ids, vectors) rows of at most ``size``."""
    held: dict[int, tuple[list, list]] = {}

    def row(dim):
        ids, vs = held.pop(dim)
        return {"dim": dim, "n": len(ids), "ids": np.array(ids, np.int64).tobytes(), "vectors": np.stack(vs).astype(np.int64).tobytes()}

    out = []
    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            if i is None or not v.is_valid or (every and i % every):
                continue
            if v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False)
            if not np.isfinite(x).all():
                continue
            ids, vs = held.setdefault(len(x), ([], []))
            ids.append(i), vs.append(quantise(x))
            if len(ids) == size:
                out.append(row(len(x)))
        if out:
            yield pa.RecordBatch.from_pylist(out, _BLOCK_SCHEMA)
            out = []
    out = [row(d) for d in list(held)]
    if out:
        yield pa.RecordBatch.from_pylist(out, _BLOCK_SCHEMA)


_BLOCK_SCHEMA = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("equal", pa.bool_())])


class Lists:
    """Sorted lists of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")  # so that equal scores keep the smaller id first
        self.ids, self.x = ids[order], x[order]
        big = float(np.abs(self.x).max(initial=0))
        #: products are summed in float64, exact below 2**53
        self.exact = big * big * max(1, x.shape[1]) < 2.0**52
        self.f = self.x.astype(np.float64)
        self.order = np.argsort(self.x, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(self.x, self.order.T, axis=0)

    def search(self, q: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best of the block, best first.

        ``floor``: a score that k other vectors already reach; lower ones may be left out.
        """
        n = len(self.ids)
        live = np.flatnonzero(q)
        up, down = live[q[live] > 0], live[q[live] < 0]
        seen = np.zeros(n, bool)
        at = np.zeros(0, np.int64)
        scores = np.zeros(0, np.int64)
        if not len(live):
            depth = n
        else:
            depth = max(k, n // (4 * len(live)))
        while True:
            depth = min(depth, n)
            mask = np.zeros(n, bool)
            mask[self.order[up, n - depth :]] = True
            mask[self.order[down, :depth]] = True
            if depth >= n:
                mask[:] = True
            new = np.flatnonzero(mask & ~seen)
            seen |= mask
            got = self.score(new, q)
            at, scores = np.concatenate([at, new]), np.concatenate([scores, got])
            if len(at) > k:
                best = np.lexsort((at, -scores))[:k] if len(at) < 64 else self._best(at, scores, k)
                at, scores = at[best], scores[best]
            if depth >= n or seen.all():
                break
            bound = int(q[up] @ self.sorted[n - depth, up]) + int(q[down] @ self.sorted[depth - 1, down])
            kth = int(scores.min()) if len(at) == k else None
            if kth is not None and kth > bound or floor is not None and floor > bound:
                break
            depth *= 4
        best = np.lexsort((at, -scores))
        return at[best], scores[best]

    @staticmethod
    def _best(at, scores, k):
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((at[some], -scores[some]))[:k]]

    def score(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.exact and np.abs(q).max(initial=0) < 1 << 20:
            return (self.f[at] @ q.astype(np.float64)).astype(np.int64)
        return self.x[at] @ q


def _search(batches, k: int):
    floors: dict[int, np.ndarray] = {}  # by query block: the k-th best score of any block so far
    for batch in batches:
        for r in batch.to_pylist():
            dim = r["dim"]
            lists = Lists(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.int64).reshape(r["n"], dim))
            qs, qx = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_vectors"], np.int64).reshape(r["q_n"], dim)
            if r["block"] not in floors:
                floors = {r["block"]: np.full(len(qs), np.iinfo(np.int64).min)}
            floor = floors[r["block"]]
            out = ([], [], [], [], [])
            for j in range(len(qs)):
                at, scores = lists.search(qx[j], k, int(floor[j]))
                if len(at) == k:
                    floor[j] = max(floor[j], int(scores[-1]))
                out[0].append(np.full(len(at), qs[j]))
                out[1].append(np.full(len(at), r["block"] * QUERY_BLOCK + j))
                out[2].append(lists.ids[at])
                out[3].append(scores)
                out[4].append((lists.ids[at] == qs[j]) & (lists.x[at] == qx[j]).all(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(out, _FOUND)], schema=_FOUND)


@tidy
def topk_search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    Components become floor(256 * x). Queries are the rows whose id ``every`` divides;
    candidates are all rows but the query's own. Ties go to the smaller id. Rows with a null
    id, a null vector, or a null or non-finite component take no part; vectors meet only
    vectors of their own length. Rows that repeat an id are separate rows: each is a query of
    its own and a candidate of the others. An empty table gives no rows; other columns are
    ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    block = "dim int, n int, ids binary, vectors binary"
    cand = rows.mapInArrow(partial(_blocks, size=BLOCK, every=None), block)
    asked = rows.where(F.col("vec_id") % every == 0).mapInArrow(partial(_blocks, size=QUERY_BLOCK, every=every), block)
    asked, _ = written(asked.select("dim", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.monotonically_increasing_id().alias("block")), "queries")
    sizes = asked.agg(F.sum(F.col("dim").cast("long") * F.col("q_n")).alias("cells")).first()
    groups = -(-(sizes["cells"] or 0) // BROADCAST_CELLS)
    pairs = cand.join(F.broadcast(asked), "dim") if groups <= 1 else _grid(cand, asked, groups)
    found = pairs.select("dim", "n", "ids", "vectors", "q_n", "q_ids", "q_vectors", "block").mapInArrow(
        partial(_search, k=k + 1), "query_id long, query_row long, vec_id long, score long, equal boolean"
    )
    # one of the rows with the query's id and vector is the query itself
    own = Window.partitionBy("query_id", "query_row", "equal").orderBy("vec_id")
    found = found.withColumn("nth", F.row_number().over(own)).where("not equal or nth > 1")
    w = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _grid(cand: DataFrame, asked: DataFrame, groups: int) -> DataFrame:
    """Every candidate block with every query block of its length, dealt onto a grid of tasks.

    Blocks of queries fall in ``groups`` groups, those of candidates get a salt; a cell of the
    grid joins one group with the blocks of one salt.
    """
    cand, _ = written(cand.withColumn("u_", F.monotonically_increasing_id()), "candidates")
    salts = max(1, -(-cand.count() // CELL_BLOCKS))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = cand.withColumn("salt", F.pmod(F.xxhash64("u_"), F.lit(salts))).withColumn("group", to(groups))
    right = asked.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))).withColumn("salt", to(salts))
    return left.join(right, ["dim", "group", "salt"])


def op2_topk_search(spark, sf_dir: str) -> DataFrame:
    return topk_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
WHERE rank <= 5
"""
