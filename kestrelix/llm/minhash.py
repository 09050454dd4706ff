"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

1. One pass turns every text into its set of word shingles and a SuperMinHash signature.
   An element takes part with one value in every slot, ``rank + fraction``, where the rank
   is the slot's place in the element's own permutation; slots keep their minimum. Ranks
   are visited in order for all elements of a batch at once and a text is done as soon as
   no slot can still fall (early stopping), mostly after the first rank.
2. Texts with equal sets collapse to one representative. Representatives that agree in a
   band are linked in a star, never pair by pair; the components of these stars are clusters
   of candidates.
3. Within a cluster links are confirmed on the full sets and only a spanning forest
   (union-find) is returned. Clusters above ``CLUSTER`` members are never gathered in one
   task: members meet a few pivots first, and only those left outside the largest group
   then meet all members, block by block. No pair that may matter is left out.
4. The components of the confirmed links are the groups.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelix.llm.components import components
from kestrelix.llm.scratch import tidy, written
from kestrelix.llm.textops import Words, mix, pieces, release, windows

SLOTS = 127  # prime, so that a * rank + b runs through all slots
ROWS, BANDS = 5, 25
CLUSTER, CLUSTER_SHINGLES = 400, 3_000_000  # of a cluster that one task compares
PIVOTS = 8
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
BROADCAST_ROWS = 1_000_000  # of 24 bytes
_GOLD = 0x9E3779B97F4A7C15


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and n + 1 bounds."""
    w = Words(column, lower=True)
    counts = w.counts()
    n = len(counts)
    every = windows(w.hash, width)
    out, sizes = [], np.zeros(n, np.int64)
    for i in range(n):
        c, at = int(counts[i]), int(w.bound[i])
        if c >= width:
            s = np.sort(every[at : at + c - width + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        elif c:
            s = windows(w.hash[at : at + c], c) ^ np.uint64(c * _GOLD % (1 << 64))
        else:
            continue
        out.append(s)
        sizes[i] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def signatures(elements: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """SuperMinHash of each set: [sets, SLOTS], the rank in the top byte."""
    n = len(bound) - 1
    sig = np.full((n, SLOTS), np.iinfo(np.uint64).max, np.uint64)
    flat = sig.reshape(-1)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(bound))
    seed = mix(elements ^ np.uint64(_GOLD))
    first = (seed % np.uint64(SLOTS)).astype(np.int64)
    stride = 1 + ((seed >> np.uint64(20)) % np.uint64(SLOTS - 1)).astype(np.int64)
    for rank in range(SLOTS):
        value = mix(elements + np.uint64((rank + 1) * _GOLD % (1 << 64))) >> np.uint64(8)
        value |= np.uint64(rank << 56)
        np.minimum.at(flat, owner * SLOTS + (first + rank * stride) % SLOTS, value)
        open_ = (sig >= np.uint64((rank + 1) << 56)).any(axis=1)
        if rank + 1 == SLOTS:
            break
        keep = open_[owner]
        if not keep.any():
            break
        if not keep.all():
            elements, owner, first, stride = elements[keep], owner[keep], first[keep], stride[keep]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """[sets, BANDS] hashes of ROWS slots each, different for each band."""
    part = sig[:, : ROWS * BANDS].reshape(len(sig), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(_GOLD) + np.zeros((len(sig), 1), np.uint64)
    for j in range(ROWS):
        key = mix(key ^ part[:, :, j]) + np.uint64(_GOLD)
    return mix(key)


def set_keys(elements: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(elements ^ np.uint64(salt)))])
        out.append((total[bound[1:]] - total[bound[:-1]]).view(np.int64))
    return out[0], out[1]


def _sign(batches, width: int):
    for whole in batches:
        for batch in pieces(whole, "text", 2 << 20):
            elements, bound = shingle_sets(batch.column("text"), width)
            one, two = set_keys(elements, bound)
            keys = band_keys(signatures(elements, bound)).view(np.int64)
            offsets = pa.array(np.arange(0, len(keys) * BANDS + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(np.diff(bound)), pa.array(one), pa.array(two), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))],
                names=["doc_id", "text_key", "n_shingles", "key1", "key2", "bands"],
            )
    release()


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def confirmed(elements: np.ndarray, bound: np.ndarray, percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the exact links between the sets in ``left`` (all) and all sets."""
    sizes = np.diff(bound)
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(elements, kind="stable")
    owner = owner[order]
    values, first = np.unique(elements[order], return_index=True)
    stop = np.append(first[1:], len(order))
    forest, links, apart = Forest(n), [], n
    for i in range(n) if left is None else left:
        if apart == 1:
            break
        own = elements[bound[i] : bound[i + 1]]
        at = np.searchsorted(values, own)
        lo, length = first[at], stop[at] - first[at]
        many = length > 1
        lo, length = lo[many], length[many]
        if not len(lo):
            continue
        total = int(length.sum())
        place = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(total)
        inter = np.bincount(owner[place], minlength=n)
        hit = np.flatnonzero((inter > 0) & (100 * inter >= percent * (sizes + sizes[i] - inter)))
        for j in hit:
            if j != i and forest.union(int(i), int(j)):
                links.append((int(i), int(j)))
                apart -= 1
    return links


def _groups(batches):
    """Runs of rows with equal ``task``, gathered across batches."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column("task").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[-1].column("task")[0].as_py() != task[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _confirm(batches, width: int, percent: int):
    """Links within each task's rows; rows with ``role`` 1 are compared with all, if any are."""
    a, b = [], []
    for group in _groups(batches):
        elements, bound = shingle_sets(group.column("text"), width)
        ids = group.column("node").to_numpy()
        one, _ = set_keys(elements, bound)
        good = one == group.column("key1").to_numpy()  # another row may repeat the id with another text
        role = group.column("role").to_numpy()
        left = np.flatnonzero((role == 1) & good) if (role == 1).any() else np.flatnonzero(good)
        for i, j in confirmed(elements, bound, percent, left):
            if good[i] and good[j] and ids[i] != ids[j]:
                a.append(int(ids[i])), b.append(int(ids[j]))
        if len(a) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)
    release()


def _with_text(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Adds the text to (node, ...) rows; broadcasts them only while they are few."""
    few = members.count() <= BROADCAST_ROWS
    return texts.join(F.broadcast(members) if few else members, "node")


def _linked(tasks: DataFrame, width: int, percent: int) -> DataFrame:
    rows = tasks.select("task", "node", "key1", "role", "text").repartition("task").sortWithinPartitions("task")
    return rows.mapInArrow(partial(_confirm, width=width, percent=percent), "a long, b long")


@tidy
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, component_id, kept for every row.

    Words are runs outside white space with A-Z lower-cased; the set of a text holds its
    distinct ``width``-word shingles, for a shorter text its whole word sequence. Texts with
    100 * intersection >= percent * union are linked; component_id is the smallest id that
    links reach and kept marks the row that has it. A null or blank text has no shingles
    and no links. A null id gives a null component and is kept. Rows that repeat an id with
    the same text are one document; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig, _ = written(
        rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(partial(_sign, width=width), "doc_id long, text_key long, n_shingles long, key1 long, key2 long, bands array<long>"), "signatures"
    )
    usable = sig.where("n_shingles > 0 and doc_id is not null")
    sets = usable.groupBy("key1", "key2", "n_shingles").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")
    )
    sets, _ = written(sets, "sets")

    banded = sets.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
    # written first: with a plain scan on this side, adaptive execution can split a hot band in the join
    buckets, _ = written(buckets.select("band", "hub"), "buckets")
    stars = banded.join(buckets, "band").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    # a set meets at most one hub a band: it keeps the least, and its hubs are linked with that one
    star, _ = written(stars.groupBy("b").agg(F.min("a").alias("a"), F.collect_set("a").alias("hubs")), "stars")
    edges = star.select("a", "b").union(star.select("a", F.explode("hubs").alias("b")).distinct())
    clusters, _ = written(components(edges).select("node", F.col("label").alias("cluster")), "clusters")
    clusters = clusters.join(sets.select("node", "key1", "n_shingles"), "node")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"))
    members, _ = written(clusters.join(sizes, "cluster").drop("n_shingles"), "members")
    texts = rows.where("text is not null").withColumnRenamed("doc_id", "node")

    fits = (F.col("members") <= CLUSTER) & (F.col("shingles") <= CLUSTER_SHINGLES)
    small = members.where(fits)
    found = _linked(_with_text(texts, small.withColumn("task", F.col("cluster")).withColumn("role", F.lit(0))), width, percent)
    large = members.where(~fits)
    if large.limit(1).count():
        found = found.unionByName(_large(texts, large, width, percent))
    links, _ = written(found, "links")

    groups = components(links) if links.limit(1).count() else links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    label = sets.join(groups, "node", "left").select("key1", "key2", "n_shingles", F.coalesce("label", "node").alias("component"), "node", "copies")
    # sets of one row that nothing links are their own group: only the others are joined back
    joined = label.where("copies > 1 or component <> node").drop("node", "copies")
    out = sig.drop("bands").join(joined, ["key1", "key2", "n_shingles"], "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _large(texts: DataFrame, large: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links of clusters that one task must not hold."""
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    salted = large.withColumn("block", F.pmod(F.xxhash64("node", F.lit(11)), blocks).cast("long"))
    salted, _ = written(_with_text(texts, salted), "large")
    low = F.pmod(F.xxhash64("node", F.lit(5)), F.col("members")) < PIVOTS
    pivots = salted.where(low).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    task = F.xxhash64("cluster", "block")
    met = (
        salted.select("cluster", "block", "node", "key1", F.lit(0).alias("role"), "text")
        .unionByName(pivots.select("cluster", F.col("to").alias("block"), "node", "key1", F.lit(1).alias("role"), "text"))
        .withColumn("task", task)
    )
    first, _ = written(_linked(met, width, percent), "pivot-links")
    if first.limit(1).count():
        inner = components(first)
        known = salted.drop("text").join(inner, "node", "left").withColumn("label", F.coalesce("label", "node"))
    else:
        known = salted.drop("text").withColumn("label", F.col("node"))
    known, _ = written(known, "known")
    per = known.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    main = per.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    outside = known.join(main, "cluster").where("label <> main").select("node", "cluster")
    outside, _ = written(outside, "outside")
    counts = outside.groupBy("cluster").agg(F.count("*").alias("out"))
    left = salted.join(outside.select("node"), "node").join(counts, "cluster")
    parts = F.ceil(F.col("out") / BLOCK)
    left = left.withColumn("part", F.pmod(F.xxhash64("node", F.lit(13)), parts).cast("long"))
    left = left.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    right = salted.join(counts, "cluster").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
    tasks = (
        right.select("cluster", "part", "block", "node", "key1", F.lit(0).alias("role"), "text")
        .unionByName(left.select("cluster", "part", F.col("to").alias("block"), "node", "key1", F.lit(1).alias("role"), "text"))
        .withColumn("task", F.xxhash64("cluster", "part", "block"))
    )
    return first.unionByName(_linked(tasks, width, percent))


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")
