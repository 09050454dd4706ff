"""Incremental removal of long repeated passages with a log-structured fingerprint index.

Every run of ``window`` words has a canonical fingerprint: the least hash among its runs
of ``window // 2`` words. Equal windows have equal fingerprints, and neighbouring windows
mostly share theirs, so an index of the distinct fingerprints of each document is some
fourteen times smaller than one of all windows and still misses no repeat.

A batch is fingerprinted and written as a new immutable run, sorted by fingerprint. The
sorted runs of earlier batches are merge-joined with it. Documents on either side of a
hit then list all their windows with a shared fingerprint, under two independent 64-bit
hashes of the whole word sequence, and a window goes if an earlier document holds the same.
Once enough runs of a size have gathered they are compacted into one. A manifest lists the
runs, so that another session can open the index and add to it.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelix.llm.scratch import drop_path, names_in, new_path, put_text, remove, tidy, written
from kestrelix.llm.textops import Words, pieces, windows

BROADCAST_ROWS = 1_000_000  # ids of 16 bytes


def canonical(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` words the least hash of its runs of window // 2 words."""
    k = window // 2
    grams = windows(hashes, k)
    span = window - k + 1
    if len(grams) < span:
        return np.zeros(0, np.uint64)
    least, have = grams, 1
    while have * 2 <= span:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    n = len(grams) - span + 1
    return np.minimum(least[:n], least[span - have : span - have + n])


def _fingerprints(batches, window: int):
    for whole in batches:
        for batch in pieces(whole, "text", 2 << 20):
            w = Words(batch.column("text"))
            every = canonical(w.hash, window)
            fps, sizes = [], np.zeros(batch.num_rows, np.int64)
            counts = w.counts()
            for i in np.flatnonzero(counts >= window):
                at = int(w.bound[i])
                fps.append(np.unique(every[at : at + int(counts[i]) - window + 1]))
                sizes[i] = len(fps[-1])
            pick = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((np.concatenate(fps) if fps else np.zeros(0, np.uint64)).view(np.int64)),
                    batch.column("doc_id").take(pick),
                    batch.column("text_key").take(pick),
                ],
                names=["fp", "doc_id", "text_key"],
            )


def _list_windows(batches, window: int):
    for whole in batches:
        for batch in pieces(whole, "text", 1 << 20):
            w = Words(batch.column("text"), second=True)
            every, one, two = canonical(w.hash, window), windows(w.hash, window), windows(w.hash2, window)
            counts = w.counts()
            starts, sizes, places = [], np.zeros(batch.num_rows, np.int64), []
            for i, shared in enumerate(batch.column("fps")):
                n, at = int(counts[i]) - window + 1, int(w.bound[i])
                if n <= 0:
                    continue
                hit = np.flatnonzero(np.isin(every[at : at + n], shared.values.to_numpy().view(np.uint64)))
                starts.append(hit), places.append(hit + at)
                sizes[i] = len(hit)
            place = np.concatenate(places) if places else np.zeros(0, np.int64)
            pick = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(one[place].view(np.int64)),
                    pa.array(two[place].view(np.int64)),
                    batch.column("doc_id").take(pick),
                    batch.column("text_key").take(pick),
                    pa.array((np.concatenate(starts) if starts else np.zeros(0, np.int64)).astype(np.int32)),
                ],
                names=["w1", "w2", "doc_id", "text_key", "start"],
            )


def _strip(batches, window: int, removal: str):
    """Removes the words under the listed windows (``removal``: all, listed or none)."""
    for whole in batches:
        for batch in pieces(whole, "text", 2 << 20):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            listed = batch.column("starts") if removal == "listed" else None
            words, removed, kept = [], [], []
            for i, text in enumerate(texts):
                own = (text or b"").split()
                n = len(own)
                gone = 0
                if removal == "all" and n >= window:
                    own, gone = [], n
                elif listed is not None:
                    edge = np.zeros(n + 1, np.int64)
                    at = listed[i].values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    keep = np.cumsum(edge[:n]) == 0
                    gone = n - int(keep.sum())
                    own = [x for x, k in zip(own, keep) if k]
                words.append(n), removed.append(gone), kept.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class FingerprintIndex:
    """Sorted immutable runs of fingerprints and of whole texts, listed in a manifest.

    ``path`` names a folder of the shared store; an index that is there already is opened, in
    any session, and goes on with its own ``window``. Without a path the index is kept in the
    checkpoint folder. Runs are never changed. Whenever ``fan_in`` runs are of one tier, a tier
    for each power of ``fan_in`` in rows, they are merged into one run of a higher tier; a new
    manifest replaces the old one by its number, so that a broken addition leaves no trace.
    """

    def __init__(self, spark, window: int = 50, fan_in: int = 4, path: str | None = None):
        self.spark, self.window, self.fan_in = spark, window, max(2, fan_in)
        self.path = (path or new_path(spark, "index")).rstrip("/")
        self.runs: list[list] = []  # [folder, rows]
        self.texts: list[list] = []
        self.version = 0
        for name in reversed(names_in(spark, f"{self.path}/manifests")):
            try:
                held = json.loads(spark.read.option("wholetext", "true").text(f"{self.path}/manifests/{name}").first()["value"])
            except (ValueError, TypeError):  # cut off while it was written: the one before holds
                continue
            self.window, self.runs, self.texts, self.version = held["window"], held["runs"], held["texts"], held["version"]
            break

    def _commit(self) -> None:
        self.version += 1
        held = {"version": self.version, "window": self.window, "runs": self.runs, "texts": self.texts}
        put_text(self.spark, f"{self.path}/manifests/{self.version:09d}-{uuid.uuid4().hex[:8]}.json", json.dumps(held))

    def _write(self, df: DataFrame, key: str, name: str) -> list:
        path = f"{self.path}/{name}/{uuid.uuid4().hex}"
        df.repartition(key).sortWithinPartitions(key).write.option("compression", "zstd").parquet(path)
        return [path, self.spark.read.parquet(path).count()]

    def _read(self, runs: list) -> DataFrame | None:
        return self.spark.read.parquet(*[path for path, _ in runs]) if runs else None

    def compact(self, everything: bool = False) -> None:
        """Merges runs of one tier where there are enough of them, or all runs."""
        gone = []
        for name, key in (("runs", "fp"), ("texts", "text_key")):
            while True:
                tiers: dict[int, list] = {}
                for run in getattr(self, name):
                    tiers.setdefault(0 if everything else int(math.log(max(run[1], 1), self.fan_in)), []).append(run)
                full = [t for t, runs in sorted(tiers.items()) if len(runs) >= (2 if everything else self.fan_in)]
                if not full:
                    break
                merged = tiers[full[0]]
                kept = [run for run in getattr(self, name) if run not in merged]
                setattr(self, name, [*kept, self._write(self._read(merged), key, name)])
                gone += merged
        if gone:
            self._commit()
            for path, _ in gone:
                drop_path(self.spark, path)

    def add(self, batch: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Deduplicates a batch (doc_id, text) against earlier batches and itself.

        Returns doc_id, n_words, n_removed, kept_text for each row. ``history`` holds
        the rows of the batches added so far, whose ids must all be smaller. A word goes
        if a window over it also starts in a document with a smaller id. Null texts have no
        words; rows with a null id are never changed nor a source; rows of one id do not
        change each other; other columns are ignored; an empty batch gives no rows.
        """
        rows = batch.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        shape = "doc_id long, n_words long, n_removed long, kept_text string"
        key = F.xxhash64("text")
        keyed = rows.withColumn("text_key", key)

        # whole copies of an earlier text need no fingerprints
        ids = keyed.where("text is not null and doc_id is not null").select("doc_id", "text_key", F.md5(F.col("text").cast("binary")).alias("md5"))
        ids, ids_path = written(ids, "ids")
        first = ids.groupBy("text_key", "md5").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"))
        earlier = self._read(self.texts)
        if earlier is not None:
            earlier = earlier.groupBy("text_key", "md5").agg(F.min("known").alias("known"))
            first = first.join(earlier, ["text_key", "md5"], "left").select(
                "text_key", "md5", F.least(F.coalesce("known", "least"), F.col("least")).alias("least"), "last"
            )
        first, first_path = written(first, "first")
        repeated = first.where("least < last").select("text_key", "md5", "least")
        copies, copies_path = written(ids.join(repeated, ["text_key", "md5"]).where("doc_id > least").select("doc_id", "text_key"), "copies")
        copied = _few(copies)
        fresh = keyed.where("text is not null and doc_id is not null").join(copied, ["doc_id", "text_key"], "left_anti")

        run = self._write(fresh.mapInArrow(partial(_fingerprints, window=self.window), "fp long, doc_id long, text_key long"), "fp", "runs")
        new = self.spark.read.parquet(run[0])
        spans = new.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        inside = spans.where("lo < hi").select("fp")
        old = self._read(self.runs)
        if old is None:
            hits = new.join(inside, "fp", "left_semi")
        else:
            # a batch that is small beside the history travels to it, and the history stays where it is
            asked = new.select("fp").distinct() if run[1] <= BROADCAST_ROWS else new.select("fp")
            old, _ = written(old.join(F.broadcast(asked) if run[1] <= BROADCAST_ROWS else asked, "fp", "left_semi"), "old-hits")
            hits = new.join(inside.union(old.select("fp")).distinct(), "fp", "left_semi").unionByName(old)
        candidates, candidates_path = written(hits.groupBy("doc_id", "text_key").agg(F.collect_set("fp").alias("fps")), "candidates")

        pool = keyed if history is None else keyed.unionByName(history.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", key))
        pool = pool.join(_few(candidates.select("doc_id", "text_key")), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
        listed = pool.join(candidates, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "fps")
        places = listed.mapInArrow(partial(_list_windows, window=self.window), "w1 long, w2 long, doc_id long, text_key long, start int")
        places, places_path = written(places, "places")
        source = places.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last")
        # written first: with a plain scan on this side, adaptive execution can split a hot window in the join
        source, source_path = written(source.select("w1", "w2", "least"), "source")
        repeats = places.join(source, ["w1", "w2"]).where("doc_id > least")
        flagged, flagged_path = written(repeats.groupBy("doc_id", "text_key").agg(F.collect_list("start").alias("starts")), "flagged")
        remove(self.spark, places_path, source_path, candidates_path, ids_path)

        marked = _few(flagged.select("doc_id", "text_key"))
        strip = lambda how: partial(_strip, window=self.window, removal=how)
        touched = keyed.join(marked, ["doc_id", "text_key"], "left_semi").join(flagged, ["doc_id", "text_key"])
        listed = touched.select("doc_id", "text", "starts").mapInArrow(strip("listed"), shape)
        whole = keyed.join(copied, ["doc_id", "text_key"], "left_semi").select("doc_id", "text").mapInArrow(strip("all"), shape)
        rest = keyed.join(marked, ["doc_id", "text_key"], "left_anti").join(copied, ["doc_id", "text_key"], "left_anti")
        rest = rest.select("doc_id", "text").mapInArrow(strip("none"), shape)

        self.runs.append(run)
        self.texts.append(self._write(first.select("text_key", "md5", F.col("least").alias("known")), "text_key", "texts"))
        remove(self.spark, first_path)
        self._commit()
        self.compact()
        return listed.unionByName(whole).unionByName(rest)


@tidy
def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, batches: int = 2) -> DataFrame:
    """All rows of a table, fed to a fresh index in ``batches`` ranges of the id.

    Returns doc_id, n_words, n_removed, kept_text (see :meth:`FingerprintIndex.add`); other
    columns are ignored and an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    index = FingerprintIndex(docs.sparkSession, window)
    out = None
    at = F.col("doc_id")
    for i in range(len(cuts) + 1):
        part = F.lit(True)
        if i < len(cuts):
            part = part & (at <= cuts[i])
        if i:
            part = part & (at > cuts[i - 1])
        if not i:
            part = part | at.isNull()
        done = index.add(rows.where(part), rows.where(at <= cuts[i - 1]) if i else None)
        out = done if out is None else out.unionByName(done)
    drop_path(docs.sparkSession, index.path)  # nothing reads this index again
    return out


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
